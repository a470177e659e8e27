"""The 101 formulaic alphas as expressions (Kakushadze, "101 Formulaic Alphas", 2016).

Notation: O H L C V A R vwap are the bars' fields, cap the market value; ``d`` difference to k rows before, ``adv(n)``
mean volume, ``indneu`` minus the industry mean, ``iff`` conditional, ``repl(x, a, b)`` x with a replaced by b,
``emax``/``emin`` element-wise, where a missing operand selects the second; fractional windows are rounded.
"""

from __future__ import annotations

# The published expressions.
ALPHAS = {
    "alpha001": "rank(ts_argmax(iff(~(R<0),C,sd(R,20))^2,5))-0.5",
    "alpha002": "fin(-corr(rank(d(log(V),2)),rank((C-O)/O),6))",
    "alpha003": "fin(-corr(rank(O),rank(V),10))",
    "alpha004": "-ts_rank(rank(L),9)",
    "alpha005": "rank(O-sum(vwap,10)/10)*-abs(rank(C-vwap))",
    "alpha006": "fin(-corr(O,V,10))",
    "alpha007": "iff(adv(20)>=V,-1,-ts_rank(abs(d(C,7)),60)*sign(d(C,7)))",
    "alpha008": "-rank(sum(O,5)*sum(R,5)-lag(sum(O,5)*sum(R,5),10))",
    "alpha009": "iff((ts_min(d(C,1),5)>0) or (ts_max(d(C,1),5)<0),d(C,1),-d(C,1))",
    "alpha010": "rank(iff((ts_min(d(C,1),4)>0) or (ts_max(d(C,1),4)<0),d(C,1),-d(C,1)))",
    "alpha011": "(rank(ts_max(vwap-C,3))+rank(ts_min(vwap-C,3)))*rank(d(V,3))",
    "alpha012": "sign(d(V,1))*-d(C,1)",
    "alpha013": "-rank(cov(rank(C),rank(V),5))",
    "alpha014": "-rank(d(R,3))*fin(corr(O,V,10))",
    "alpha015": "-sum(rank(fin(corr(rank(H),rank(V),3))),3)",
    "alpha016": "-rank(cov(rank(H),rank(V),5))",
    "alpha017": "-rank(ts_rank(C,10))*rank(d(d(C,1),1))*rank(ts_rank(V/adv(20),5))",
    "alpha018": "-rank(sd(abs(C-O),5)+(C-O)+fin(corr(C,O,10)))",
    "alpha019": "-sign(C-lag(C,7)+d(C,7))*(1+rank(1+sum(R,250)))",
    "alpha020": "-rank(O-lag(H,1))*rank(O-lag(C,1))*rank(O-lag(L,1))",
    "alpha021": "iff(avg(C,8)+sd(C,8)<avg(C,2),-1,iff(avg(C,2)<avg(C,8)-sd(C,8),1,iff(V/adv(20)>=1,1,-1.0)))",
    "alpha022": "-d(fin(corr(H,V,5)),5)*rank(sd(C,20))",
    "alpha023": "iff(avg(H,20)<H,-d(H,2),0.0)",
    "alpha024": "iff(d(avg(C,100),100)/lag(C,100)<=0.05,-(C-ts_min(C,100)),-d(C,3))",
    "alpha025": "rank(-R*adv(20)*vwap*(H-C))",
    "alpha026": "-ts_max(fin(corr(ts_rank(V,5),ts_rank(H,5),5)),3)",
    "alpha027": "iff(rank(avg(corr(rank(V),rank(vwap),6),2))<=0.5,1,iff(rank(avg(corr(rank(V),rank(vwap),6),2))>0.5,-1,rank(avg(corr(rank(V),rank(vwap),6),2))))",
    "alpha028": "scale(fin(corr(adv(20),L,5))+(H+L)/2-C)",
    "alpha029": "ts_min(product(rank(rank(scale(log(sum(ts_min(rank(rank(-rank(d(C-1,5)))),2),1))))),1),5)+ts_rank(lag(-R,6),5)",
    "alpha030": "(1.0-rank(sign(d(C,1))+sign(lag(d(C,1),1))+sign(lag(d(C,1),2))))*sum(V,5)/sum(V,20)",
    "alpha031": "rank(rank(rank(decay(-rank(rank(d(C,10))),10))))+rank(-d(C,3))+sign(scale(fin(corr(adv(20),L,12))))",
    "alpha032": "scale(avg(C,7)-C)+20*scale(corr(vwap,lag(C,5),230))",
    "alpha033": "rank(-1+O/C)",
    "alpha034": "rank(2-rank(fin(sd(R,2)/sd(R,5)))-rank(d(C,1)))",
    "alpha035": "ts_rank(V,32)*(1-ts_rank(C+H-L,16))*(1-ts_rank(R,32))",
    "alpha036": "2.21*rank(corr(C-O,lag(V,1),15))+0.7*rank(O-C)+0.73*rank(ts_rank(lag(-R,6),5))+rank(abs(corr(vwap,adv(20),6)))+0.6*rank((avg(C,200)-O)*(C-O))",
    "alpha037": "rank(corr(lag(O-C,1),C,200))+rank(O-C)",
    "alpha038": "-rank(ts_rank(C,10))*rank(fin(C/O))",
    "alpha039": "-rank(d(C,7)*(1-rank(decay(V/adv(20),9))))*(1+rank(avg(R,250)))",
    "alpha040": "-rank(sd(H,10))*corr(H,V,10)",
    "alpha041": "(H*L)^0.5-vwap",
    "alpha042": "rank(vwap-C)/rank(vwap+C)",
    "alpha043": "ts_rank(V/adv(20),20)*ts_rank(-d(C,7),8)",
    "alpha044": "fin(-corr(H,rank(V),5))",
    "alpha045": "-rank(avg(lag(C,5),20))*fin(corr(C,V,2))*rank(corr(sum(C,5),sum(C,20),2))",
    "alpha046": "iff((lag(C,20)-lag(C,10))/10-(lag(C,10)-C)/10>0.25,-1,iff((lag(C,20)-lag(C,10))/10-(lag(C,10)-C)/10<0,1,-d(C)))",
    "alpha047": "rank(1/C)*V/adv(20)*(H*rank(H-C)/avg(H,5))-rank(vwap-lag(vwap,5))",
    "alpha048": "indneu(corr(d(C,1),d(lag(C,1),1),250)*d(C,1)/C,L3)/sum((d(C,1)/lag(C,1))^2,250)",
    "alpha049": "iff((lag(C,20)-lag(C,10))/10-(lag(C,10)-C)/10<-0.1,1,-d(C))",
    "alpha050": "-ts_max(rank(corr(rank(V),rank(vwap),5)),5)",
    "alpha051": "iff((lag(C,20)-lag(C,10))/10-(lag(C,10)-C)/10<-0.05,1,-d(C))",
    "alpha052": "-d(ts_min(L,5),5)*rank((sum(R,240)-sum(R,20))/220)*ts_rank(V,5)",
    "alpha053": "-d((C-L-(H-C))/repl(C-L,0,0.0001),9)",
    "alpha054": "-(L-C)*O^5/(repl(L-H,0,-0.0001)*C^5)",
    "alpha055": "fin(-corr(rank((C-ts_min(L,12))/repl(ts_max(H,12)-ts_min(L,12),0,0.0001)),rank(V),6))",
    "alpha056": "-(rank(sum(R,10)/sum(sum(R,2),3))*rank(R*cap))",
    "alpha057": "-((C-vwap)/decay(rank(ts_argmax(C,30)),2))",
    "alpha058": "-ts_rank(decay(corr(indneu(vwap,L1),V,4),8),6)",
    "alpha059": "-ts_rank(decay(corr(indneu(vwap*0.728317+vwap*(1-0.728317),L2),V,4),16),8)",
    "alpha060": "-(2*scale(rank((C-L-(H-C))*V/repl(H-L,0,0.0001)))-scale(rank(ts_argmax(C,10))))",
    "alpha061": "rank(vwap-ts_min(vwap,16))<rank(corr(vwap,adv(180),18))",
    "alpha062": "(rank(corr(vwap,avg(adv(20),22),10))<rank(rank(O)+rank(O)<rank((H+L)/2)+rank(H)))*-1",
    "alpha063": "(rank(decay(d(indneu(C,L2),2),8))-rank(decay(corr(vwap*0.318108+O*(1-0.318108),avg(adv(180),37),14),12)))*-1",
    "alpha064": "(rank(corr(avg(O*0.178404+L*(1-0.178404),13),avg(adv(120),13),17))<rank(d((H+L)/2*0.178404+vwap*(1-0.178404),3.69741)))*-1",
    "alpha065": "(rank(corr(O*0.00817205+vwap*(1-0.00817205),avg(adv(60),9),6))<rank(O-ts_min(O,14)))*-1",
    "alpha066": "(rank(decay(d(vwap,4),7))+ts_rank(decay((L*0.96633+L*(1-0.96633)-vwap)/(O-(H+L)/2),11),7))*-1",
    "alpha067": "rank(H-ts_min(H,2))^rank(corr(indneu(vwap,L1),indneu(adv(20),L3),6))*-1",
    "alpha068": "(ts_rank(corr(rank(H),rank(adv(15)),9),14)<rank(d(C*0.518371+L*(1-0.518371),1.06157)))*-1",
    "alpha069": "rank(ts_max(d(indneu(vwap,L2),3),5))^ts_rank(corr(C*0.490655+vwap*(1-0.490655),adv(20),5),9)*-1",
    "alpha070": "rank(d(vwap,1))^ts_rank(corr(indneu(C,L2),adv(50),18),18)*-1",
    "alpha071": "emax(ts_rank(decay(corr(ts_rank(C,3),ts_rank(adv(180),12),18),4),16),ts_rank(decay(rank(L+O-(vwap+vwap))^2,16),4))",
    "alpha072": "rank(decay(corr((H+L)/2,adv(40),9),10))/rank(decay(corr(ts_rank(vwap,4),ts_rank(V,19),7),3))",
    "alpha073": "-emax(rank(decay(d(vwap,5),3)),ts_rank(decay(d(O*0.147155+L*(1-0.147155),2)/(O*0.147155+L*(1-0.147155))*-1,3),17))",
    "alpha074": "(rank(corr(C,avg(adv(30),37),15))<rank(corr(rank(H*0.0261661+vwap*(1-0.0261661)),rank(V),11)))*-1",
    "alpha075": "rank(corr(vwap,V,4))<rank(corr(rank(L),rank(adv(50)),12))",
    "alpha076": "-emax(rank(decay(d(vwap,1),12)),ts_rank(decay(ts_rank(corr(indneu(L,L1),adv(81),8),20),17),19))",
    "alpha077": "emin(rank(decay((H+L)/2+H-(vwap+H),20)),rank(decay(corr((H+L)/2,adv(40),3),6)))",
    "alpha078": "rank(corr(sum(L*0.352233+vwap*(1-0.352233),20),sum(adv(40),20),7))^rank(corr(rank(vwap),rank(V),6))",
    "alpha079": "rank(d(indneu(C*0.60733+O*(1-0.60733),L1),1))<rank(corr(ts_rank(vwap,4),ts_rank(adv(150),9),15))",
    "alpha080": "rank(sign(d(indneu(O*0.868128+H*(1-0.868128),L2),4)))^ts_rank(corr(H,adv(10),5),6)*-1",
    "alpha081": "(rank(log(product(rank(rank(corr(vwap,sum(adv(10),50),8))^4),15)))<rank(corr(rank(vwap),rank(V),5)))*-1",
    "alpha082": "-emin(rank(decay(d(O,1),15)),ts_rank(decay(corr(indneu(V,L1),O,17),7),13))",
    "alpha083": "rank(lag((H-L)/(sum(C,5)/5),2))*rank(rank(V))/((H-L)/(sum(C,5)/5)/(vwap-C))",
    "alpha084": "ts_rank(vwap-ts_max(vwap,15),21)^d(C,5)",
    "alpha085": "rank(corr(H*0.876703+C*(1-0.876703),adv(30),10))^rank(corr(ts_rank((H+L)/2,4),ts_rank(V,10),7))",
    "alpha086": "(ts_rank(corr(C,avg(adv(20),15),6),20)<rank(O+C-(vwap+O)))*-1",
    "alpha087": "-emax(rank(decay(d(C*0.369701+vwap*(1-0.369701),2),3)),ts_rank(decay(abs(corr(indneu(adv(81),L2),C,13)),5),14))",
    "alpha088": "emin(rank(decay(rank(O)+rank(L)-(rank(H)+rank(C)),8)),ts_rank(decay(corr(ts_rank(C,8),ts_rank(adv(60),21),8),7),3))",
    "alpha089": "ts_rank(decay(corr(L,adv(10),7),6),4)-ts_rank(decay(d(indneu(vwap,L2),3),10),15)",
    "alpha090": "rank(C-ts_max(C,5))^ts_rank(corr(indneu(adv(40),L3),L,5),3)*-1",
    "alpha091": "(ts_rank(decay(decay(corr(indneu(C,L2),V,10),16),4),5)-rank(decay(corr(vwap,adv(30),4),3)))*-1",
    "alpha092": "emin(ts_rank(decay((H+L)/2+C<L+O,15),19),ts_rank(decay(corr(rank(L),rank(adv(30)),8),7),7))",
    "alpha093": "ts_rank(decay(corr(indneu(vwap,L2),adv(81),17),20),8)/rank(decay(d(C*0.524434+vwap*(1-0.524434),3),16))",
    "alpha094": "rank(vwap-ts_min(vwap,12))^ts_rank(corr(ts_rank(vwap,20),ts_rank(adv(60),4),18),3)*-1",
    "alpha095": "rank(O-ts_min(O,12))<ts_rank(rank(corr(avg((H+L)/2,19),avg(adv(40),19),13))^5,12)",
    "alpha096": "-emax(ts_rank(decay(corr(rank(vwap),rank(V),4),4),8),ts_rank(decay(ts_argmax(corr(ts_rank(C,7),ts_rank(adv(60),4),4),13),14),13))",
    "alpha097": "(rank(decay(d(indneu(L*0.721001+vwap*(1-0.721001),L2),3),20))-ts_rank(decay(ts_rank(corr(ts_rank(L,8),ts_rank(adv(60),17),5),19),16),7))*-1",
    "alpha098": "rank(decay(corr(vwap,avg(adv(5),26),5),7))-rank(decay(ts_rank(ts_argmin(corr(rank(O),rank(adv(15)),21),9),7),8))",
    "alpha099": "(rank(corr(sum((H+L)/2,20),sum(adv(60),20),9))<rank(corr(L,V,6)))*-1",
    "alpha100": "-((1.5*scale(indneu(indneu(rank((C-L-(H-C))/repl(H-L,0,0.0001)*V),L3),L3))-scale(indneu(corr(C,rank(adv(20)),5)-rank(ts_argmin(C,30)),L3)))*(V/adv(20)))",
    "alpha101": "(C-O)/(H-L+0.001)",
}
