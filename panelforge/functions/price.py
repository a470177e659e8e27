"""Price and volume factors as expressions over the dense panel.

``ma psd pvar rsum rmean rmax rmin rcorr rskew rkurt mad`` need a full window (population moments, bias-corrected
skew and kurtosis); ``ema`` and ``wilder`` are recursive means with a first-value seed that need ``n`` values.
"""

from __future__ import annotations

# Shared terms.
DEFS = {
    "turn": "100*V/(cap/C)",
    "pre": "lag(C,1)",
    "up": "pre*1.1",
    "down": "pre*0.9",
    "tp": "(H+L+C)/3",
    "wvad": "rsum(iff(H-L>0,(C-O)/(H-L)*V,null),6)",
    "tr": "greatest3(H-L,abs(H-pre),abs(L-pre))",
    "rsv": "100*(C-rmin(L,9))/(rmax(H,9)-rmin(L,9))",
    "kdj_k": "ema(rsv,5)",
    "dif": "ema(V,12)-ema(V,26)",
    "hd": "H-lag(H,1)",
    "ld": "lag(L,1)-L",
    "di1": "100*rsum(iff(hd>0 and hd>ld,hd,0),14)/rsum(tr,14)",
    "di2": "100*rsum(iff(ld>0 and ld>hd,ld,0),14)/rsum(tr,14)",
    "mid": "lag((H+L)/2,1)",
    "tpup": "rsum(iff(tp>lag(tp,1),tp*V,0),14)",
    "tpdn": "rsum(iff(tp<lag(tp,1),tp*V,0),14)",
    "gain": "max2(C-pre,0)+(C-pre)*0",
    "loss": "max2(pre-C,0)+(C-pre)*0",
}

# Factor names and their definitions.
EMOTION = {
    "emotion_DAVOL20": "ma(turn,20)/ma(turn,120)",
    "emotion_AR": "100*rsum(H-O,26)/rsum(O-L,26)",
    "emotion_ARBR": "100*rsum(H-O,26)/rsum(O-L,26)-100*rsum(H-pre,26)/rsum(pre-L,26)",
    "emotion_VROC12": "100*(V-lag(V,12))/lag(V,12)",
    "emotion_WVAD": "wvad",
    "emotion_PSY": "100*rmean(iff(notnull(C) and notnull(pre),1,null)*(C>pre),12)",
    "emotion_turnover_volatility": "psd(turn,20)",
    "emotion_money_flow_20": "rsum(tp*V,20)",
    "emotion_VMACD": "dif-ema(dif,9)",
    "emotion_VOSC": "100*(ema(V,12)-ema(V,26))/ema(V,12)",
    "emotion_MAWVAD": "ma(wvad,6)",
    "emotion_VSTD10": "psd(V,10)",
    "emotion_VROC6": "100*(V-lag(V,6))/lag(V,6)",
    "emotion_OBOS": "rsum(xsum(sign(C-pre)),10)",
}
MOMENTUM = {
    "momentum_BIAS5": "100*(C-ma(C,5))/ma(C,5)",
    "momentum_CCI20": "(tp-ma(tp,20))/(0.015*mad(tp,20))",
    "momentum_arron_up_25": "100*(25-age_max(H,25))/25",
    "momentum_arron_down_25": "100*(25-age_min(L,25))/25",
    "momentum_BIAS60": "100*(C-ma(C,60))/ma(C,60)",
    "momentum_MASS": "rsum(ema(H-L,9)/ema(ema(H-L,9),9),25)",
    "momentum_ROC120": "100*(C-lag(C,120))/lag(C,120)",
    "momentum_single_day_VPT": "R*V",
    "momentum_single_day_VPT_6": "ma(R*V,6)",
    "momentum_single_day_VPT_12": "ma(R*V,12)",
}
RISK = {
    "risk_Variance20": "pvar(R,20)*252",
    "risk_Skewness20": "rskew(R,20)",
    "risk_Skewness60": "rskew(R,60)",
    "risk_Kurtosis20": "rkurt(R,20)",
    "risk_sharpe_ratio_20": "(252*rmean(R,20)-0.04)/(psd(R,20)*sqrt(252))",
    "risk_sharpe_ratio_60": "(252*rmean(R,60)-0.04)/(psd(R,60)*sqrt(252))",
    "risk_Kurtosis60": "rkurt(R,60)",
    "risk_Skewness120": "rskew(R,120)",
    "risk_Kurtosis120": "rkurt(R,120)",
}
SHORT = {
    "short_overnight": "O/pre-1",
    "short_intraday": "C/O-1",
    "short_ret1": "R",
    "short_ret5": "C/lag(C,5)-1",
    "short_ret10": "C/lag(C,10)-1",
    "short_amihud5": "rmean(iff(A>0,abs(R)/A,null),5)*1000000",
    "short_amihud20": "rmean(iff(A>0,abs(R)/A,null),20)*1000000",
    "short_vol5": "ma(turn,5)",
    "short_davol5": "ma(turn,5)/ma(turn,20)",
    "short_range5": "rmean((H-L)/C,5)",
    "short_efficiency": "abs(C-O)/iff(H-L>0,H-L,null)",
    "short_upper_shadow": "(H-emax(O,C))/C",
    "short_lower_shadow": "(emin(O,C)-L)/C",
    "short_close_loc": "(C-L)/iff(H-L>0,H-L,null)",
    "short_limit_up_dist": "(up-C)/pre",
    "short_limit_dn_dist": "(C-down)/pre",
    "short_maxret20": "rmax(R,20)",
    "short_minret20": "rmin(R,20)",
    "short_corr_pv5": "rcorr(R,V,5)",
    "short_corr_pv20": "rcorr(R,V,20)",
    "short_vwap_dev": "iff(V>0 and A>0,C/(A/V)-1,null)",
    "short_rsi6": "100-100/(1+wilder(gain,6)/wilder(loss,6))",
    "short_rsi14": "100-100/(1+wilder(gain,14)/wilder(loss,14))",
    "short_willr14": "-100*(rmax(H,14)-C)/iff(rmax(H,14)-rmin(L,14)>0,rmax(H,14)-rmin(L,14),null)",
    "short_down_vol_ratio20": "rsum(iff(C<pre,V,0),20)/iff(rsum(V,20)>0,rsum(V,20),null)",
    "short_amt_to_mv": "iff(cap>0,A/cap,null)",
    "short_atr5": "ma(tr,5)",
    "short_jump5": "rmean(abs(O/pre-1),5)",
}
TECHNICAL = {
    "technical_MAC20": "ma(C,20)/C",
    "technical_MAC60": "ma(C,60)/C",
    "technical_boll_up": "(ma(C,20)+2*psd(C,20))/C",
    "technical_boll_down": "(ma(C,20)-2*psd(C,20))/C",
    "technical_EMA5": "ema(C,5)/C",
    "technical_KDJ_J": "3*kdj_k-2*ema(kdj_k,5)",
    "technical_ADX": "ma(100*abs(di1-di2)/(di1+di2),6)",
    "technical_OBV": "iff(notnull(C),cumsum(V*sign(C-pre)),null)",
    "technical_MDD60": "mdd(C,60)",
    "technical_MCST": "dma(A/V,turn/100)",
    "technical_CR": "100*rsum(max2(H-mid,0)+(H-mid)*0,26)/iff(rsum(max2(mid-L,0)+(mid-L)*0,26)>0,rsum(max2(mid-L,0)+(mid-L)*0,26),null)",
    "technical_VOLT20": "psd(C,20)",
}
# Further definitions that have no factor class of their own.
EXTRA = {
    "vol20": "ma(turn,20)", "vol60": "ma(turn,60)",
    "vr": "(rsum(iff(C>pre,V,0),26)+0.5*rsum(iff(C==pre,V,0),26))/(rsum(iff(C<pre,V,0),26)+0.5*rsum(iff(C==pre,V,0),26))",
    "br": "100*rsum(H-pre,26)/rsum(pre-L,26)", "vstd20": "psd(V,20)", "atr14": "ma(tr,14)", "variance5": "pvar(R,5)*252", "variance60": "pvar(R,60)*252",
    "mac5": "ma(C,5)/C", "mac10": "ma(C,10)/C", "emac12": "ema(C,12)/C", "emac26": "ema(C,26)/C", "macdc": "(ema(C,12)-ema(C,26))/C",
    "mfi14": "100-100/(1+tpup/tpdn)", "bias10": "100*(C-ma(C,10))/ma(C,10)", "bias20": "100*(C-ma(C,20))/ma(C,20)",
    "roc5": "100*(C-lag(C,5))/lag(C,5)", "roc20": "100*(C-lag(C,20))/lag(C,20)", "roc60": "100*(C-lag(C,60))/lag(C,60)",
    "cci10": "(tp-ma(tp,10))/(0.015*mad(tp,10))", "cci15": "(tp-ma(tp,15))/(0.015*mad(tp,15))", "cci88": "(tp-ma(tp,88))/(0.015*mad(tp,88))",
    "price1m": "C/ma(C,21)-1", "price3m": "C/ma(C,61)-1", "price1y": "C/ma(C,250)-1",
    "plrc6": "slope(C/ma(C,6),6)", "plrc12": "slope(C/ma(C,12),12)", "plrc24": "slope(C/ma(C,24),24)",
    "trix5": "100*d(ema(ema(ema(C,5),5),5),1)/lag(ema(ema(ema(C,5),5),5),1)", "trix10": "100*d(ema(ema(ema(C,10),10),10),1)/lag(ema(ema(ema(C,10),10),10),1)",
    "bbic": "(ma(C,3)+ma(C,6)+ma(C,12)+ma(C,24))/4/C", "bull_power": "(H-ema(C,13))/C", "bear_power": "(L-ema(C,13))/C",
    "close_rank_1y": "iff(notnull(rmean(C,250)),1-(ts_rank(C,250)-1)/250,null)", "volume1m": "V/rmean(lag(V,1),20)*rmean(lag(R,1),20)",
    "vol10": "ma(turn,10)", "vol120": "ma(turn,120)", "vol240": "ma(turn,240)", "davol5_120": "ma(turn,5)/ma(turn,120)", "davol10": "ma(turn,10)/ma(turn,120)",
    "tvma6": "ma(A,6)", "tvma20": "ma(A,20)", "tvstd6": "psd(A,6)", "tvstd20": "psd(A,20)", "vema5": "ema(V,5)", "vema10": "ema(V,10)", "vema12": "ema(V,12)", "vema26": "ema(V,26)",
    "vdiff": "dif", "vdea": "ema(dif,9)", "atr6": "ma(tr,6)", "variance120": "pvar(R,120)*252", "sharpe120": "(252*rmean(R,120)-0.04)/(psd(R,120)*sqrt(252))",
    "emac10": "ema(C,10)/C", "emac20": "ema(C,20)/C", "emac120": "ema(C,120)/C", "mac120": "ma(C,120)/C", "roc6": "100*(C-lag(C,6))/lag(C,6)", "roc12": "100*(C-lag(C,12))/lag(C,12)",
    "cr20": "100*rsum(max2(H-(lag(H,1)+lag(L,1))/2,0)+(H-lag(H,1))*0,20)/rsum(max2((lag(H,1)+lag(L,1))/2-L,0)+(H-lag(H,1))*0,20)",
    "rank1m": "rank_desc(C/lag(C,20)-1)", "circ_cap": "cap",
}
# Factors on trailing rows outside the families above.
CANDIDATE = {
    "pv_ratio": "sign(C-pre)*V/rsum(lag(V,1),10)",
    "vol_rel_ma5": "-rmean(V,3)/rmean(lag(V,3),20)*sinh(1.5*(2*(C-rmin(L,60))/(rmax(H,60)-rmin(L,60))-1))",
    "low_deposit": "rmedian(C,24)/dma((coalesce(O,C)+coalesce(H,C)+coalesce(L,C)+C)/4,min2(turn/100,0.95))",
    "holding_ret": "C/dma((coalesce(O,C)+coalesce(H,C)+coalesce(L,C)+C)/4,min2(turn/100,0.95))-1",
}
# Style descriptors and their weights; windows in sessions of the panel (months here).
STYLE = {
    "style_size": "log(cap)",
    "style_momentum": "rsum(lag(log(1+R),1),11)",
    "style_liquidity": "0.35*log(turn)+0.35*log(rmean(turn,3))+0.30*log(rmean(turn,12))",
    "style_dastd": "psd(R,12)",
    "style_cmra": "rmax(rsum(log(1+R),1),12)-rmin(rsum(log(1+R),1),12)",
    "style_leverage_market": "1+log(cap)/log(A)",
}
FAMILIES = {"emotion": EMOTION, "momentum": MOMENTUM, "risk": RISK, "short": SHORT, "technical": TECHNICAL, "extra": EXTRA, "candidate": CANDIDATE, "style": STYLE}
