"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct K-word shingles (words: runs of bytes other than ASCII white space,
A-Z lower-cased; fewer words than K: the whole sequence as one shingle).  Two documents link when
100 * |x and y| >= PERCENT * |x or y|.

1. Equal sets are one class (size and 128 hash bits), its representative the smallest doc_id.
2. Global order: shingles by the exact number of sets that hold them, rarest first.  Each run of documents
   sends its sorted shingles, delta-coded, once to hash ranges, which count them and answer with those held
   by two sets or more; shingles of one set are first in the order and can't link anything.  A shingle that is
   frequent inside a run is sent as one count, not as a list, so no range gathers a hot shingle.
3. Prefix: of n shingles the first n - ceil(PERCENT n / 100) + 1 in the order; a pair that shares none cannot link.
   Classes with the same size and prefix are one group.
4. Groups that share a prefix shingle are filtered by size and position, first against the smallest group of the
   shingle (a star).  Groups are then expanded to members; those outside a shingle's largest component meet two members inside that
   have most links, and at last all members of other components.  Pairs pass the bounds of size, position and bitmap inside the join, once
   each at their first common shingle, and the rest is verified by exact set overlap.  Links join by distributed union-find.

Bounds of hashing: sets are told apart by their size and 128 bits; shared shingles go by 48 bits, so of two sets with m shared
shingles each a false common one is expected m * m / 2.8e14 times.

Defined results: null text or no words -> empty set, linked with nothing; repeated rows are copies; a null doc_id
takes the component of its copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared
from ._stage import components, discard, staged, table
from ._text import mix, pieces, shingles

K = 3
PERCENT = 90
WORDS = 16  # 64-bit words of a set's bitmap
SHARE = 1024  # members of a shingle that a task compares with others


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, f1, f2: set size and fingerprint."""

    def run(batches):
        for batch in batches:
            for part, data, off in pieces(batch):
                rows = [_print(s) for s in shingles(data, off, k)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[j] for r in rows], pa.int64()) for j in range(3))], ["doc_id", "n", "f1", "f2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long")


def _print(s: np.ndarray) -> tuple[int, int, int]:
    if not len(s):
        return 0, 0, 0
    m = mix(s)
    return len(s), int(m.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(m + np.uint64(0x632BE59BD9B4E019))).view(np.int64))


def shared_prefixes(docs: DataFrame, k: int, percent: int, tokens: int = 0) -> DataFrame:
    """Sets that have a shared shingle in their prefix: n, f1, f2, prefix (array), place (of its first), tokens (all shared shingles, sorted, 8 bytes each), bits (their bitmap)."""

    def kernel(data, off):
        for s in shingles(data, off, k):
            yield _print(s), s

    def finish(keys, own, tok, df):
        n, f1, f2 = keys
        at = np.searchsorted(own, np.arange(len(n) + 1))
        got = {c: [] for c in ("n", "f1", "f2", "prefix", "place", "tokens", "bits")}
        for d in range(len(n)):
            mine = tok[at[d] : at[d + 1]]
            alone = int(n[d]) - len(mine)
            left = int(n[d]) - (percent * int(n[d]) + 99) // 100 + 1 - alone
            if left > 0 and len(mine):
                bits = np.zeros(64 * WORDS, bool)
                bits[(mine % np.uint64(64 * WORDS)).astype(np.int64)] = True
                for c, v in zip(got, (n[d], f1[d], f2[d], mine[:left].astype(np.int64), alone, np.sort(mine).tobytes(), np.packbits(bits).view(np.int64)), strict=True):
                    got[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(got.items(), kinds, strict=True)})

    return shared(docs, kernel, finish, "n long, f1 long, f2 long, prefix array<long>, place long, tokens binary, bits array<long>", tokens)


def _fits(percent: int) -> str:
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _bits(percent: int) -> str:
    """Bound by bitmaps: a bit that differs is a shingle of one set alone, as are those that no other set holds (``place``)."""
    differ = " + ".join(f"bit_count(bitsa[{j}] ^ bitsb[{j}])" for j in range(WORDS))
    return f"{100 + percent} * (placea + placeb + {differ}) <= {100 - percent} * (na + nb)"


def _verify(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; ``found``: sid, n, place, bits, tokens."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            keep = np.zeros(len(na), bool)
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
                over = len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True))
                keep[i] = 100 * over >= percent * (int(na[i]) + int(nb[i]) - over)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    end = lambda x, *columns: found.select(F.col("sid").alias(x), *(F.col(c).alias(c + x) for c in columns))
    p = pairs.join(end("b", "n", "place", "bits"), "b").join(end("a", "n", "place", "bits"), "a").where(_fits(percent)).where(_bits(percent)).select("a", "b", "na", "nb")
    p = p.join(end("b", "tokens"), "b").join(end("a", "tokens"), "a").select("a", "b", "na", "tokensa", "nb", "tokensb")
    return p.mapInArrow(run, "a long, b long")


def links(docs: DataFrame, sets: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between class representatives that connect every component; ``sets`` as from sets_of."""
    rep = sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("sid"))
    found = shared_prefixes(docs, k, percent, sets.agg(F.sum("n")).first()[0] or 0).dropDuplicates(["n", "f1", "f2"])
    found = staged(found.join(rep, ["n", "f1", "f2"]).select("sid", "n", "prefix", "place", "tokens", "bits"))
    groups = found.groupBy("n", "prefix").agg(F.min("sid").alias("gid"), F.min("place").alias("place"), F.count("*").alias("size"))
    member = found.select("sid", "n", "prefix").join(groups, ["n", "prefix"]).select("gid", "sid")
    lists = groups.select("gid", "n", "size", F.posexplode("prefix").alias("at", "tok"))
    low = lists.groupBy("tok").agg(F.min(F.struct("n", "gid")).alias("low"), F.sum("size").alias("members")).where("members > 1").select("tok", F.col("low.gid").alias("low"), F.col("low.n").alias("low_n"))
    lists = staged(lists.select("gid", "n", "tok", "at").join(low, "tok"))

    star = lists.where("gid <> low").where(_fits(percent).replace("na", "n").replace("nb", "low_n")).select(F.col("low").alias("a"), F.col("gid").alias("b"))
    star = star.union(member.where("gid <> sid").select(F.col("gid").alias("a"), F.col("sid").alias("b"))).distinct()
    near = staged(_verify(star, found, percent))
    label = components(near)
    degree = near.select(F.col("a").alias("id")).union(near.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    named = member.join(label.withColumnRenamed("id", "sid"), "sid", "left").join(degree.withColumnRenamed("id", "sid"), "sid", "left")
    named = staged(named.select("gid", "sid", F.coalesce("root", "sid").alias("c"), F.coalesce("d", F.lit(0)).alias("d")), done=(label,))

    def open_(named: DataFrame) -> DataFrame:
        """(tok, at, m, sid, c, d, main) of the shingles whose m members are of several components; main: the component with most of them."""
        rows = lists.select("tok", "gid", "at").join(named, "gid")
        main = rows.groupBy("tok", "c").agg(F.count("*").alias("s")).groupBy("tok").agg(F.max_by("c", "s").alias("main"), F.sum("s").alias("m"), F.count("*").alias("parts"))
        return rows.join(main.where("parts > 1").select("tok", "main", "m"), "tok")

    # a second star: members outside a shingle's largest component against two members inside that have most links
    rows = open_(named)
    centre = rows.where("c = main").groupBy("tok", F.pmod(F.hash("sid"), F.lit(2)).alias("half")).agg(F.max_by("sid", "d").alias("a"))
    pairs = rows.where("c <> main").select("tok", F.col("sid").alias("b")).join(centre, "tok").select("a", "b").distinct()
    more = staged(_verify(pairs, found, percent))
    c = lambda x: named.select(F.col("sid").alias(x), F.col("c").alias("c" + x))
    label = components(more.join(c("a"), "a").join(c("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    named = staged(named.join(label.withColumnRenamed("id", "c"), "c", "left").select("gid", "sid", F.coalesce("root", "c").alias("c"), "d"), done=(named, label))

    rows = open_(named).select("tok", "at", "m", "sid", "c", "main").join(found.select("sid", "n", "place", "bits", "prefix"), "sid")
    rows = rows.withColumn("pre", F.slice("prefix", 1, F.col("at"))).withColumn("deal", F.ceil(F.col("m") / SHARE).cast("int")).drop("prefix")
    side = lambda d, x: d.select("tok", "share", *(F.col(y).alias(y + x) for y in ("at", "sid", "c", "n", "place", "bits", "pre")), *(["main"] if x == "a" else []))
    minor = side(rows.where("c <> main").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("deal") - 1))), "a")
    rest = side(rows.withColumn("share", F.pmod(F.hash("sid"), F.col("deal"))), "b").withColumnRenamed("tok", "tokb").withColumnRenamed("share", "shareb")
    place = f"{100 + percent} * (least(ata, atb) + 1 + least(na - placea - ata - 1, nb - placeb - atb - 1)) >= {percent} * (na + nb)"
    tests = ["tok = tokb", "share = shareb", "ca <> cb", "(cb = main or ca < cb)", _fits(percent), place, _bits(percent), "not arrays_overlap(prea, preb)"]
    pairs = minor.join(rest, F.expr(" and ".join(tests))).select(F.col("sida").alias("a"), F.col("sidb").alias("b")).distinct()
    last = staged(_verify(pairs, found, percent), done=(lists, named))
    return staged(near.union(more).union(last), done=(near, more, last, found))


def join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text, …) -> one row a document: doc_id, n_shingles, component_id (smallest doc_id reachable)."""
    docs = docs.select("doc_id", "text")
    sets = staged(sets_of(docs, k))
    found = links(docs, sets, k, percent)
    label = components(found)
    discard(found)
    rep = sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("sid"))
    rep = rep.join(label, rep["sid"] == label["id"], "left").select("n", "f1", "f2", F.coalesce("root", "sid").alias("root"))
    return sets.join(rep, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def one_each(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest doc_id."""
    gone = join(docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("_d")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_d"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
