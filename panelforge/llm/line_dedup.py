"""Line dedup by MinHash, DataFrame operations only.

Lines (split at line feeds) are sets of shingles of K characters (UTF-16 units).  Two lines are near when the Jaccard
similarity of their sets is at least SIMILARITY; of each connected component the line with the
smallest (doc_id, line number) stays.  Blank lines always stay.

1. Equal lines are one line (128 hash bits), with no list of its places.
2. MinHash: a shingle's hash XOR each of HASHES masks is hashed again; three disjoint ranges of the result's bits are three
   independent orders, and the minimum of an order over the line is one signature value.  BANDS bands of ROWS values are the
   keys: a pair at similarity 0.8 meets in at least one with probability 0.997, however short its lines are.
3. Lines that share a key: each is first compared with the least line of the key (a star, not all pairs),
   exactly, and linked by distributed union-find.  In a key that still holds lines of several components, the lines outside its
   largest one are compared with two lines inside that have most links, then with all lines of other components, inside the join,
   which puts out true links only; bitmaps of the shingle hashes refute nearly all other pairs (an exact bound), and a key of many
   lines is dealt over several tasks.  So no pair that meets in a band goes unseen.
4. Union-find over all links, and one line is kept per component.

Defined results: null text is empty; empty and blank lines are kept; lines of fewer than K characters
are one shingle; rows with the same doc_id and text are treated alike; a row without doc_id comes after all others, so it
never takes a line from one that has an id; a document from which every non-blank line went keeps its row with the blank lines that
are left (``dedup``) or goes (``drop_empty``).  Other columns of the input are kept as they are.

Lines are told apart by 128 hash bits; near links go by 64, so two different lines that both have near lines and the same
64 bits would be one (expected once for 6e9 such lines).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import components, staged, table

K = 8
BANDS, ROWS = 8, 3
HASHES = BANDS  # each gives three orders
SIMILARITY = 0.8
CHUNK = 4096  # characters of a line whose shingles are listed at once
PACK = 2  # shingles of a row
WORDS = 16  # 64-bit words of a line's bitmap
SHARE = 1024  # lines of a key that a task compares with others


def lines_of(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, rk, line_no, line, h1, h2; without blank lines."""
    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("rk"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.where(F.trim("line") != "").withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("line"), "line"))


def _shingles(line: Column) -> Column:
    """Shingle hashes of one line in order, for the exact comparison."""
    at = lambda b: F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(b) - 2 * K + 1), F.lit(2))
    # the outer transform binds the encoded line, which would else be encoded anew for every shingle
    one = F.transform(F.array(F.encode(line, "UTF-16BE")), lambda b: F.transform(at(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(2 * K)))))
    return F.element_at(one, 1)


def _mask(j: int) -> Column:
    x = (0x9E3779B97F4A7C15 * (2 * j + 1)) % (1 << 64)
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) % (1 << 64)
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def bands(unique: DataFrame) -> DataFrame:
    """unique(id, line) -> id, key: one row a band."""
    b = unique.select("id", F.encode("line", "UTF-16BE").alias("b"))
    n = F.greatest(F.lit(1), F.floor(F.octet_length("b") / 2).cast("int") - K + 1)
    b = b.select("id", "b", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).alias("c"))
    b = b.select("id", F.substring("b", F.col("c") * (2 * CHUNK) + 1, F.lit(2 * (CHUNK + K - 1))).alias("b"))
    last = F.greatest(F.lit(1), F.octet_length("b") - 2 * K + 1)
    b = b.select("id", "b", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(2 * PACK))).alias("i"))
    # a row has PACK shingles (past the end the last one again), so that the aggregate is reached less often
    b = b.select("id", *(F.xxhash64(F.substring("b", F.least(F.col("i") + 2 * p, "last"), F.lit(2 * K))).alias(f"s{p}") for p in range(PACK)))
    b = b.select("id", *(F.xxhash64(F.col(f"s{p}").bitwiseXOR(_mask(j))).alias(f"x{j}_{p}") for j in range(HASHES) for p in range(PACK)))
    sig = b.groupBy("id").agg(*(F.min(F.least(*(F.shiftleft(f"x{j}_{p}", 21 * part) for p in range(PACK)))).alias(f"m{3 * j + part}") for j in range(HASHES) for part in range(3)))
    keys = F.array(*(F.xxhash64(F.lit(b), *(F.col(f"m{b * ROWS + r}") for r in range(ROWS))) for b in range(BANDS)))
    return sig.select("id", F.explode(keys).alias("key"))


def _fit(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9


def _bits(a: str, b: str, similarity: float) -> Column:
    """Bound by bitmaps: every bit that differs is a shingle of one set alone, so near sets have few."""
    differ = reduce(add, (F.bit_count(F.col(f"w{j}{a}").bitwiseXOR(F.col(f"w{j}{b}"))) for j in range(WORDS)))
    return differ * (1 + similarity) <= (F.col(f"n{a}") + F.col(f"n{b}")) * (1 - similarity) + 1e-9


def _near(a: str, b: str, similarity: float) -> Column:
    """Exact test of the shingles of two lines (``array_intersect`` takes each once)."""
    return F.size(F.array_intersect(_shingles(F.col(f"line{a}")), _shingles(F.col(f"line{b}")))) * (1 + similarity) + 1e-9 >= (F.col(f"n{a}") + F.col(f"n{b}")) * similarity


def candidates(docs: DataFrame) -> DataFrame:
    """(id, h2, line, keys) of the lines that share a band with another one; keys: (key, low, m) with the least id and the lines of the key."""
    unique = lines_of(docs).groupBy(F.col("h1").alias("id")).agg(F.first(F.struct("h2", "line")).alias("v")).select("id", "v.h2", "v.line")
    member = bands(unique).repartition("key")  # one exchange for both uses
    least = member.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("m")).where("m > 1")
    keys = member.join(least, "key").groupBy("id").agg(F.collect_list(F.struct("key", "low", "m")).alias("keys"))  # BANDS at most
    return unique.join(keys, "id").select("id", "h2", "line", "keys")


def sketched(lines: DataFrame) -> DataFrame:
    """``lines`` with n, the number of distinct shingles, and w0, w1, …: a bitmap of their hashes."""
    s = lines.select("id", F.explode(F.array_distinct(_shingles(F.col("line")))).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    word = F.expr(f"shiftrightunsigned(h, 6) & {WORDS - 1}")
    return lines.join(s.groupBy("id").agg(F.count("*").alias("n"), *(F.bit_or(F.when(word == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{j}") for j in range(WORDS))), "id")


def _relabel(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named`` with the components that ``links`` (a, b: components) join."""
    joined = components(links)
    out = named.join(joined.withColumnRenamed("id", "c"), "c", "left").withColumn("c", F.coalesce("root", "c")).select(*named.columns)
    return staged(out, done=(named, joined))


def _open(named: DataFrame) -> DataFrame:
    """(key, low, m, id, c, d, main) of the keys that hold lines of several components; main: the component with most of a key's lines."""
    places = named.select("id", "c", "d", F.explode("keys").alias("k")).select("id", "c", "d", "k.*")
    main = places.groupBy("key", "c").agg(F.count("*").alias("s")).groupBy("key").agg(F.max_by("c", "s").alias("main"), F.count("*").alias("parts"))
    return places.join(main.where("parts > 1").select("key", "main"), "key")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(h1, h2, root) of the lines that have a near line."""
    lines = staged(candidates(docs))
    lines = staged(sketched(lines), done=(lines,))
    words = [f"w{j}" for j in range(WORDS)]
    end = lambda t, s: t.select(*(F.col(c).alias(c + s) for c in ("id", "n", "line", "c", *words) if c in t.columns))

    def verified(pairs: DataFrame, t: DataFrame) -> DataFrame:
        """Of the pairs (ida, idb) of ``t`` the near ones."""
        p = pairs.join(end(t, "a"), "ida").join(end(t, "b"), "idb")
        return p.where(_fit("na", "nb", similarity) & _bits("a", "b", similarity) & _near("a", "b", similarity))

    # the star of each key: its least line against all others
    spoke = lines.select(F.col("id").alias("idb"), F.explode(F.array_distinct(F.transform("keys", lambda k: k["low"]))).alias("ida")).where("ida <> idb")
    near = staged(verified(spoke, lines).select(F.col("ida").alias("a"), F.col("idb").alias("b")))
    found = components(near)
    degree = near.select(F.col("a").alias("id")).union(near.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    named = lines.join(found, "id", "left").join(degree, "id", "left").select(*lines.columns, F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("root", "id").alias("c"))
    named = staged(named, done=(lines, found, near))
    # a second star: the lines outside a key's largest component against two lines inside that have most links
    places = _open(named)
    centre = places.where("c = main and id <> low").groupBy("key", F.pmod(F.hash("id"), F.lit(2)).alias("half")).agg(F.max_by("id", "d").alias("ida"))
    pairs = places.where("c <> main").select("key", F.col("id").alias("idb")).join(centre, "key").select("ida", "idb").distinct()
    named = _relabel(named, verified(pairs, named).select(F.col("ca").alias("a"), F.col("cb").alias("b")))

    open_ = _open(named).groupBy("id").agg(F.collect_list(F.struct("key", "low", "m", "main")).alias("open"))
    rows = named.join(open_, "id").select("id", "line", "n", "c", *words, F.transform("open", lambda k: k["key"]).alias("keys"), F.explode("open").alias("k")).select("id", "line", "n", "c", "keys", *words, "k.*").withColumn("deal", F.ceil(F.col("m") / SHARE).cast("int"))

    def side(rows: DataFrame, s: str) -> DataFrame:
        d = rows.select("key", "share", "main", "low", *(F.col(c).alias(c + s) for c in ("id", "n", "c", "line", "keys", *words)))
        return d if s == "a" else d.drop("main", "low")

    minor = side(rows.where("c <> main").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("deal") - 1))), "a")
    rest = side(rows.withColumn("share", F.pmod(F.hash("id"), F.col("deal"))), "b")
    apart = (minor["ca"] != rest["cb"]) & ((rest["cb"] == minor["main"]) | (minor["ca"] < rest["cb"])) & (minor["ida"] != minor["low"]) & (rest["idb"] != minor["low"])
    same = (minor["key"] == rest["key"]) & (minor["share"] == rest["share"])
    once = F.array_min(F.array_intersect("keysa", "keysb")) == minor["key"]  # a pair is tested in its first common key
    more = minor.join(rest, same & apart & _fit("na", "nb", similarity) & _bits("a", "b", similarity) & once & _near("a", "b", similarity)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    named = _relabel(named, more)
    single = named.groupBy(F.col("c").alias("root")).agg(F.count("*").alias("n")).where("n > 1").select("root")
    return staged(named.select(F.col("id").alias("h1"), "h2", F.col("c").alias("root")).join(single, "root").select("h1", "h2", "root"), done=(named,))


def firsts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(h1, h2, first) of the lines that occur more than once or have a near line; ``first`` is the place that stays (doc_id, then line_no; no id comes last)."""
    root = classes(docs, similarity)
    lines = lines_of(docs).select("h1", "h2", _place().alias("place")).groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    lines = staged(lines.join(root, ["h1", "h2"], "left").where("n > 1 or root is not null").select("h1", "h2", "place", "root"), done=(root,))
    least = lines.where("root is not null").groupBy("root").agg(F.min("place").alias("first"))
    linked = lines.join(least, "root").select("h1", "h2", "first")
    return lines.where("root is null").select("h1", "h2", F.col("place").alias("first")).union(linked)


def _place() -> Column:
    """(doc_id, line_no) as one number, so that its minimum is a hash aggregate."""
    return F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")


def removed(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, rk, line_no) of the lines that go."""
    lines = lines_of(docs).select("doc_id", "rk", "line_no", "h1", "h2", _place().alias("place"))
    return lines.join(firsts(docs, similarity), ["h1", "h2"]).where("place <> first").select("doc_id", "rk", "line_no")


def dedup(docs: DataFrame, similarity: float = SIMILARITY, drop_empty: bool = False) -> DataFrame:
    """The rows of ``docs`` with the repeated lines taken out of ``text``, and n_lines, n_removed (blank lines count as lines)."""
    gone = removed(docs, similarity).groupBy("doc_id", "rk").agg(F.collect_set("line_no").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("rk").alias("_k"), F.sort_array("gone").alias("_g"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d = docs.select(*columns, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_rk"))
    d = d.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_rk") == F.col("_k")), "left")
    parts = F.split("text", "\n")
    # the runs between removed lines: slices, so the work is linear in the lines
    g = F.concat(F.array(F.lit(-1)), "_g", F.array(F.size(parts)))
    runs = F.transform(F.sequence(F.lit(1), F.size(g) - 1), lambda i: F.slice(F.col("_p"), F.element_at("_b", i) + 2, F.element_at("_b", i + 1) - F.element_at("_b", i) - 1))
    d = d.withColumn("_p", parts).withColumn("_b", g)
    left = F.array_join(F.flatten(runs), "\n")
    n = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size("_p")).cast("long")
    out = d.select(*(F.when(F.col("_g").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(c) for c in columns), n.alias("n_lines"), F.coalesce(F.size("_g"), F.lit(0)).cast("long").alias("n_removed"))
    return out.where(~((F.col("n_removed") > 0) & (F.trim(F.replace("text", F.lit("\n"), F.lit(""))) == ""))) if drop_empty else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
