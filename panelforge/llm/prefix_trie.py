"""Prefix trie of conversations with subtree sums by pointer jumping.

A node is a distinct sequence of first turns.  Its key is a digest: the sums, in four lanes of 32 bits, of SHA-256 over (place,
turn).  Such sums add up over the parts of a conversation, so no task needs a conversation whole: turns are sorted into
ranges, each range counts and sums its own part, and the parts' totals (one row a conversation and range) say where a part begins.

Every node has an edge to the key of its parent.  A round adds to each node what the nodes pointing at it have gathered and
then lets every node point where its target points; round k so covers the descendants less than 2^(k+1) levels below, and
log2(depth) rounds cover all.  The sums combine before they are shuffled; targets of more than a thousandth of the nodes (so a thousand
at most) are met in SALT copies, so a common first turn is no hot key.

Order of turns: ``turn`` (null first), then role, then text; null role or text is empty, repeated rows are turns of their own.
Rows without conv_id take no part; an empty table gives no node; other columns are ignored.  A node's list of ended
conversations is hashed as a sorted stream, one conv_id at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import staged, table

ID, UP = ["depth", "k1", "k2"], ["jd", "j1", "j2"]
LANES = ["s1", "s2", "s3", "s4"]
HEAVY = 2000  # nodes that point at one, at least, before it is met in salted copies
SALT = 32
MODULUS, SHARED = 9, 5  # of the rebuilding rule


def turns_in_place(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, turn, role, text) -> staged rows (conv_id, part, seq, digest, bytes) and parts (conv_id, part, first, n, before)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = staged(t.select("conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("seq")))
    path, rows = rows.staged_path, rows.withColumn("part", F.shiftright("seq", 33))
    rows.staged_path = path
    parts = rows.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, parts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations with the opening of another one: (rows, conversations, staged input).

    rows(c, part, pos, digest, bytes, total); conversations(c, total), the turnless ones included.
    """
    rows, parts = turns_in_place(turns)
    own = parts.groupBy("conv_id").agg(F.sum("n").alias("length"))
    own = own.select(F.col("conv_id").alias("c"), "length", (F.crc32(F.col("conv_id").cast("string")) % MODULUS).alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"))
    lengths = own.select(F.col("c").alias("base"), F.col("length").alias("there"))
    convs = own.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = convs.withColumn("total", F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0)))
    placed = parts.join(convs, F.col("conv_id") == F.col("c"))
    place = F.col("seq") - F.col("first") + F.col("before")
    placed = rows.join(placed.select("conv_id", "part", "first", "before", "h", "taken", "total"), ["conv_id", "part"]).withColumn("at", place)
    after = placed.where("at >= h").select(F.col("conv_id").alias("c"), "part", (F.col("at") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes", "total")
    opening = placed.where(F.col("at") < MODULUS - 1).select(F.col("conv_id").alias("base"), "at", "digest", "bytes")
    opening = opening.join(convs.select("c", "base", "h", "total"), "base").where("at < h").select("c", F.lit(-1).cast("long").alias("part"), F.col("at").alias("pos"), "digest", "bytes", "total")
    return after.unionByName(opening), convs.select("c", "total"), rows


def _key(cols: list[Column]) -> list[Column]:
    """Two longs from four sums."""
    low = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1))
    return [F.shiftleft(low(cols[i], 31), 32).bitwiseOR(low(cols[i + 1], 32)) for i in (0, 2)]


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, depth, k1, k2, jd, j1, j2, bytes, ends): the node of every prefix of every conversation and its parent's key; the root has none."""
    hexed = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), "digest"), 256)
    r = rows.withColumn("hex", hexed).select("c", "part", "pos", "bytes", "total", *(F.conv(F.substring("hex", 8 * k + 1, 8), 16, 10).cast("long").alias(f"v{k + 1}") for k in range(4)))
    values = [f"v{k}" for k in range(1, 5)]
    before = r.groupBy("c", "part").agg(*(F.sum(v).alias(v) for v in values))
    w = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("c", "part", *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"o{v}") for v in values))
    run = Window.partitionBy("c", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    r = r.join(before, ["c", "part"]).select("c", "pos", "bytes", "total", *values, *((F.sum(v).over(run) + F.col(f"o{v}")).alias(s) for v, s in zip(values, LANES, strict=True)))
    k = _key([F.col(s) for s in LANES])
    j = _key([F.col(s) - F.col(v) for s, v in zip(LANES, values, strict=True)])
    r = r.select("c", (F.col("pos") + 1).alias("depth"), k[0].alias("k1"), k[1].alias("k2"), F.col("pos").alias("jd"), j[0].alias("j1"), j[1].alias("j2"), "bytes", (F.col("pos") + 1 == F.col("total")).alias("ends"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("c", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), *(none.alias(x) for x in UP), zero.alias("bytes"), (F.col("total") == 0).alias("ends"))
    return r.unionByName(root)


def ended(members: DataFrame) -> DataFrame:
    """(depth, k1, k2, c) -> (depth, k1, k2, ends_sha256): the sorted ids of a node as one stream."""

    def stream(batches):
        key, digest = None, None
        names = [*ID, "ends_sha256"]

        def close():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([digest.hexdigest()])], names)

        for b in batches:
            for *here, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if here == key:
                    digest.update(b",%d" % c)
                    continue
                if key:
                    yield close()
                key, digest = here, hashlib.sha256(b"%d" % c)
        if key:
            yield close()

    return members.select(*ID, "c").repartition(*ID).sortWithinPartitions(*ID, "c").mapInArrow(stream, "depth long, k1 long, k2 long, ends_sha256 string")


def follow(nodes: DataFrame, heavy: list[int], take: dict[str, str]) -> DataFrame:
    """``nodes`` with columns of the node each one points at; the targets whose key hashes to one of ``heavy`` are met in salted copies."""
    dealt = lambda cols, salt: F.when(F.xxhash64(*cols).isin(heavy), salt).otherwise(F.lit(0)) if heavy else F.lit(0)
    copies = F.when(F.xxhash64(*ID).isin(heavy), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))) if heavy else F.array(F.lit(0))
    target = nodes.select(*(F.col(a).alias(b) for a, b in zip(ID, UP, strict=True)), *(F.col(a).alias(b) for a, b in take.items()), F.explode(copies).alias("salt"))
    asking = nodes.withColumn("salt", dealt(UP, F.pmod(F.xxhash64(*ID), F.lit(SALT)).cast("int")))
    return asking.join(target, [*UP, "salt"], "left").drop("salt")


def gathered(nodes: DataFrame, sums: list[str], limit: int) -> tuple[DataFrame, list[int]]:
    """What the nodes pointing at a node hold (staged: depth, k1, k2, many, more_...), and the hashed keys of those pointed at by more than ``limit``."""
    got = nodes.where("j1 is not null").groupBy(*UP).agg(F.count("*").alias("many"), *(F.sum(s).alias(f"more_{s}") for s in sums))
    got = staged(got.select(*(F.col(a).alias(b) for a, b in zip(UP, ID, strict=True)), "many", *(f"more_{s}" for s in sums)))
    return got, [r[0] for r in got.where(F.col("many") > limit).select(F.xxhash64(*ID)).collect()]


def roll_up(nodes: DataFrame, sums: list[str], size: int, deepest: int) -> DataFrame:
    """Staged nodes(depth, k1, k2, jd, j1, j2, conv_id, ...) -> ``sums`` added over every node's subtree in rounds that double their reach; parent_conv_id."""
    limit, reach = max(HEAVY, size // 1000), 1
    inputs, nodes = (nodes,), nodes.withColumn("parent_conv_id", F.lit(None).cast("long"))
    while reach <= deepest:
        got, heavy = gathered(nodes, sums, limit)
        take = {"jd": "nd", "j1": "n1", "j2": "n2"} | ({"conv_id": "above"} if reach == 1 else {})
        out = follow(nodes, heavy, take)
        if reach == 1:
            out = out.withColumn("parent_conv_id", F.col("above"))
        out = out.join(got, ID, "left")
        added = {s: (F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums}
        moved = {a: F.col(b).alias(a) for a, b in zip(UP, ("nd", "n1", "n2"), strict=True)}
        nodes = staged(out.select(*(added.get(c, moved.get(c, F.col(c))) for c in nodes.columns)), done=(got, *inputs))
        inputs = (nodes,)
        reach *= 2
    return nodes


def trie(rows: DataFrame, convs: DataFrame, inputs: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Nodes of the conversations given by ``rows`` and ``convs`` (see ``rebuilt``) with their counts and subtree sums."""
    every = staged(prefixes(rows, convs), done=inputs)
    nodes = every.groupBy(*ID).agg(F.min("c").alias("conv_id"), *(F.min(x).alias(x) for x in UP), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    nodes = staged(nodes)
    size, deepest = nodes.agg(F.count("*"), F.max("depth")).first()
    children = nodes.where("j1 is not null").groupBy(*(F.col(a).alias(b) for a, b in zip(UP, ID, strict=True))).agg(F.count("*").alias("many"))
    full = nodes.join(children, ID, "left").withColumn("n_children", F.coalesce("many", F.lit(0)))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    full = staged(full.withColumn("n_leaves", leaf).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes", "many"), done=(nodes,))
    full = roll_up(full, ["n_leaves", "saved_tokens"], size, deepest or 0)
    ends = staged(ended(every.where("ends")), done=(every,))
    out = full.join(ends, ID, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, convs, source = rebuilt(table(spark, sf_dir, "conversations"))
    return trie(rows, convs, (source,))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, count(*) AS length, c - c % 5 AS base,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END))) % 9 AS h
  FROM t GROUP BY c),
convs AS (SELECT o.*, least(o.h, coalesce(b.length, 0)) AS taken FROM own o LEFT JOIN own b ON b.c = o.base),
r AS (
  SELECT t.c, i - h + taken + 1 AS d, role, text FROM t JOIN convs ON convs.c = t.c WHERE i >= h
  UNION ALL SELECT convs.c, i + 1, role, text FROM t JOIN convs ON convs.base = t.c WHERE i < h),
k AS (SELECT c, d, octet_length(encode(text)) AS bytes, string_agg(sha256(sha256(role) || sha256(text)), '') OVER (PARTITION BY c ORDER BY d) AS chain FROM r),
p AS (SELECT c, d, bytes, sha256(chain) AS key FROM k UNION ALL SELECT c, 0, 0, 'root' FROM convs),
ends AS (SELECT c, max(d) AS d FROM p GROUP BY c),
n AS (
  SELECT key, min(p.c) AS conv_id, min(p.d) AS depth, count(*) AS n_convs, min(bytes) AS bytes,
    string_agg(CAST(ends.c AS VARCHAR), ',' ORDER BY ends.c) AS ended
  FROM p LEFT JOIN ends ON ends.c = p.c AND ends.d = p.d GROUP BY key),
up AS (SELECT n.key, q.key AS parent FROM n JOIN p q ON q.c = n.conv_id AND q.d = n.depth - 1),
kids AS (SELECT parent, count(*) AS m FROM up GROUP BY parent),
f AS (SELECT n.*, coalesce(m, 0) AS n_children FROM n LEFT JOIN kids ON kids.parent = n.key),
s AS (
  SELECT q.key, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * f.bytes) AS BIGINT) AS saved_tokens
  FROM f JOIN p q ON q.c = f.conv_id AND q.d <= f.depth GROUP BY q.key)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(f.ended, '')) AS ends_sha256
FROM f JOIN s ON s.key = f.key LEFT JOIN up ON up.key = f.key LEFT JOIN n g ON g.key = up.parent
"""
