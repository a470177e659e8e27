"""Mixing sources to target weights by Pfair scheduling, DataFrame operations only.

The documents of a source are dealt into blocks in a seeded random order.  With integer weight w of
total Q, block j of the source is released at slot floor(j*Q/w) and due at slot ceil((j+1)*Q/w);
earliest deadline first among the released blocks fills one slot at a time.  After any number of
slots each source is less than one block from its share, as long as it has blocks left.

The schedule repeats every Q slots, so it is worked out once for Q slots (sources and weights alone)
and block j stands in slot (j div w)*Q + slot_of[j mod w].  No row is dropped: a source that runs out
leaves its later slots empty.  The number of sources is not bounded: one row a source and one a slot of the period
pass through the driver, and are broadcast only up to SMALL slots.

Numbering a hot source without one task for it: rows are dealt into 4096 hash ranges a source,
numbered inside each, and shifted by the counts of the ranges before.

Defined results: null source is a source of its own with the default weight; rows with equal doc_id
stand side by side, ordered by their other columns' hash; an empty table gives no rows.  Columns of
the input that clash with the new ones (``block``, ``slot``, ``pos``) are replaced.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._stage import table

BLOCK = 32
SMALL = 1 << 16  # largest sum of weights whose schedule is broadcast


def schedule(weights: list[int]) -> list[list[int]]:
    """Slots of each source's blocks in one period of sum(weights) slots, earliest deadline first."""
    q = sum(weights)
    out: list[list[int]] = [[] for _ in weights]
    later = [(0, i) for i in range(len(weights))]  # (release, source) of each source's next block
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for t in range(q):
        while later and later[0][0] <= t:
            i = heappop(later)[1]
            heappush(ready, (-(-(len(out[i]) + 1) * q // weights[i]), i))
        i = heappop(ready)[1]
        out[i].append(t)
        if len(out[i]) < weights[i]:
            heappush(later, (len(out[i]) * q // weights[i], i))
    return out


def mix(docs: DataFrame, weights: dict | Column, block: int = BLOCK, seed: int = 0, default: int = 1) -> DataFrame:
    """docs(doc_id, source, …) -> the same rows with block, slot, pos; reading by (slot, pos) is the mixture.

    ``weights``: positive integers by source, or a column of ``source`` that gives them.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in ("block", "slot", "pos")]
    d = docs.select(*keep)
    sources = d.select("source").distinct()
    if isinstance(weights, dict):
        got = [(r[0], int(weights.get(r[0], default))) for r in sources.collect()]  # one row a source
    else:
        got = [(r[0], int(r[1] if r[1] is not None else default)) for r in sources.select("source", weights.alias("w")).collect()]
    got.sort(key=lambda r: (r[0] is not None, r[0] or ""))
    if any(w < 1 for _, w in got):
        raise ValueError("weights must be positive integers")
    slots = schedule([w for _, w in got])
    total = sum(w for _, w in got)
    rows = [(s, w, k, t) for (s, w), ts in zip(got, slots, strict=True) for k, t in enumerate(ts)]
    plan = spark.createDataFrame(rows, "p_source string, p_w long, p_k long, p_slot long")
    sizes = spark.createDataFrame(got, "p_source string, p_w long")
    small = F.broadcast if total <= SMALL else (lambda frame: frame)

    other = [c for c in keep if c not in ("doc_id", "source")]
    d = d.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn("_r", F.substring("_h", 1, 3))
    counts = d.groupBy("source", "_r").count()
    before = counts.select("source", "_r", (F.sum("count").over(Window.partitionBy("source").orderBy("_r")) - F.col("count")).alias("_o")).select(F.col("source").alias("o_source"), F.col("_r").alias("o_r"), "_o")
    w = Window.partitionBy("source", "_r").orderBy("_h", "doc_id", *([F.xxhash64(*other)] if other else []))
    d = d.withColumn("_n", F.row_number().over(w))
    d = d.join(before, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("_r") == F.col("o_r")))
    d = d.withColumn("_n", F.col("_o") + F.col("_n") - 1).withColumn("block", F.expr(f"_n div {block}")).withColumn("pos", F.col("_n") % block)
    d = d.join(small(sizes), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    d = d.withColumn("_k", F.col("block") % F.col("p_w")).withColumn("_c", F.expr("block div p_w"))
    d = d.join(small(plan.select("p_source", "p_k", "p_slot")), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("_k") == F.col("p_k")))
    return d.select(*keep, F.col("block").cast("long").alias("block"), (F.col("_c") * total + F.col("p_slot")).cast("long").alias("slot"), F.col("pos").cast("long").alias("pos"))


def weight_of(source: Column) -> Column:
    """Weights of the query: 1 to 4 by the last character of the source's name."""
    return 1 + F.ascii(F.right(source, F.lit(1))) % 4


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"), weight_of(F.col("source")))


def oracle(rows: str = "documents", columns: str = "doc_id, source") -> str:
    return f"""
WITH RECURSIVE w AS (SELECT source, 1 + ascii(right(source, 1)) % 4 AS w FROM (SELECT DISTINCT source FROM {rows})),
s AS (SELECT list(source ORDER BY source) AS src, list(w ORDER BY source) AS ws, CAST(sum(w) AS BIGINT) AS q, count(*) AS n FROM w),
r AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS a, CAST(0 AS BIGINT) AS pick, CAST(-1 AS BIGINT) AS k FROM s
  UNION ALL
  SELECT t + 1, list_transform(a, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p, a[p]
  FROM (SELECT r.t, r.a, list_min(list_transform(list_filter(generate_series(1, s.n), lambda i: a[i] < ws[i] AND a[i] * q // ws[i] <= t + 1),
          lambda i: ((a[i] + 1) * q + ws[i] - 1) // ws[i] * 100000 + i)) % 100000 AS p
        FROM r, s WHERE t + 1 < q)),
pl AS (SELECT src[pick] AS source, k, t AS slot FROM r, s WHERE t >= 0),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('0-' || doc_id), doc_id) - 1 AS n FROM {rows}),
b AS (SELECT n.*, n // {BLOCK} AS block, n % {BLOCK} AS pos, w.w FROM n JOIN w USING (source))
SELECT {", ".join("b." + c.strip() for c in columns.split(","))}, CAST(block AS BIGINT) AS block,
  CAST((block // b.w) * (SELECT q FROM s) + pl.slot AS BIGINT) AS slot, CAST(pos AS BIGINT) AS pos
FROM b JOIN pl ON pl.source = b.source AND pl.k = block % b.w
"""


ORACLE_SQL = oracle()
