"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes its own example: all preceding turns are the prompt,
that reply alone is under the loss mask.  Turns after the last reply (or a conversation without
one) give one more row, ``trainable = false``, so that nothing of the input is lost.

Template, one turn: ``### <role>: <text></turn>\\n``.  Control strings inside texts and roles are
escaped with a backslash, and so are backslashes; ``unescape`` is the exact inverse.

Order of turns: ``turn`` (null first), then role, then text, so ties have one order; repeated rows
are turns of their own.  Null text or role: empty.  Null conv_id: one conversation of its own.
An empty table gives no rows; other columns of the input are ignored.

A conversation is one example's context, so its turns are gathered in one row; the number of
conversations is not bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import table

HEAD, END = "### ", "</turn>"


def escape(c: Column, role: bool = False) -> Column:
    for s in ("\\", HEAD, END, *(":",) * role):
        c = F.replace(c, F.lit(s), F.lit("\\" + s))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, example_id, target_turn, prompt, completion, formatted, loss_start, loss_end, trainable.

    ``formatted`` = prompt || completion; the loss mask is the code points [loss_start, loss_end) of it,
    which hold the escaped reply.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("head", F.concat(F.lit(HEAD), escape(F.col("role"), True), F.lit(": "))).withColumn("body", escape(F.col("text")))
    whole = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("turns"))
    render = lambda a: F.array_join(F.transform(a, lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    n = F.size("turns")
    at = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == n))
    e = whole.select("conv_id", "turns", F.posexplode(at).alias("example_id", "i"))
    last, before = F.element_at("turns", F.col("i")), F.slice("turns", 1, F.col("i") - 1)
    hit = last["role"] == "assistant"
    e = e.select(
        "conv_id", F.col("example_id").cast("long").alias("example_id"), last["turn"].alias("target_turn"),
        F.when(hit, F.concat(render(before), last["head"])).otherwise(render(F.slice("turns", 1, F.col("i")))).alias("prompt"),
        F.when(hit, F.concat(last["body"], F.lit(END + "\n"))).otherwise("").alias("completion"),
        F.when(hit, F.char_length(last["body"])).otherwise(0).alias("n"), hit.alias("trainable"),
    )
    return e.select(
        "conv_id", "example_id", "target_turn", "prompt", "completion", F.concat("prompt", "completion").alias("formatted"),
        F.char_length("prompt").cast("long").alias("loss_start"), (F.char_length("prompt") + F.col("n")).cast("long").alias("loss_end"), "trainable",
    )


def read_back(ex: DataFrame) -> DataFrame:
    """Examples -> conv_id, turns (role, text), loss: recovered from ``formatted`` and the mask alone."""
    masked = F.col("formatted").substr(F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    e = ex.select("conv_id", "example_id", "formatted", unescape(masked).alias("loss"), F.char_length("formatted").cast("long").alias("n"))
    g = e.groupBy("conv_id").agg(
        F.max_by("formatted", "example_id").alias("full"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example_id", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("n").alias("formatted_chars"),
    )
    # an escaped text never holds an end mark, a line feed and a bare head mark in this order
    parts = F.split("full", r"(?<=</turn>\n)(?=### )")
    pattern = r"(?s)^### ((?:[^:\\]|\\.)*): (.*)</turn>\n$"
    turn = lambda x: F.struct(unescape(F.regexp_extract(x, pattern, 1)).alias("role"), unescape(F.regexp_extract(x, pattern, 2)).alias("text"))
    return g.select("conv_id", F.transform(parts, turn).alias("turns"), "loss", "formatted_chars")


CONTROL = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    back = read_back(examples(turns.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n,
    4 + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ':', '\:')) + 2
      + length(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>')) + 8 AS chars FROM t),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, max(n) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
