"""Chat formatting by perspective rotation.

Each participant of a conversation (every role but ``system``) gets a rendering
in which it is the assistant and the others are named users, with the character
spans of its own turns as the training mask. Built-in operators only: turns and
participants meet once on conv_id, and the offsets are running sums over the
same partitioning.

A turn mark in a text or a role would forge a turn, so ``<|`` is rendered as
``<\\|`` there, and in a role ``|>`` as ``|\\>``; where backslashes stand between
already, one more is added, so the rendering can be read back.

Defined results: turns are ordered by (turn, role, text), so ties and repeated
rows have one order; a null role or one of white space only (the six ASCII
characters) is ``unknown``, a null text is empty; a turn without a conv_id is a
conversation of its own, of one turn; a conversation of system turns alone has no
row; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load


def plain(text: Column) -> Column:
    """``text`` with a backslash more in whatever would read as the beginning of a turn mark."""
    return F.regexp_replace(text, "<(\\\\*)\\|", "<$1\\\\|")


def rotate_perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation and participant: conv_id, perspective, n_turns, rendered, mask.

    ``mask`` is an array of (start, end) over the code points of ``rendered``.
    """
    named = F.when(F.coalesce(role, F.lit("")).rlike("^[\\x20\\x09-\\x0D]*$"), "unknown").otherwise(F.col(role))
    turns = df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), named.alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    held = turns.where("conv_id IS NOT NULL")
    numbered = held.withColumn("ord", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    numbered = numbered.withColumn("text", plain(F.col("text")))
    people = held.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    both = numbered.alias("t").join(people.alias("p"), "conv_id")
    own = F.col("role") == F.col("perspective")
    head = F.when(own, "<|assistant|>\n").when(F.col("role") == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user:"), F.regexp_replace(plain(F.col("role")), "\\|(\\\\*)>", "|$1\\\\>"), F.lit("|>\n")))
    piece = both.select("conv_id", "ord", "role", "text", "perspective", own.alias("own"), head.alias("head")).withColumn("piece", F.concat("head", "text", F.lit("<|end|>\n")))
    order = Window.partitionBy("conv_id", "perspective").orderBy("ord")
    placed = piece.withColumn("start", F.sum(F.length("piece")).over(order) - F.length("piece") + F.length("head"))
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.length("text")).cast("long").alias("end"))
    shape = ["conv_id", "perspective", "n_turns", "rendered", "mask"]
    whole = (
        placed.groupBy("conv_id", "perspective")
        .agg(
            F.count("*").alias("n_turns"),
            F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("pieces"),
            F.array_sort(F.collect_list(F.when(F.col("own"), span))).alias("mask"),
        )
        .withColumn("rendered", F.array_join(F.transform("pieces", lambda x: x["piece"]), ""))
        .select(*shape)
    )
    # Turns without a conversation stand alone: a row each, where they are read, so that many of them are no group.
    start = F.lit(len("<|assistant|>\n")).cast("long")
    alone = turns.where("conv_id IS NULL AND role <> 'system'").withColumn("text", plain(F.col("text"))).select(
        "conv_id", F.col("role").alias("perspective"), F.lit(1).cast("long").alias("n_turns"), F.concat(F.lit("<|assistant|>\n"), "text", F.lit("<|end|>\n")).alias("rendered"),
        F.array(F.struct(start.alias("start"), (start + F.length("text")).alias("end"))).alias("mask"),
    )
    return whole.unionByName(alone)


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(load(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "n_turns", "rendered", mask.alias("mask"))


ORACLE_OP5 = r"""
WITH t AS (
  SELECT row_number() OVER () AS id, conv_id, turn, CASE WHEN regexp_full_match(coalesce(role,''), '[\x20\x09-\x0D]*') THEN 'unknown' ELSE role END AS role, coalesce(text,'') AS text FROM conversations),
n AS (SELECT *, CASE WHEN conv_id IS NULL THEN id END AS lone, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS shown, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ord FROM t),
p AS (SELECT DISTINCT conv_id, lone, role AS perspective FROM n WHERE role <> 'system'),
h AS (
  SELECT n.*, perspective, CASE WHEN role=perspective THEN '<|assistant|>' || chr(10) WHEN role='system' THEN '<|system|>' || chr(10)
         ELSE '<|user:' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') || '|>' || chr(10) END AS head
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.lone IS NOT DISTINCT FROM p.lone),
q AS (SELECT *, head || shown || '<|end|>' || chr(10) AS piece FROM h),
s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, lone, perspective ORDER BY ord) - length(piece) + length(head) AS st FROM q)
SELECT conv_id, perspective, count(*) AS n_turns, string_agg(piece, '' ORDER BY ord) AS rendered,
  coalesce(string_agg(CASE WHEN role=perspective THEN st::BIGINT::VARCHAR || ':' || (st+length(shown))::BIGINT::VARCHAR END, ',' ORDER BY ord),'') AS mask
FROM s GROUP BY conv_id, lone, perspective
"""
