"""Packing into optimal length buckets.

Documents longer than ``max_tokens`` are cut into pieces of that length, so
nothing is dropped. The global histogram of piece lengths (at most
``max_tokens`` rows, whatever the corpus) goes to the driver, where dynamic
programming picks the ``buckets`` upper lengths with the least padding. Inside a
bucket of padded length L a batch holds floor(token_budget / L) pieces. Pieces
are numbered without gathering a bucket in one task: each (bucket, shard) is
numbered by itself, and running totals over the table of shard counts, in two
levels of SHARDS_A_GROUP, give the offsets, so that only the last batch of a
bucket can be short. Texts are read once: their counts are kept for both passes.
Rows of one doc_id (or of none) and one length are counted before the shuffle and
numbered again in runs of COPIES_A_TASK, and the number is part of what a shard is
chosen by, so that no id fills a shard or a task of its own.

Defined results: length is the count of words ``[^\\x20\\x09-\\x0D]+``, or what
``count`` gives; texts that are null or without a word have no piece; ties in
the programme go to the lower boundary; rows of equal doc_id are separate
documents; with no pieces the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, checkpointed, load

ROWS_A_SHARD, SHARDS_A_GROUP, COPIES_A_TASK = 10_000, 1_000, 100_000


def word_count(text: Column) -> Column:
    """Words between the six ASCII white-space characters."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "piece", "n", "copy"), F.lit(shards))


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths, ascending, with the least total padding; fewer where lengths are fewer."""
    lengths = np.array(sorted(histogram), np.float64)
    n = len(lengths)
    if not n:
        return []
    counts = np.array([histogram[int(x)] for x in lengths], np.float64)
    rows, tokens = np.concatenate([[0.0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(counts * lengths)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back = []
    for _ in range(min(buckets, n)):
        now, origin = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            origin[j] = int(np.argmin(cost))
            now[j] = cost[origin[j]]
        back.append(origin)
        best = now
    bounds, j = [], n
    for origin in reversed(back):
        bounds.append(int(lengths[j - 1]))
        j = int(origin[j])
    return bounds[::-1]


def pack(
    df: DataFrame, text: str = "text", key: str = "doc_id", max_tokens: int = 2_048, token_budget: int = 16_384, buckets: int = 8,
    count: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """One row for each piece: doc_id, piece, first_token, n_tokens, bucket, padded_to, batch, slot.

    ``batch`` numbers the batches of a bucket from 0; ``slot`` the places in it.
    """
    if token_budget < max_tokens:
        raise ValueError("token_budget must hold a piece of max_tokens")
    lengths = df.select(F.col(key).alias("doc_id"), F.coalesce(count(F.col(text)), F.lit(0)).cast("int").alias("n"))
    # The filter comes after the cut in the lineage: before it, it would count the words of each text once more.
    counted = checkpointed(lengths.groupBy("doc_id", "n").agg(F.count("*").alias("rows"))).where("n > 0")
    runs = counted.select("doc_id", "n", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(COPIES_A_TASK).cast("long"))).alias("start"))
    last = F.least(F.col("rows"), F.col("start") + COPIES_A_TASK) - 1
    copies = runs.repartition("doc_id", "n", "start").select("doc_id", "n", F.explode(F.sequence("start", last)).alias("copy"))
    full = F.floor((F.col("n") - 1) / max_tokens).cast("int")
    part = [(F.col("piece") * max_tokens).alias("first_token"), F.least(F.lit(max_tokens), F.col("n") - F.col("piece") * max_tokens).alias("n_tokens")]
    cut = lambda rows, *more: rows.select("doc_id", "n", *more, F.explode(F.sequence(F.lit(0), full)).alias("piece")).select("doc_id", "n", *more, "piece", *part)
    histogram = {r[0]: r[1] for r in cut(counted, "rows").groupBy("n_tokens").agg(F.sum("rows")).collect()}
    bounds = bucket_bounds(histogram, buckets) or [max_tokens]
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
    # Shards follow the hash of the piece and its copy, rows in a shard its order, so a lost task is made again alike.
    shards = blocks_for(sum(histogram.values()), ROWS_A_SHARD)
    placed = cut(copies, "copy").withColumn("bucket", bucket).withColumn("shard", shard_of(shards))
    counts = placed.groupBy("bucket", "shard").agg(F.count("*").alias("rows")).withColumn("group", F.floor(F.col("shard") / SHARDS_A_GROUP))
    running = lambda *by: F.coalesce(F.sum("rows").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("bucket", "group").agg(F.sum("rows").alias("rows")).select("bucket", "group", running("bucket", "group").alias("earlier"))
    inside = counts.select("bucket", "shard", "group", running("bucket", "group", "shard").alias("inside"))
    offsets = inside.join(groups, ["bucket", "group"]).select("bucket", "shard", (F.col("earlier") + F.col("inside")).alias("before"))
    within = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n", "copy")
    numbered = placed.withColumn("rank", F.row_number().over(within)).join(offsets, ["bucket", "shard"])
    place = F.col("before") + F.col("rank") - 1
    padded = F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1)
    out = numbered.select("doc_id", "piece", "first_token", "n_tokens", "bucket", padded.alias("padded_to"), place.alias("place"))
    held = F.expr(f"{int(token_budget)} div padded_to")
    return out.select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket", "padded_to",
        F.floor(F.col("place") / held).cast("long").alias("batch"), (F.col("place") % held).cast("int").alias("slot"),
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
