"""Change observation: immediate and collapsed events, in batch and as Structured Streaming.

A change is (seq, ts, s, p, o). Immediate events are the rows themselves and,
for a property with an inverse, rows for the object too. Collapsed events are
the set of predicates that changed for a subject since the last scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def immediate(changes: DataFrame, inverses: dict[str, str] | None = None, subjects: list | None = None) -> DataFrame:
    """(seq, s, p), with the inverse's event on the object where a property has one."""
    out = changes.select("seq", "s", "p")
    if inverses:
        table = F.create_map(*(F.lit(x) for kv in inverses.items() for x in kv))
        out = out.unionByName(changes.select("seq", F.col("o").alias("s"), F.try_element_at(table, F.col("p")).alias("p")).where("p IS NOT NULL"))
    return out.where(F.col("s").isin(*subjects)) if subjects else out


def collapsed(changes: DataFrame, every: str = "hour") -> DataFrame:
    """(scan, s, preds): the distinct predicates of a subject in each period, sorted and comma-joined."""
    grouped = changes.groupBy(F.date_trunc(every, "ts").alias("scan"), "s").agg(F.array_sort(F.collect_set("p")).alias("p"))
    return grouped.select("scan", "s", F.array_join("p", ",").alias("preds"))


def collapsed_stream(changes: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same over a stream: event-time windows, closed when the watermark passes them."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", window), "s").agg(F.array_sort(F.collect_set("p")).alias("p"))
    return grouped.select(F.col("window.start").alias("scan"), "s", F.array_join("p", ",").alias("preds"))


def observe(stream: DataFrame, listener: Callable[[DataFrame, int], None], checkpoint: str, subjects: list | None = None) -> StreamingQuery:
    """Calls ``listener`` with each batch of events, filtered by subject where asked; stop() ends the observation."""
    events = stream.where(F.col("s").isin(*subjects)) if subjects else stream
    return events.writeStream.foreachBatch(listener).option("checkpointLocation", checkpoint).start()


def latest_values(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(s, p, o): the running last value for each key, for update or complete mode."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("s", "p").agg(F.max_by("o", "seq").alias("o"))


def observe_instances(changes: DataFrame, instances: DataFrame) -> DataFrame:
    """Changes of the class's instances only: a stream-static semi-join."""
    return changes.join(instances.select("s").distinct(), "s", "left_semi")
