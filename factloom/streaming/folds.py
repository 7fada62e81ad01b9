"""Folds of an event log (run, ord, ts, event, cost), as batch aggregations and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tallies(log: DataFrame) -> DataFrame:
    done = lambda kind: F.count_if(F.col("event") == kind)
    return log.groupBy("run").agg(done("purchase").alias("completed"), done("error").alias("failures"), F.round(F.sum("cost"), 2).alias("cost"), F.max("ord").alias("last_ord"))


def first_of_each(log: DataFrame) -> DataFrame:
    """The first of each event of a run: repeated completions count once."""
    return log.groupBy("run", "event").agg(F.min("ord").alias("ord"))


def unfinished(log: DataFrame, begins: str, ends: str) -> DataFrame:
    """(run, ord) of begins with no later end in their run, by one aggregation and one join."""
    last = log.where(F.col("event") == ends).groupBy("run").agg(F.max("ord").alias("end"))
    return log.where(F.col("event") == begins).join(last, "run", "left").where("end is null or end < ord").select("run", "ord")


def since_last(log: DataFrame, tick: str) -> DataFrame:
    ticks = log.where(F.col("event") == tick).groupBy("run").agg(F.max("ord").alias("tick"))
    return log.join(ticks, "run").where("ord >= tick").drop("tick")


def cost_by_day(log: DataFrame, days: int = 30) -> DataFrame:
    rows = log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("cost"), 2).alias("cost"), F.count("*").alias("n"))
    return rows.orderBy(F.desc("day")).limit(days)


def staleness(log: DataFrame, now: str) -> DataFrame:
    """Runs by the age of their last event at `now`."""
    last = log.groupBy("run").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    hours = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last")) / 3.6e9
    bucket = F.when(hours <= 24, "fresh").when(hours <= 72, "warm").when(hours <= 168, "aging").otherwise("stale")
    return last.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def sessions(log: DataFrame, gap: str) -> DataFrame:
    """(run, session, n): sessions end after `gap` without events; works on streams with a watermark too."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("run", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"))


def sample_by_gap(log: DataFrame, seconds: int) -> DataFrame:
    """(run, ord): events kept at least `seconds` after the last kept one of their run.

    Rows are dealt out and sorted by run; a task keeps one time per run, whatever the run's length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = last = None
        for batch in batches:
            keep = []
            for key, at in zip(batch["run"], batch["at"], strict=True):
                if key != current:
                    current, last = key, None
                keep.append(last is None or at - last >= seconds * 1_000_000)
                last = at if keep[-1] else last
            yield batch.loc[keep, ["run", "ord"]]

    rows = log.select("run", "ord", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.repartition("run").sortWithinPartitions("run", "at", "ord").mapInPandas(run, "run long, ord long")


def last_events(log: DataFrame, n: int) -> DataFrame:
    """The last n events of every run."""
    by = Window.partitionBy("run").orderBy(F.desc("ord"))
    return log.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= n).drop("rn")


def stream_tallies(log: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Tallies per run and window of a stream, with late events until the watermark."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("run", F.window("ts", window).alias("window")).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


def stream_first_of_each(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (run, event) of a stream once while the watermark remembers it."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["run", "event"])
