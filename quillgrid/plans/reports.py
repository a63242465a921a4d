"""Benchmark records: timing, summaries, and the join of two sets of results."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.scalars import rate, winner


def timed(spark: SparkSession, name: str, work: Callable[[], DataFrame], runs: int = 3) -> DataFrame:
    """(name, run, seconds, rows) of repeated runs; each counts its result's rows."""
    found = []
    for run in range(runs):
        begun = time.perf_counter()
        rows = work().count()
        found.append((name, run, time.perf_counter() - begun, rows))
    return spark.createDataFrame(found, "name string, run int, seconds double, rows long")


def summary(times: DataFrame) -> DataFrame:
    """(name, mean, std, rows_per_second) of timed runs; std is that of the population."""
    each = times.groupBy("name").agg(F.avg("seconds").alias("mean"), F.stddev_pop("seconds").alias("std"), F.max("rows").alias("rows"))
    return each.select("name", "mean", "std", rate(F.col("rows"), F.col("mean")).alias("rows_per_second"))


def compared(first: DataFrame, second: DataFrame, key: str, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """(key, time of each, speedup, winner) of results (key, seconds) that both sets have."""
    x = first.select(key, F.col("seconds").alias(f"{names[0]}_s"))
    y = second.select(key, F.col("seconds").alias(f"{names[1]}_s"))
    speedup = F.col(f"{names[1]}_s") / F.col(f"{names[0]}_s")
    return x.join(y, key).withColumn("speedup", speedup).withColumn("winner", winner(speedup, *names))


def wins(comparison: DataFrame) -> DataFrame:
    """(winner, wins)."""
    return comparison.groupBy("winner").agg(F.count("*").alias("wins"))


def phase_shares(phases: DataFrame) -> DataFrame:
    """(phase, seconds, pct) of a run's phases (phase, seconds)."""
    total = phases.agg(F.sum("seconds").alias("total"))
    return phases.crossJoin(total).select("phase", "seconds", (F.col("seconds") / F.col("total") * 100).alias("pct"))  # by one row


def as_text(records: DataFrame, title: str, limit: int = 1000) -> str:
    """A small report as lines of text; an error for more than `limit` records."""
    rows = records.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} records")
    return "\n".join([title, *(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows)])
