"""Operators on events in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(df: DataFrame, by: str, time: str, gap_seconds: int) -> DataFrame:
    """Numbers each key's sessions: a new one starts after a gap of at least so many seconds."""
    w = Window.partitionBy(by).orderBy(time)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    new = F.when(gap.isNull() | (gap >= gap_seconds * 1_000_000), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def funnel(df: DataFrame, by: str, time: str, kind: str, steps: list[str]) -> DataFrame:
    """For each key how many of the steps it took in this order; each step strictly after the first use of the one before.

    Only events that are steps are gathered; a key without any has depth 0.
    """
    used = F.collect_list(F.when(F.col(kind).isin(steps), F.struct(F.col(time).alias("t"), F.col(kind).alias("k"))))
    names = F.array(*(F.lit(s) for s in [*steps, ""]))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast(df.schema[time].dataType).alias("t"))

    def step(s, e):
        taken = (e["k"] == F.element_at(names, s["n"] + 1)) & (s["t"].isNull() | (e["t"] > s["t"]))
        return F.struct(F.when(taken, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(taken, e["t"]).otherwise(s["t"]).alias("t"))

    return df.groupBy(by).agg(F.array_sort(used).alias("_used")).select(by, F.aggregate("_used", start, step)["n"].alias("depth"))


def rollup_by_time(df: DataFrame, time: str, width: str, by: list[str], value: str) -> DataFrame:
    """Count, sum, least and greatest of a value for each time bucket and key."""
    return df.groupBy(F.window(time, width).alias("_w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("_w.start").cast("timestamp_ntz").alias("bucket"), *by, "n", "total", "least", "most")
