"""Windows over keys of which one may have most rows: rows are dealt in ranges of key and order, and state is carried over.

A window by key brings a key's rows together in one task. Here rows are dealt in ranges of (key, order), so a hot key is
spread over many blocks; each block works on its own rows, a summary of each key in each block is carried from block to
block (one row for each, so a key has at most as many as there are blocks), and what a block's rows lack from before is
joined back. Blocks are written, so that a lost one is the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Rows of a block, about.
BLOCK = 1_000_000


def dealt(df: DataFrame, by: list[str], order: list[str], rows: int = BLOCK) -> DataFrame:
    """df with `_block`, in ranges of (by, order) of about so many rows; equal rows share a block."""
    p = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(p, -(-df.count() // rows))
    return written(df.repartitionByRange(n, *by, *order).withColumn("_block", F.spark_partition_id()), "blocks")


def _carried(summary: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """For each key and block what the key's earlier blocks make, by windows over summaries: `columns` use the frame of earlier blocks."""
    return summary.select(*by, "_block", *(c.alias(n) for n, c in columns.items()))


def _earlier(by: list[str]):
    return Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _back(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what is carried into their block; keys that are null match too."""
    names = [f"_k{i}" for i in range(len(by))]
    carried = carried.select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), F.col("_block").alias("_kb"), *(c for c in carried.columns if c not in (*by, "_block")))
    on = F.col("_block") == F.col("_kb")
    for b, n in zip(by, names, strict=True):
        on &= F.col(b).eqNullSafe(F.col(n))
    return rows.join(carried, on, "left").drop("_kb", *names)


def running(df: DataFrame, *, by: list[str], order: list[str], value: str, rows: int = BLOCK) -> DataFrame:
    """df with `running_sum` and `running_count` of a value over its key's rows up to each one, in the order given.

    Nulls add nothing. Rows that tie in the order are taken in any order, as a window by rows takes them.
    """
    blocks = dealt(df, by, order, rows)
    frame = Window.partitionBy("_block", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = blocks.withColumn("_sum", F.sum(value).over(frame)).withColumn("_count", F.count(value).over(frame))
    summary = blocks.groupBy(*by, "_block").agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    carried = _carried(summary, by, {"_before": F.sum("s").over(_earlier(by)), "_many": F.sum("c").over(_earlier(by))})
    both = _back(own, carried, by)
    total = F.when(F.col("_before").isNull(), F.col("_sum")).otherwise(F.col("_before") + F.coalesce("_sum", F.lit(0)))
    return both.select(*df.columns, total.alias("running_sum"), (F.coalesce("_many", F.lit(0)) + F.col("_count")).alias("running_count"))


def sessions(df: DataFrame, *, by: list[str], time: str, gap_seconds: int, rows: int = BLOCK) -> DataFrame:
    """df with `session`, the number of its key's session from 1: a new one starts after a gap of at least so many seconds."""
    blocks = dealt(df, by, [time], rows)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    frame = Window.partitionBy("_block", *by).orderBy(time)
    step = micros(time) - F.lag(micros(time)).over(frame)
    new = F.when(step >= gap_seconds * 1_000_000, 1).otherwise(0)  # a block's first row is looked at below
    own = blocks.withColumn("_new", new).withColumn("_own", F.sum("_new").over(frame.rowsBetween(Window.unboundedPreceding, 0)))
    summary = own.groupBy(*by, "_block").agg(F.sum("_new").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    w = Window.partitionBy(*by).orderBy("_block")
    apart = F.when(F.lag("last").over(w).isNull() | (micros("first") - micros("_last") >= gap_seconds * 1_000_000), 1).otherwise(0)
    summary = summary.withColumn("_last", F.lag("last").over(w)).withColumn("apart", apart)
    carried = _carried(summary, by, {"_base": F.sum(F.col("n") + F.col("apart")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")})
    return _back(own, carried, by).select(*df.columns, (F.col("_base") + F.col("_own")).alias("session"))


def asof(left: DataFrame, right: DataFrame, *, by: list[str], left_time: str, right_time: str, values: list[str], rows: int = BLOCK) -> DataFrame:
    """For each left row the values of the latest right row of its keys at or before its time, else null.

    As `joins.asof_join`, of right rows at one time the one with the greatest values counts; null keys match each other.
    """
    held = F.struct(*(F.col(v) for v in values))
    a = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    b = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), held.alias("_right"))
    blocks = dealt(a.unionByName(b), by, ["_t", "_side"], rows)
    order = ["_t", "_side", F.col("_right").asc_nulls_first()]
    frame = Window.partitionBy("_block", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = blocks.withColumn("_own", F.last("_right", ignorenulls=True).over(frame)).where("_side = 1")
    last = F.max(F.when(F.col("_side") == 0, F.struct("_t", "_right")))["_right"]
    carried = _carried(blocks.groupBy(*by, "_block").agg(last.alias("last")), by, {"_before": F.last("last", ignorenulls=True).over(_earlier(by))})
    both = _back(own, carried, by).withColumn("_found", F.coalesce("_own", "_before"))
    return both.select("_left.*", *(F.col(f"_found.{v}").alias(v) for v in values))
