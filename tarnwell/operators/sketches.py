"""Columns of mergeable sketches: stored by fine time buckets, merged into coarse ones, and intersected, without the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Theta sketches of 2**12 entries: exact to 4096 distinct items, then a standard error of 1.6 %.
LG_ENTRIES = 12
#: KLL sketches of k 200: ranks within 1.33 % in 99 of 100 cases, 1.65 % for shares between two values.
KLL_K, RANK_ERROR = 200, 0.0165
#: Items that a top-k sketch tracks: counts are exact to so many distinct items.
TRACKED = 10_000


def sketched(df: DataFrame, *, time: str, width: str, by: list[str], item: str, value: str) -> DataFrame:
    """One row for each bucket and key: n, and sketches of its distinct items, of its values, and of its most frequent items.

    Each sketch is of bounded size and summed up before the shuffle. Nulls count in n only.
    """
    return (
        df.groupBy(F.window(time, width).alias("_w"), *by)
        .agg(F.count("*").alias("n"), F.theta_sketch_agg(item, LG_ENTRIES).alias("items"), F.kll_sketch_agg_double(value, KLL_K).alias("values"), F.expr(f"approx_top_k_accumulate({item}, {TRACKED})").alias("top"))
        .select(F.col("_w.start").cast("timestamp_ntz").alias("bucket"), *by, "n", "items", "values", "top")
    )


def merged(sketches: DataFrame, *, width: str, by: list[str]) -> DataFrame:
    """Sketches of wider buckets from those of narrower ones that lie within them."""
    return (
        sketches.groupBy(F.window("bucket", width).alias("_w"), *by)
        .agg(F.sum("n").alias("n"), F.theta_union_agg("items", LG_ENTRIES).alias("items"), F.kll_merge_agg_double("values", KLL_K).alias("values"), F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"))
        .select(F.col("_w.start").cast("timestamp_ntz").alias("bucket"), *by, "n", "items", "values", "top")
    )


def with_returning(sketches: DataFrame, *, width: str, by: list[str]) -> DataFrame:
    """sketches with `returning`: the sketch of the items that the bucket before has too; null in the first."""
    before = sketches.select((F.col("bucket") + F.expr(f"INTERVAL {width}")).alias("bucket"), *by, F.col("items").alias("_before"))
    return sketches.join(before, ["bucket", *by], "left").withColumn("returning", F.theta_intersection("items", "_before")).drop("_before")
