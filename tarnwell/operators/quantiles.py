"""Exact percentiles of groups without a map or a list of their values, by ranges that narrow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: A range is read out when it has no more values; sketches that choose ranges are this accurate.
FEW, ACCURACY = 10_000, 10_000
#: A round asks the sketch for values at so many even steps, and narrows a range to about one of them.
STEPS = 256


def exact_percentiles(df: DataFrame, *, by: list[str], value: str, fractions: list[float], few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """For each group and fraction: the group's columns, fraction, n, and `percentile`, interpolated between the two nearest values.

    Each wanted rank has a range of values that holds it, at first all. A round asks a sketch of bounded size for values
    little below and above the rank, counts exactly what is under and within them, and takes the part that has the rank; so
    a range's values shrink to about one in STEPS in a round, however values are distributed, and equal values end it at once.
    Ranges of at most `few` values are read out. Each round reads the values once or twice, and sums up before the shuffle.
    Null and NaN values do not count; groups without values give no rows. Ranks travel with their group, so groups and
    fractions may be many; a group's rows are never brought together.
    """
    names = [f"g{i}" for i in range(len(by))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    rows = written(rows, "percentile-values")
    counts = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    fraction = F.explode(F.array(*(F.lit(float(x)) for x in fractions))).alias("fraction")
    at = F.col("fraction") * (F.col("n") - 1)
    ranks = counts.select("*", fraction).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))))
    # `under`: values below the range; `inside`: values in it.
    open_ = written(ranks.select(*names, "n", "rank", "low", "high", F.lit(0).cast("long").alias("under"), F.col("n").alias("inside")).distinct(), "percentile-ranges")
    done = []
    while True:
        ready = F.col("low") == F.col("high")
        done.append(open_.where(ready).select(*names, "n", "rank", F.col("low").alias("v")))
        small = open_.where(~ready & (F.col("inside") <= few))
        listed = _within(rows, small, names).groupBy(*names, "n", "rank", "under").agg(F.sort_array(F.collect_list("v")).alias("all"))
        done.append(listed.select(*names, "n", "rank", F.element_at("all", (F.col("rank") - F.col("under") + 1).cast("int")).alias("v")))
        open_ = open_.where(~ready & (F.col("inside") > few))
        if open_.isEmpty():
            break
        keys = [*names, "n", "rank", "under", "inside"]
        place = (F.col("rank") - F.col("under")) / F.col("inside")
        # Values a little below and above the rank, and the range's ends. What lies between two of them is counted exactly.
        sketch = F.percentile_approx("v", F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1))), F.lit(accuracy))
        cuts = _within(rows, open_, names).groupBy(*keys, "low", "high").agg(sketch.alias("cuts"))
        edges = written(cuts.select(*keys, "low", "high", _around("cuts", place).alias("edges")), "percentile-cuts")
        hits = _within(rows, edges, names)
        spot = F.size(F.filter("edges", lambda e: e <= F.col("v")))
        # Slots: a cut's own value, and what lies between it and the next.
        slot = F.when(F.get("edges", spot - 1) == F.col("v"), 2 * spot).otherwise(2 * spot + 1)
        slots = hits.groupBy(*keys, slot.alias("slot")).agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        earlier = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        slots = slots.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)) + F.col("under"))
        kept = slots.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("m")))
        open_ = written(kept.select(*names, "n", "rank", "low", "high", F.col("before").alias("under"), F.col("m").alias("inside")), "percentile-ranges")
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    found = written(found, "percentile-ranks")
    want = counts.select(*names, "n", fraction).withColumn("at", F.col("fraction") * (F.col("n") - 1))
    same = lambda x, y: [F.col(f"{x}.{n}").eqNullSafe(F.col(f"{y}.{n}")) for n in names]
    all_of = lambda cs: reduce(Column.__and__, cs)
    low, high = found.alias("l"), found.alias("h")
    out = want.alias("w").join(low, all_of([*same("w", "l"), F.col("l.rank") == F.floor("at")])).join(high, all_of([*same("w", "h"), F.col("h.rank") == F.ceil("at")]))
    part = F.col("at") - F.floor("at")
    return out.select(*(F.col(f"w.{n}").alias(c) for n, c in zip(names, by, strict=True)), "fraction", "w.n", (F.col("l.v") + (F.col("h.v") - F.col("l.v")) * part).alias("percentile"))


def _around(cuts: str, place: Column) -> Column:
    """Of a sketch's values at even steps the few about a place."""
    at = F.floor(place * STEPS).cast("int")
    return F.array_sort(F.array_distinct(F.array(*(F.get(cuts, F.greatest(F.lit(0), F.least(F.lit(STEPS), at + d))) for d in (-1, 0, 1, 2)))))


def _within(rows: DataFrame, ranges: DataFrame, names: list[str]) -> DataFrame:
    """Rows in the ranges of their group."""
    r, g = rows.alias("r"), ranges.alias("g")
    on = (F.col("r.v") >= F.col("g.low")) & (F.col("r.v") <= F.col("g.high"))
    for n in names:
        on &= F.col(f"r.{n}").eqNullSafe(F.col(f"g.{n}"))
    return r.join(g, on).select("r.v", "g.*")
