"""Joins that have no method of their own on a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ready, written

#: Pairs that a task of a range join compares, about.
PAIRS = 4_000_000
#: Vectors of a block, and how far the cosines by which candidates are chosen may be from those that count.
BLOCK, SLACK = 5_000, 2e-6


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """For each left row the values of the latest right row of the same keys at or before its time, else null.

    Both sides are merged by time in one window, so there is one shuffle by the keys and no pairs are made. Of right
    rows at the same time the one with the greatest values counts.
    """
    held = F.struct(*(F.col(v) for v in values))
    a = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    b = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), held.alias("_right"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", F.col("_right").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_left.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def range_join(left: DataFrame, right: DataFrame, *, value: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Rows of left whose value is in [low, high] of a right row, by equality of buckets of `width`.

    A right row is repeated for each bucket it touches; a left row is in one. So it is a hash or merge join, which
    Spark can shuffle and split, rather than a nested loop. Where buckets make over PAIRS pairs, a bucket's left rows are
    dealt and its right rows repeated for each deal, over as many tasks as the pairs ask for, whatever the rows' bytes.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    points = left.withColumn("_bucket", bucket(value))
    spans = right.withColumn("_span", F.explode(F.sequence(bucket(low), bucket(high))))
    on = (F.col("_bucket") == F.col("_span")) & F.col(value).between(F.col(low), F.col(high))
    sizes = points.groupBy("_bucket").agg(F.count("*").alias("_a")).join(spans.groupBy("_span").agg(F.count("*").alias("_b")), F.col("_bucket") == F.col("_span"))
    total = sizes.agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0
    if total > PAIRS:  # rows are few for the pairs they make, so their bytes don't tell how many tasks are needed
        deals = written(sizes.select("_bucket", F.ceil(F.col("_a") * F.col("_b") / PAIRS).cast("int").alias("_deals")), "range-deals")
        n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // PAIRS))
        points = points.withColumn("_row", F.monotonically_increasing_id()).join(deals, "_bucket", "left")
        points = points.withColumn("_deal", F.pmod("_row", F.coalesce("_deals", F.lit(1))).cast("int")).drop("_row", "_deals").repartition(n, "_bucket", "_deal")
        spans = spans.join(deals.withColumnRenamed("_bucket", "_span"), "_span").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("_deals").repartition(n, "_span", "_copy")
        on = on & (F.col("_deal") == F.col("_copy"))
    out = points.join(spans, on, how)
    return out.select(left.columns if how in ("left_semi", "left_anti") else [*left.columns, *right.columns])


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int, share: float = 0.05) -> DataFrame:
    """An inner join on one key of which a few values have most rows.

    Values with at least `share` of the big side's rows, at most 1/share of them, are dealt over `salts` partitions, and
    only their rows of the small side are repeated; all others are joined as they are.
    """
    counts = big.where(F.col(on).isNotNull()).groupBy(on).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("count") >= max(2, share * total)).select(on).collect()]
    if not hot:
        return big.join(small, on)
    is_hot = F.col(on).isin(hot)
    a = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*big.columns), F.lit(salts))).otherwise(0).cast("int"))
    b = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [on, "_salt"]).drop("_salt")


def interval_join(left: DataFrame, right: DataFrame, *, by: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of the same key whose right time is after the left one by at most so many seconds.

    Joined by the key and a bucket of that width: a left row can meet right ones in its own bucket and the next, so a
    key with very many rows makes pairs only within its buckets.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    a = left.withColumn("_bucket", F.explode(F.array(bucket(left_time), bucket(left_time) + 1)))
    b = right.withColumn("_bucket", bucket(right_time))
    ahead = F.unix_micros(F.col(right_time).cast("timestamp")) - F.unix_micros(F.col(left_time).cast("timestamp"))
    return a.join(b, [by, "_bucket"]).where((ahead > 0) & (ahead <= seconds * 1_000_000)).drop("_bucket")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, *, id_col: str, vector_col: str, k: int, cosine: Callable[[Column, Column], Column], most: int = 10_000) -> DataFrame:
    """For each row of a stated query set the k nearest other rows by cosine; ties go to the smaller id.

    Slices of about `most` queries meet blocks of about BLOCK vectors, each two in a task that multiplies them as matrices
    and keeps k a query, with all that are within SLACK of the last. What is so near to the k best of all blocks is
    compared anew by `cosine`, an expression that may round to no less than six digits, and ranked by that. All pairs are
    compared, and none but these few are shuffled. Null, zero and incomplete vectors and null ids find nothing and are not found;
    vectors of unequal length don't meet.
    """
    spark = ready(vectors.sparkSession)

    def whole(df: DataFrame, row: str, key: str) -> DataFrame:
        found = df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
        found = found.where(F.col("_id").isNotNull() & F.col("_vector").isNotNull() & ~F.exists("_vector", lambda x: x.isNull()))
        return written(found.select("*", F.xxhash64("_id").alias(key), F.monotonically_increasing_id().alias(row)), "vectors")

    q, v = whole(queries, "_query", "_query_key"), whole(vectors, "_found", "_found_key")
    slices, blocks = max(1, -(-q.count() // most)), max(1, -(-v.count() // BLOCK))
    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    by = ["_slice", "_block"]
    a = q.select("_query", "_query_key", "_vector", F.pmod("_query", F.lit(slices)).cast("int").alias("_slice"), each("_block", blocks)).repartition(slices * blocks, *by)
    b = v.select("_found", "_found_key", "_vector", "_id", F.pmod(F.xxhash64("_found"), F.lit(blocks)).cast("int").alias("_block"), each("_slice", slices)).repartition(slices * blocks, *by)
    near = written(a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(_near(k), "_query long, _found long, about double"), "near-vectors")
    last = top_per_group(near.where(~F.isnan("about")), ["_query"], [F.desc("about")], k).groupBy("_query").agg(F.min("about").alias("last"))
    near = near.join(last, "_query", "left").where(F.isnan("about") | (F.col("about") >= F.col("last") - SLACK)).select("_query", "_found")
    near = near.join(q.select("_query", F.col("_id").alias("query_id"), F.col("_vector").alias("_one")), "_query")
    near = near.join(v.select("_found", F.col("_id").alias("found_id"), F.col("_vector").alias("_two")), "_found").where("query_id <> found_id")
    pairs = near.select("query_id", "found_id", cosine(F.col("_one"), F.col("_two")).alias("score"))
    return top_per_group(pairs.where("score is not null"), ["query_id"], [F.desc("score"), F.asc("found_id")], k)


def _near(k: int):
    """Of a slice of queries and a block of vectors the pairs that can be among the k nearest, by cosines that rounding may move.

    Rows whose ids have one hash don't count among the k; they are given too, with NaN for their cosine, and the ids
    themselves tell later whether they are one. Of equal vectors no more than the k of smallest ids are given.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("_id", kind="stable", ignore_index=True)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        size = [x["_vector"].map(len).to_numpy(np.int64) for x in (left, right)]
        for n in np.intersect1d(*size).tolist():
            a, b = left[size[0] == n], right[size[1] == n]
            if not n:
                continue
            x, y = np.stack(a["_vector"].to_numpy()), np.stack(b["_vector"].to_numpy())
            with np.errstate(all="ignore"):
                one, two = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
                kind = np.unique(y + 0.0, axis=0, return_inverse=True)[1].reshape(-1)
                at, to, keys = a["_query"].to_numpy(), b["_found"].to_numpy(), b["_found_key"].to_numpy()
                for lo in range(0, len(x), 256):
                    length = one[lo : lo + 256, None] * two
                    c = x[lo : lo + 256] @ y.T / length
                    c[np.isnan(c)] = np.inf
                    c[length == 0] = -np.inf
                    same = a["_query_key"].to_numpy()[lo : lo + 256, None] == keys
                    c[same] = -np.inf
                    i, j = np.nonzero(same)
                    out.append((at[lo + i], to[j], np.full(len(i), np.nan)))
                    last = np.partition(c, -min(k, len(y)), 1)[:, -min(k, len(y))]
                    i, j = np.nonzero((c >= last[:, None] - SLACK) & (c > -np.inf))
                    order = np.lexsort((j, kind[j], i))
                    i, j = i[order], j[order]
                    first = np.ones(len(i), bool)
                    first[1:] = (i[1:] != i[:-1]) | (kind[j[1:]] != kind[j[:-1]])
                    begin = np.flatnonzero(first)
                    keep = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i)))) < k
                    i, j = i[keep], j[keep]
                    out.append((at[lo + i], to[j], c[i, j]))
        return pd.DataFrame(dict(zip(("_query", "_found", "about"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits each group before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


#: A key with fewer rows needs no join of its own.
HOT_ROWS = 1000


def spread_join(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with `other`, which has one row for a key, without bringing a hot key's rows together.

    A key is hot if it has over HOT_ROWS rows and over one in 4p of all, p being the shuffle partitions; so under 4p keys
    are hot, whatever the size of the input. Their rows of `other` are broadcast, and `rows` stay where they are; all
    others are joined by shuffle. Nulls in keys match nothing. `rows` is read several times: a written table, or a cheap
    view of one. how: inner, left or left_anti.
    """
    p = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*on).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = written(counts.where(F.col("count") > max(HOT_ROWS, total // (4 * p))).select(*on).dropna(), "hot-keys") if total > HOT_ROWS else None
    if hot is None or hot.isEmpty():
        return rows.join(other, on, how)
    wide = rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(other.join(F.broadcast(hot), on, "left_semi")), on, how)
    return wide.unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(other, on, how))
