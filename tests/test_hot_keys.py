"""Blocked windows, percentiles by ranges, sketches, buckets and replaced folders against plain versions, with odd rows."""

import random
import statistics
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import blocks, joins, quantiles, sketches
from tarnwell.plans import timed
from tarnwell.sources import tables

from .conftest import SMALL

START = datetime(2024, 1, 1)


def rows(n=400, seed=4):
    """(k, t, id, v): half of the rows have one key; null keys and values, ties in time."""
    rng = random.Random(seed)
    return [(1 if i % 2 else rng.choice([2, 3, None]), START + timedelta(seconds=rng.randrange(0, 4000, 7)), i, rng.choice([None, 1.0, 2.5, -4.0])) for i in range(n)]


def frame(spark, found):
    return spark.createDataFrame(found, "k int, t timestamp_ntz, id int, v double")


@pytest.mark.parametrize("size", [7, 50, 10**6])
def test_running_over_blocks(spark, size):
    found = rows()
    got = {r.id: (r.running_sum, r.running_count) for r in blocks.running(frame(spark, found), by=["k"], order=["t", "id"], value="v", rows=size).collect()}
    held = defaultdict(lambda: [None, 0])
    for k, _, i, v in sorted(found, key=lambda r: (r[1], r[2])):
        s = held[k]
        if v is not None:
            s[0], s[1] = (s[0] or 0) + v, s[1] + 1
        assert got[i] == tuple(s)
    assert len(got) == len(found)


@pytest.mark.parametrize("size", [7, 50, 10**6])
def test_sessions_over_blocks(spark, size):
    found = rows(300)
    got = blocks.sessions(frame(spark, found), by=["k"], time="t", gap_seconds=60, rows=size)
    assert got.columns == ["k", "t", "id", "v", "session"]
    last, number = {}, defaultdict(int)
    want = {}
    for k, t, i, _ in sorted(found, key=lambda r: r[1]):
        number[k] += k not in last or (t - last[k]).total_seconds() >= 60
        last[k], want[i] = t, number[k]
    assert {r.id: r.session for r in got.collect()} == want


@pytest.mark.parametrize("size", [7, 10**6])
def test_asof_over_blocks(spark, size):
    left, right = frame(spark, rows(200, 1)), frame(spark, rows(200, 2)).select("k", F.col("t").alias("rt"), F.col("id").alias("rid"))
    args = dict(by=["k"], left_time="t", right_time="rt", values=["rid"])
    got, want = blocks.asof(left, right, **args, rows=size).collect(), joins.asof_join(left, right, **args).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and any(r.rid for r in want)


def test_blocks_of_a_hot_key_are_even_and_empty_tables_stay_empty(spark):
    found = frame(spark, rows(4000))
    n = [r["count"] for r in blocks.dealt(found, ["k"], ["t", "id"], 100).groupBy("_block").count().collect()]
    assert len(n) > 20 and max(n) < 400
    none = found.limit(0)
    assert blocks.running(none, by=["k"], order=["t"], value="v").count() == blocks.sessions(none, by=["k"], time="t", gap_seconds=1).count() == 0


def plain_percentile(values, f):
    values = sorted(values)
    at = f * (len(values) - 1)
    low, high = values[int(at)], values[-(-at // 1).__int__() if at % 1 else int(at)]
    return low + (high - low) * (at - int(at))


@pytest.mark.parametrize("few,accuracy", [(10_000, 10_000), (5, 10_000), (1, 50)])
def test_exact_percentiles(spark, few, accuracy):
    rng = random.Random(3)
    found = [("even", float(i)) for i in range(1000)] + [("skew", 10.0 ** rng.randint(-300, 300)) for _ in range(700)] + [("ties", rng.choice([1.0, 1.0, 1.0, 2.0])) for _ in range(500)]
    found += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None), ("nan", float("nan")), (None, 3.0), (None, 4.0), ("sign", -0.0), ("sign", 0.0), ("sign", -1.0)]
    fractions = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]
    df = spark.createDataFrame(found, "g string, v double").repartition(3)
    got = {(r.g, r.fraction): (r.n, r.percentile) for r in quantiles.exact_percentiles(df, by=["g"], value="v", fractions=fractions, few=few, accuracy=accuracy).collect()}
    by = defaultdict(list)
    for g, v in found:
        if v is not None and v == v:
            by[g].append(v)
    assert set(got) == {(g, f) for g in by for f in fractions}
    for (g, f), (n, p) in got.items():
        want = plain_percentile(by[g], f)
        assert n == len(by[g]) and (p == want or abs(p - want) <= 1e-12 * abs(want)), (g, f)
    assert got["even", 0.5][1] == statistics.median(by["even"])


def test_percentiles_without_groups_or_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    assert [r.percentile for r in quantiles.exact_percentiles(df, by=[], value="v", fractions=[0.5], few=3).collect()] == [49.5]
    assert quantiles.exact_percentiles(df.limit(0), by=[], value="v", fractions=[0.5]).count() == 0


def test_sketches_beyond_their_exact_size(spark):
    """30,000 items, of which 10,000 come back: estimates are off, but within bounds; ranks of the median too."""
    day = lambda d, lo, hi: spark.range(lo, hi).select(F.expr(f"timestamp_ntz'2024-01-0{d} 00:00:00' + make_interval(0, 0, 0, 0, cast(id % 24 as int), 0, 0)").alias("ts"), F.col("id").alias("item"), (F.col("id") % 1000).cast("double").alias("value"))
    df = day(1, 0, 30_000).union(day(2, 20_000, 50_000))
    hourly = sketches.sketched(df, time="ts", width="1 hour", by=[], item="item", value="value")
    assert hourly.count() == 48
    days = sketches.with_returning(sketches.merged(hourly, width="1 day", by=[]), width="1 day", by=[])
    got = {r.bucket.day: r for r in days.select("bucket", "n", F.theta_sketch_estimate("items").alias("items"), F.theta_sketch_estimate("returning").alias("back"), F.kll_sketch_get_quantile_double("values", F.lit(0.5)).alias("median")).collect()}
    assert got[1].back is None and all(r.n == 30_000 for r in got.values())
    for r in got.values():
        assert r["items"] != 30_000 and abs(r["items"] - 30_000) < 0.05 * 30_000 and abs((r.median + 0.5) / 1000 - 0.5) < sketches.RANK_ERROR + 0.001
    assert abs(got[2].back - 10_000) < 0.05 * 30_000


def test_bucketed_join_has_no_exchange_below_it(spark):
    orders, lines = timed._bucketed(spark, SMALL)
    joined = orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan


def test_replaced_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "v int, p string")
    tables.replace_partitions(first, path, ("p",))
    tables.replace_partitions(spark.createDataFrame([(9, "a"), (7, "c")], "v int, p string"), path, ("p",))
    assert sorted((r.v, r.p or "") for r in spark.read.schema("v int, p string").parquet(path).collect()) == [(3, "b"), (4, ""), (7, "c"), (9, "a")]
