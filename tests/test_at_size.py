"""Steps whose work or memory once grew faster than the input, on small tables that show it."""

import random
import time
import tracemalloc
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.functions import personal, text
from tarnwell.llm import linear, mixing
from tarnwell.operators import joins, near_text, passages
from tarnwell.plans import registry
from tarnwell.streaming import windows

from .compare import duck_rows, rows_of
from .conftest import SMALL

START = datetime(2024, 1, 1)


def test_no_sketch_for_every_distinct_key(spark):
    plan = registry.queries()["f16_approximate_distinct"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct" in plan and not [x for x in plan.split("\n") if "keys=[l_partkey" in x and "approx_count_distinct" in x]


def test_top_counts_of_more_users_than_the_sketch_tracks(spark, tmp_path):
    rng = random.Random(8)
    rows = [(START + timedelta(seconds=rng.randrange(86_400)), u) for u in range(25_000) for _ in range(5 if u in (7, 24_999) else 4 if u == 3 else 1 + u % 2)]
    df = spark.createDataFrame([(i, t, u, float(i % 97)) for i, (t, u) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows_of(registry.queries()["q50_sketch_columns"](spark, str(tmp_path))) == duck_rows(con, registry.oracle_sql()["q50_sketch_columns"])


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_range_join_deals_a_bucket_by_its_pairs(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "PAIRS", 500, raising=False)
    left = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("x")).union(spark.createDataFrame([(5000, 99.0), (5001, None)], "id long, x double"))
    right = spark.createDataFrame([(r, r / 10, r / 10 + 3) for r in range(20)], "r int, lo double, hi double")
    got = joins.range_join(left, right, value="x", low="lo", high="hi", width=50.0, how=how)
    plain = left.join(right, F.col("x").between(F.col("lo"), F.col("hi")), how)
    assert got.columns == plain.columns and sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    if how == "inner":
        most = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(most) < sum(most) / 10


@pytest.mark.parametrize("block", [7, 5000])
def test_nearest_vectors_equal_all_pairs(spark, monkeypatch, block):
    """Copies, zero and incomplete vectors, other lengths, ids that repeat: as by comparing all pairs; no nested loop."""
    monkeypatch.setattr(joins, "BLOCK", block, raising=False)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(60)] + [(i, [1.0, 2.0, 3.0]) for i in range(60, 80)]
    rows += [(80, [0.0, 0.0, 0.0]), (81, None), (82, [1.0, None, 2.0]), (83, [1.0, 2.0]), (84, [2.0, 1.0]), (None, [1.0, 2.0, 3.0]), (5, [3.0, 2.0, 1.0]), (85, []), (0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    score = lambda a, b: F.round(text.cosine(a, b), 9)
    found = joins.nearest_vectors(df.where("id % 5 = 0"), df, id_col="id", vector_col="v", k=4, cosine=score, most=6)
    q = df.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("w"))
    pairs = q.join(df, F.col("query_id") != F.col("id")).select("query_id", F.col("id").alias("found_id"), score(F.col("w"), F.col("v")).alias("score")).where("score is not null")
    plain = joins.top_per_group(pairs, ["query_id"], [F.desc("score"), F.asc("found_id")], 4)
    assert rows_of(found) == rows_of(plain)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_sessions_of_many_users_in_few_buckets(spark):
    rng = random.Random(6)
    rows = [(a, START + timedelta(hours=10 * a, seconds=rng.randrange(36_000)), rng.choice([None, *range(40)]), 1.0) for a in range(3) for _ in range(500)]
    rows.append((3, START + timedelta(hours=100), 99, 1.0))
    table = spark.createDataFrame(rows, "arrival int, ts timestamp_ntz, user_id long, value double")
    build = lambda x: windows.timed_sessions(x, delay="11 hours", gap_seconds=1800, buckets=2)
    got = windows.in_arrivals(spark, table, "arrival", build, mode="append").select("user_id", F.col("began").cast("timestamp_ntz").alias("b"), F.col("ended").cast("timestamp_ntz").alias("e"), "n", "total")
    want = []
    for u in {r[2] for r in rows} - {99}:
        for t in sorted(r[1] for r in rows if r[2] == u):
            if want and want[-1][0] == u and t - want[-1][2] < timedelta(seconds=1800):
                want[-1][2:] = [t, want[-1][3] + 1, want[-1][4] + 1.0]
            else:
                want.append([u, t, t, 1, 1.0])
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, map(tuple, want)))


def test_python_gets_bounded_batches(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.unset(n)
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    passages.without_repeated_lines(df, id_col="doc_id", text_col="text", documents=2)
    got = [spark.conf.get(n) for n in names]
    for n, x in zip(names, old, strict=True):
        spark.conf.set(n, x)
    assert got == ["500", "16m"]


def test_labels_of_absent_documents_leave_the_sample_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mixing, "PER_DOMAIN", 50)
    monkeypatch.setattr(linear, "fitted", lambda sample, *_: seen.append(sample.groupBy("domain").count().collect()))
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labelled = spark.range(10_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("domain"))
    mixing.trained(docs, labelled)
    assert {r.domain: r["count"] for r in seen[0]} == {"a": 50, "b": 50}


def test_choice_of_features_holds_counts_not_texts():
    """Its memory over that of 1 MB of texts must not grow with the texts."""
    rng = np.random.default_rng(5)
    book = ["".join(map(chr, rng.integers(97, 123, rng.integers(3, 11)))) for _ in range(20_000)]
    texts = [" ".join(rng.choice(book, 1500)).encode() for _ in range(400)]
    peaks = []
    for some in (texts[:100], texts):
        tracemalloc.start()
        linear.choose(some, np.arange(len(some)) % 2, 2_000)
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 10


def test_pairs_of_a_loose_group_are_not_compared_by_their_texts(spark, monkeypatch):
    """With 60 bands of one row all texts of the group share buckets, and no two of them are near 0.8."""
    rng = random.Random(4)
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    common, seen, verified = words(60), [], near_text._verified
    monkeypatch.setattr(near_text, "_verified", lambda pairs, *a: (seen.append(pairs.count()), verified(pairs, *a))[1])
    rows = [(i, f"{common} {words(60)}") for i in range(60)] + [(60, f"{common} same"), (61, f"{common} other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_text.near_duplicates(df, id_col="doc_id", text_col="text", bands=60, rows=1).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: min(i, 60) for i in range(62)}
    assert sum(seen) < 60


def test_parity_maps_leave_out_no_pair_that_links(spark):
    rng = random.Random(9)
    sign, texts = near_text.signer(1, 1, 1, maps=True), []
    for size in (1, 4, 9, 60, 600, 6000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts += [" ".join(base[k:] + [f"v{rng.randrange(10**6)}" for _ in range(k)]) for k in range(0, size // 5 + 1, max(1, size // 30))]
    df = spark.createDataFrame([(i, n, bits, t) for i, (t, (n, _, bits)) in enumerate(zip(texts, sign(texts), strict=True))], "i int, n int, bits array<long>, t string")
    both = df.join(df.select(*(F.col(c).alias(f"{c}_") for c in df.columns)), F.col("i") < F.col("i_"))
    got = both.select("i", "i_", near_text.alike(1, 80)("t", "t_").alias("close"), near_text.may_link(F.col("n"), F.col("bits"), F.col("n_"), F.col("bits_"), 80).alias("may")).collect()
    assert sum(r.close for r in got) > 15 and sum(not r.may for r in got) > 100 and all(r.may for r in got if r.close)


@pytest.mark.parametrize("text", ["9" * 300_000, "a" * 300_000, "1.2 " * 40 + "a.b" * 100_000])
def test_long_runs_are_read_once_for_personal_data(text):
    began = time.process_time()
    spans = personal.found(text + " a@b_c@d.e 1.2.3.4.x")
    assert [s[::3] for s in spans] == [("mail", "_c@d.e"), ("ip", "1.2.3.4")] and time.process_time() - began < 5
