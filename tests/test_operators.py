"""Operators on small tables with nulls, ties and empty sides."""

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import text
from tarnwell.operators import events, joins
from tarnwell.sources import tables


def test_asof_join_ties_nulls_and_no_match(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 7), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 6, 60), (1, 10, 99), (1, 10, 100), (None, 1, 7), (3, 1, 1)], "k int, rt int, v int")
    got = {(r.k, r.t): r.v for r in joins.asof_join(left, right, by=["k"], left_time="t", right_time="rt", values=["v"]).collect()}
    assert got == {(1, 10): 100, (1, 5): None, (2, 7): None, (None, 3): 7}


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_range_join(spark, how):
    left = spark.createDataFrame([(i, float(i)) for i in range(-5, 30)], "id int, x double")
    right = spark.createDataFrame([(0, -3.0, 2.5), (1, 2.0, 21.0), (2, 40.0, 41.0)], "r int, lo double, hi double")
    got = joins.range_join(left, right, value="x", low="lo", high="hi", width=4.0, how=how)
    pairs = [(i, r) for i in range(-5, 30) for r, lo, hi in ((0, -3.0, 2.5), (1, 2.0, 21.0)) if lo <= i <= hi]
    if how == "inner":
        assert sorted((r.id, r.r) for r in got.collect()) == sorted(pairs)
    else:
        hit = {i for i, _ in pairs}
        assert sorted(r.id for r in got.collect()) == sorted(i for i in range(-5, 30) if (i in hit) == (how == "left_semi"))


def test_salted_join_equals_join(spark):
    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (None, 2)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, w string")
    assert sorted(map(tuple, joins.salted_join(big, small, "k", 3).select("k", "v", "w").collect())) == sorted(map(tuple, big.join(small, "k").select("k", "v", "w").collect()))


def test_sessions_gap_is_inclusive(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00'), (1, timestamp_ntz'2024-01-01 00:29:59'), (1, timestamp_ntz'2024-01-01 00:59:59'), (2, timestamp_ntz'2024-01-01 00:00:00') t(k, ts)")
    assert sorted((r.k, r.session) for r in events.sessions(rows, "k", "ts", 1800).collect()) == [(1, 1), (1, 1), (1, 2), (2, 1)]


def test_functions(spark):
    row = spark.sql("SELECT 'a b  c' AS t, array(1.0, 0.0) AS x, array(1.0, 1.0) AS y, array(0.0, 0.0) AS z")
    got = row.select(text.word_ngrams(F.col("t"), 2).alias("g"), text.word_ngrams(F.col("t"), 9).alias("none"), text.cosine(F.col("x"), F.col("y")).alias("c"), text.cosine(F.col("x"), F.col("z")).alias("n")).first()
    assert got.g == ["a b", "b c"] and got.none == [] and abs(got.c - 0.5**0.5) < 1e-12 and got.n is None


def test_normal_urls(spark):
    cases = {
        "HTTP://Ex.Com:80": "http://ex.com/", "https://a.b:443/x?b=2&&a=1#top": "https://a.b/x?a=1&b=2", "https://a.b:80/": "https://a.b:80/", "http://a?": "http://a/",
        "ftp://U@H:/P?q": "ftp://u@h/P?q", "no scheme": "no scheme", "": "", "http://": "http:///", "http://a/é?x#": "http://a/é?x", None: None,
    }
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i int, u string")
    assert {r.u: r.n for r in rows.select("u", text.normal_url(F.col("u")).alias("n")).collect()} == cases


def test_sources_ask_for_schemas(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    for fmt in ("json", "parquet", "orc"):
        tables.write(df, f"{tmp_path}/{fmt}", fmt)
        assert sorted(tables.read(spark, f"{tmp_path}/{fmt}", fmt, "a int, b string").collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        tables.read(spark, f"{tmp_path}/json", "json")


def test_funnel_ties_and_no_steps(spark):
    """Two steps at one time are not one after the other; whoever takes no step has depth 0."""
    rows = [(1, 1, "click"), (1, 1, "purchase"), (2, 1, "click"), (2, 2, "click"), (2, 3, "purchase"), (3, 1, "other"), (4, 1, "purchase"), (4, 2, "click"), (5, None, "click")]
    got = {r.k: r.depth for r in events.funnel(spark.createDataFrame(rows, "k int, t int, e string"), "k", "t", "e", ["click", "purchase"]).collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 1, 5: 1}


def test_interval_join_at_bucket_edges(spark):
    ts = lambda s: f"timestamp_ntz'2024-01-01 00:00:{s:02}'"
    a = spark.sql("SELECT * FROM VALUES " + ", ".join(f"(1, {ts(s)}, {s})" for s in range(0, 40, 3)) + " t(k, lt, l)")
    b = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({1 + s % 2}, {ts(s)}, {s})" for s in range(40)) + " t(k, rt, r)")
    got = sorted((r.l, r.r) for r in joins.interval_join(a, b, by="k", left_time="lt", right_time="rt", seconds=10).collect())
    assert got == sorted((x, y) for x in range(0, 40, 3) for y in range(0, 40, 2) if 0 < y - x <= 10)


def test_salted_join_salts_only_hot_keys(spark):
    big = spark.createDataFrame([(1, i) for i in range(90)] + [(i, i) for i in range(2, 12)], "k int, v int")
    small = spark.createDataFrame([(i, str(i)) for i in range(12)], "k int, w string")
    assert sorted(map(tuple, joins.salted_join(big, small, "k", 4, share=0.5).collect())) == sorted(map(tuple, big.join(small, "k").collect()))
    assert joins.salted_join(big.limit(0), small, "k", 4).count() == 0


def test_nearest_vectors_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0])], "id int, v array<double>")
    got = [(r.query_id, r.found_id) for r in joins.nearest_vectors(df.where("id in (1, 5)"), df, id_col="id", vector_col="v", k=2, cosine=text.cosine).collect()]
    assert sorted(got) == [(1, 2), (1, 3)]


def test_nearest_vectors_in_slices(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id int, v array<double>")
    args = dict(id_col="id", vector_col="v", k=3, cosine=lambda a, b: F.round(text.cosine(a, b), 9))
    whole, sliced = (joins.nearest_vectors(df.where("id < 20"), df, **args, most=m).collect() for m in (1000, 4))
    assert sorted(whole) == sorted(sliced) and len(whole) == 60


def test_jdbc_round_trip(spark, tmp_path):
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no database driver on the class path")
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "ID int, NAME string")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    tables.write_jdbc(df, url, "T")
    back = tables.read_jdbc(spark, url, "T", column="ID", lower=0, upper=20, parts=3)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect())) and back.rdd.getNumPartitions() == 3


def test_shared_path_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    fake = lambda master, base: SimpleNamespace(conf={"spark.checkpoint.dir": base} if base else {}, sparkContext=SimpleNamespace(master=master))
    assert tables.shared_path(fake("spark://x:7077", "hdfs://y/z"), "n").startswith("hdfs://y/z/n-")
    assert "tarnwell-files" in tables.shared_path(fake("local[4]", None), "n")
    with pytest.raises(ValueError):
        tables.shared_path(fake("local-cluster[2,1,1024]", None), "n")
