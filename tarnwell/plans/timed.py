"""Queries on events in time, as tables and as streams, and file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..sources import tables
from ..sources.tables import load
from ..streaming import windows
from .registry import query


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def t01_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rollup_by_time(load(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value")


@query("""
SELECT b AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT value, unnest([time_bucket(INTERVAL 15 MINUTES, ts), time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL 15 MINUTES, time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL 30 MINUTES, time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL 45 MINUTES]) AS b FROM events) GROUP BY b
""")
def t02_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n", "total")


_SESSIONS = """
WITH a AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM a)
"""


@query(_SESSIONS + "SELECT user_id, min(ts) AS began, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY user_id, session")
def t03_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("began"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("user_id", "began", "n", "total")


@query(_SESSIONS + "SELECT event_id, CAST(session AS BIGINT) AS session FROM b")
def t04_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(load(spark, sf_dir, "events"), "user_id", "ts", 1800).select("event_id", F.col("session").cast("long").alias("session"))


@query("""
WITH v AS (SELECT user_id, min(ts) AS t1 FROM events WHERE event_type = 'view' GROUP BY user_id),
c AS (SELECT e.user_id, min(ts) AS t2 FROM events e JOIN v ON e.user_id = v.user_id AND ts > t1 WHERE event_type = 'click' GROUP BY e.user_id),
p AS (SELECT e.user_id, min(ts) AS t3 FROM events e JOIN c ON e.user_id = c.user_id AND ts > t2 WHERE event_type = 'purchase' GROUP BY e.user_id)
SELECT u.user_id, CAST(CASE WHEN t3 IS NOT NULL THEN 3 WHEN t2 IS NOT NULL THEN 2 WHEN t1 IS NOT NULL THEN 1 ELSE 0 END AS INT) AS depth
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN v USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN p USING (user_id)
""")
def t05_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.funnel(load(spark, sf_dir, "events"), "user_id", "ts", "event_type", ["view", "click", "purchase"])


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t06_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.finished(spark, windows.daily(windows.stream(spark, sf_dir)), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("SELECT DISTINCT event_id, event_type, value FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type <> 'view')")
def t07_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most events come twice, by two sources."""
    both = windows.stream(spark, sf_dir).union(windows.stream(spark, sf_dir).where("event_type <> 'view'"))
    return windows.finished(spark, windows.deduplicated(both), "append").select("event_id", "event_type", "value")


@query("SELECT user_id, event_id, value FROM events WHERE event_type = 'error' AND value > 50")
def t08_stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.stream(spark, sf_dir).where("event_type = 'error' and value > 50").select("user_id", "event_id", "value")
    return windows.finished(spark, rows, "append")


@query(_SESSIONS + "SELECT user_id, min(ts) AS began, count(*) AS n FROM b GROUP BY user_id, session")
def t09_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.finished(spark, windows.sessions(windows.stream(spark, sf_dir)), "complete")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("began"), "n")


@query("""
SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
WHERE a.event_type = 'click' AND b.event_type = 'purchase'
""")
def t10_stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind, ts, name: windows.stream(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", F.col("ts").alias(ts), F.col("event_id").alias(name))
    pairs = windows.followed(of("click", "left_ts", "click_id"), of("purchase", "right_ts", "purchase_id"), by="user_id", seconds=3600)
    return windows.finished(spark, pairs.select("click_id", "purchase_id"), "append")


@query("""
WITH a AS (SELECT *, CASE WHEN value > lag(value) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a), c AS (SELECT user_id, run, count(*) AS n FROM b GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(max(n) AS BIGINT) AS longest FROM c GROUP BY user_id
""")
def t11_stream_custom_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.finished(spark, windows.longest_runs(windows.stream(spark, sf_dir)), "update", ["user_id"])


#: Events in the order in which they come: one in ten is 30 hours late, and each batch has what comes in ten days.
_ARRIVALS = """
WITH a AS (SELECT *, CAST(floor((epoch_us(ts) + CASE WHEN event_id % 10 = 3 THEN 108000000000 ELSE 0 END) / 864000000000) AS INT) AS arrival FROM events),
m AS (SELECT arrival, max(ts) AS last FROM a GROUP BY arrival),
w AS (SELECT arrival, date_trunc('milliseconds', max(last) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL 6 HOURS AS mark FROM m)
"""


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.when(F.col("event_id") % 10 == 3, 108_000_000_000).otherwise(0)
    return load(spark, sf_dir, "events").withColumn("arrival", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + late) / 864_000_000_000).cast("int"))


@query(_ARRIVALS + """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM a JOIN w USING (arrival) WHERE mark IS NULL OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > mark GROUP BY ALL
""")
def t12_stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as a stream of several batches sees them: a row that comes after the watermark has passed its day is left out."""
    build = lambda rows: windows.timely(rows, delay="6 hours", width="1 day", by=["event_type"], value="value")
    out = windows.in_arrivals(spark, _arriving(spark, sf_dir), "arrival", build, mode="update", keys=["bucket", "event_type"])
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", F.round("total", 4).alias("total"))


@query(_ARRIVALS + """,
k AS (SELECT a.* FROM a JOIN w USING (arrival) WHERE mark IS NULL OR ts > mark),
g AS (SELECT *, CASE WHEN lag(ts) OVER u IS NULL OR ts - lag(ts) OVER u >= INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM k WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
e AS (SELECT user_id, session, min(ts) AS began, max(ts) AS ended, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session)
SELECT user_id, began, ended, n, total FROM e WHERE ended + INTERVAL 6 HOURS <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 6 HOURS FROM events)
""")
def t13_stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by custom state whose timers give them out; those still open at the end are not there."""
    build = lambda rows: windows.timed_sessions(rows, delay="6 hours", gap_seconds=21_600)
    out = windows.in_arrivals(spark, _arriving(spark, sf_dir), "arrival", build, mode="append")
    return out.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n", F.round("total", 4).alias("total"))


def _round_trip(spark: SparkSession, df: DataFrame, fmt: str, schema: str | None, **options: str) -> DataFrame:
    path = tables.shared_path(spark, fmt)
    tables.write(df, path, fmt, **options)
    return tables.read(spark, path, fmt, schema, **options)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def s01_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "csv", "c_custkey long, c_name string, c_acctbal double", header="true")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def s02_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "json", "c_custkey long, c_name string, c_acctbal double")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def s03_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "orc", None)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
def s04_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.shared_path(spark, "parts")
    tables.write(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, "parquet", partition_by=("o_orderstatus",))
    return spark.read.parquet(path).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT p_name AS value FROM part")
def s05_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, load(spark, sf_dir, "part").select("p_name"), "text", None)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s06_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "xml", "n_nationkey int, n_name string, n_regionkey int", rowTag="nation", rootTag="nations")


@query("""
SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority
""")
def s07_bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables saved in buckets by the order's key, joined where they lie."""
    orders, lines = _bucketed(spark, sf_dir)
    return orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def _bucketed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = tables.save_bucketed(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "orders", ["o_orderkey"], 8)
    return orders, tables.save_bucketed(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount"), "lineitem", ["l_orderkey"], 8)


@query("""
SELECT o_orderstatus, year(o_orderdate) AS year, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' AND year(o_orderdate) = 1996 THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM orders GROUP BY ALL
""")
def s08_dynamic_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in folders by status and year, of which one year's finished orders are written again, twice, with other prices."""
    path = tables.shared_path(spark, "replaced")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("year"))
    tables.replace_partitions(orders, path, ("o_orderstatus", "year"))
    again = orders.where("o_orderstatus = 'F' and year = 1996").withColumn("o_totalprice", 2 * F.col("o_totalprice"))
    for _ in range(2):
        tables.replace_partitions(again, path, ("o_orderstatus", "year"))
    rows = spark.read.schema("o_orderkey long, o_totalprice double, o_orderstatus string, year int").parquet(path)
    return rows.groupBy("o_orderstatus", F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
