"""Queries on functions: strings, dates, JSON, arrays, maps, vectors, user functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, udfs
from ..sources.tables import load
from .registry import query


@query("""
SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS INT) AS n, reverse(p_type) AS rev, lpad(CAST(p_size AS VARCHAR), 4, '0') AS pad, replace(p_brand, 'Brand#', 'B') AS brand,
       regexp_extract(p_brand, '([0-9]+)', 1) AS num, md5(p_name) AS h, substr(p_name, 2, 3) AS part, translate(p_type, 'AEIOU', '12345') AS tr, CAST(levenshtein(p_name, p_type) AS INT) AS lev,
       sha256(p_type) AS sha FROM part
""")
def f01_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("up"), F.length("p_name").alias("n"), F.reverse("p_type").alias("rev"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("pad"), F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("brand"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("num"), F.md5("p_name").alias("h"), F.substring("p_name", 2, 3).alias("part"), F.translate("p_type", "AEIOU", "12345").alias("tr"), F.levenshtein("p_name", "p_type").alias("lev"), F.sha2("p_type", 256).alias("sha"))


@query("""
SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(last_day(o_orderdate) AS DATE) AS last, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q,
       CAST(dayofweek(o_orderdate) + 1 AS INT) AS dow, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days, strftime(o_orderdate, '%Y-%m') AS ym FROM orders
""")
def f02_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.date_trunc("month", d).cast("timestamp_ntz").alias("month"), F.last_day(d).alias("last"), F.year(d).alias("y"), F.quarter(d).alias("q"), F.dayofweek(d).alias("dow"), F.datediff(d.cast("date"), F.lit("1995-01-01").cast("date")).alias("days"), F.date_format(d, "yyyy-MM").alias("ym"))


@query("""
SELECT c_custkey, round(abs(c_acctbal), 1) AS a, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c, CAST(c_custkey % 7 AS BIGINT) AS m, round(sqrt(abs(c_acctbal)), 6) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l,
       greatest(c_acctbal, 0.0) AS g, nullif(c_nationkey, 3) AS nk, coalesce(nullif(c_nationkey, 3), -1) AS ck FROM customer
""")
def f03_math_and_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    k = F.nullif(F.col("c_nationkey"), F.lit(3))
    return load(spark, sf_dir, "customer").select("c_custkey", F.round(F.abs(b), 1).alias("a"), F.floor(b).alias("f"), F.ceil(b).alias("c"), (F.col("c_custkey") % 7).alias("m"), F.round(F.sqrt(F.abs(b)), 6).alias("s"), F.round(F.log(F.abs(b) + 1), 6).alias("l"), F.greatest(b, F.lit(0.0)).alias("g"), k.alias("nk"), F.coalesce(k, F.lit(-1)).alias("ck"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS twice FROM events")
def f04_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").select("event_id", k.alias("k"), (F.from_json("props", "k long")["k"] * 2).alias("twice"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def f05_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS norm2, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive,
       CAST(len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS BOOLEAN) AS any_large, embedding[1] AS head FROM embeddings
""")
def f06_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(F.transform(e, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x), 5).alias("norm2"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"), F.exists(e, lambda x: x > 0.3).alias("any_large"), F.element_at(e, 1).alias("head"))


@query("SELECT user_id, CAST(coalesce(sum(CASE WHEN event_type = 'click' THEN 1 END), 0) AS BIGINT) AS clicks, CAST(count(DISTINCT event_type) AS INT) AS kinds FROM events GROUP BY user_id")
def f07_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return by.select("user_id", F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"), F.size(F.map_keys("m")).alias("kinds"))


@query("SELECT conv_id, string_agg(role || ':' || CAST(length(text) AS VARCHAR), '|' ORDER BY turn) AS outline, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id")
def f08_ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("x"))))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda s: s["x"]), "|").alias("outline"), F.count("*").alias("turns"))


@query("""
SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(string_split(html, '<a ')) - 1 AS INT) AS links,
       trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS plain FROM pages
""")
def f09_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (F.size(F.split("html", "<a ")) - 1).alias("links"), text.tags_stripped(F.col("html")).alias("plain"))


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '<email>', 'g') AS masked FROM documents")
def f10_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.mask_emails(F.col("text")).alias("masked"))


@query("""
SELECT label, round(avg(c), 5) AS mean_cosine FROM (
  SELECT a.label, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: CAST(t[1] AS DOUBLE) * CAST(t[2] AS DOUBLE)))
    / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS c
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY label
""")
def f11_vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").groupBy("label").agg(F.round(F.avg(text.cosine(F.col("embedding"), F.col("other"))), 5).alias("mean_cosine"))


@query("SELECT event_id, value * 1.5 AS scaled FROM events")
def f12_pandas_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", udfs.scaled("value").alias("scaled"))


@query("SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY event_type")
def f13_pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(udfs.spread("value").alias("spread"))


@query("SELECT event_type, event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def f14_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.z_scores(load(spark, sf_dir, "events"), "event_type", "value").select("event_type", "event_id", F.round("z", 6).alias("z"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, CAST(generate_subscripts(string_split(p_name, ' '), 1) - 1 AS INT) AS at FROM part")
def f15_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    return parts.lateralJoin(udfs.Words(F.col("p_name").outer())).select("p_partkey", "word", "at")


@query("SELECT count(DISTINCT l_partkey) AS n, true AS near FROM lineitem")
def f16_approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact count, and whether the estimate is within five of its standard errors of 1 %."""
    # Each by itself: in one aggregation Spark keeps a sketch for every distinct key that it counts.
    keys = load(spark, sf_dir, "lineitem").select("l_partkey")
    rows = keys.distinct().agg(F.count("l_partkey").alias("n")).crossJoin(keys.agg(F.approx_count_distinct("l_partkey", 0.01).alias("est")))
    return rows.select("n", (F.abs(F.col("est") - F.col("n")) <= 0.05 * F.col("n") + 1).alias("near"))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.7 * a + 0.3 * x), 6) AS last FROM events GROUP BY user_id")
def f17_apply_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.smoothed(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 0.3).select("user_id", F.round("last", 6).alias("last"))


@query("""
SELECT page_id, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '') AS protocol, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') AS host,
       CASE WHEN strpos(split_part(url, '#', 1), '?') > 0 THEN substr(split_part(url, '#', 1), strpos(split_part(url, '#', 1), '?') + 1) END AS query,
       CASE WHEN strpos(url, '#') > 0 THEN substr(url, strpos(url, '#') + 1) END AS ref FROM pages
""")
def f18_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda what: F.try_parse_url(F.col("url"), F.lit(what))
    return load(spark, sf_dir, "pages").select("page_id", part("PROTOCOL").alias("protocol"), part("HOST").alias("host"), part("QUERY").alias("query"), part("REF").alias("ref"))


@query("""
SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS next_month, CAST(date_diff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS months,
       CAST(date_trunc('month', o_orderdate) + INTERVAL 14 DAY AS DATE) AS middle, CAST(o_orderdate AS DATE) - 7 AS week_ago FROM orders
""")
def f19_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    months = ((F.year(d) - 1995) * 12 + F.month(d) - 1).cast("int")
    return load(spark, sf_dir, "orders").select("o_orderkey", (d + F.expr("INTERVAL 1 MONTH")).alias("next_month"), months.alias("months"), F.date_add(F.trunc(d, "month"), 14).alias("middle"), F.date_sub(d.cast("date"), 7).alias("week_ago"))


@query("""
SELECT event_id, '{"id":' || CAST(event_id AS VARCHAR) || ',"kind":"' || event_type || '"}' AS doc, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1 FROM events
""")
def f20_json_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    rows = e.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("doc"), F.parse_json("props").alias("v"), F.json_tuple("props", "k").alias("k"))
    return rows.select("event_id", "doc", "k", (F.variant_get("v", "$.k", "long") + 1).alias("k1"))


@query("""
SELECT user_id, CAST(count(*) FILTER (WHERE n > 2) AS INT) AS frequent, CAST(sum(CASE WHEN n > 2 THEN n * 10 END) AS BIGINT) AS tens, bool_and(n > 0) AS all_positive
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id
""")
def f21_maps_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    tens = F.transform_values(F.map_filter("m", lambda k, v: v > 2), lambda k, v: v * 10)
    total = F.aggregate(F.map_values(tens), F.lit(None).cast("long"), lambda s, x: F.coalesce(s, F.lit(0).cast("long")) + x)
    return by.select("user_id", F.size(tens).alias("frequent"), total.alias("tens"), F.forall(F.map_values("m"), lambda v: v > 0).alias("all_positive"))


@query()
def f22_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: DuckDB lacks these functions; a test compares with zlib and xxhash."""
    return load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", F.crc32(F.col("p_name").cast("binary")).alias("crc"), F.xxhash64("p_name").alias("xx"), F.soundex("p_type").alias("sound"))


@query(r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') AS q FROM pages)
SELECT page_id, scheme || '://' || regexp_replace(host, CASE scheme WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE ':$' END, '') || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM u
""")
def f23_url_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.normal_url(F.col("url")).alias("url"))


@query("""SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links, CAST(len(regexp_extract_all(html, '<[a-z]+')) AS INT) AS tags FROM pages""")
def f24_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return load(spark, sf_dir, "pages").select("page_id", links.alias("links"), F.size(F.regexp_extract_all("html", F.lit("<[a-z]+"), F.lit(0))).alias("tags"))
