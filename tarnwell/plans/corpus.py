"""Queries over the documents as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import personal
from ..operators import near_text, passages
from ..sources.tables import load, ready
from .registry import query


@query(r"""
WITH RECURSIVE w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE regexp_matches(text, '\S')),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)
      UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y USING (text) WHERE x.doc_id <> y.doc_id),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m ON v = doc_id LEFT JOIN n USING (doc_id)
""")
def c01_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of five words, Jaccard similarity of 0.8 or more."""
    return near_text.near_duplicates(load(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")


@query("""
WITH l AS (SELECT doc_id, i, x, trim(x, ' ') AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(f.k) AS INT) AS n_repeated, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '') AS text
FROM l LEFT JOIN f USING (k) GROUP BY doc_id
""")
def c02_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that five documents or more have are left out."""
    return passages.without_repeated_lines(load(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", documents=5)


@query(r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
y AS (SELECT item_id, size, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT item_id, w, len(w) AS size, unnest(range(1, len(w) - 6)) AS i FROM b)),
h AS (SELECT DISTINCT doc_id, item_id, size, x.i AS p, y.i AS q FROM x JOIN y USING (g)),
c AS (SELECT doc_id, item_id, count(DISTINCT k) AS covered FROM (SELECT doc_id, item_id, unnest(range(q, q + 8)) AS k FROM h) GROUP BY ALL),
s AS (SELECT doc_id, item_id, size, count(*) FILTER (WHERE before IS NULL OR before <> p - 1) AS n_spans, min(p) - 1 AS first_word, max(p) + 7 AS end_word
      FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id, item_id ORDER BY p) AS before FROM (SELECT DISTINCT doc_id, item_id, size, p FROM h)) GROUP BY ALL)
SELECT doc_id, item_id, CAST(size AS INT) AS item_words, CAST(covered AS INT) AS covered, covered / size AS share, CAST(n_spans AS INT) AS n_spans, CAST(first_word AS INT) AS first_word, CAST(end_word AS INT) AS end_word
FROM s JOIN c USING (doc_id, item_id)
""")
def c03_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents have runs of eight words of a benchmark item, and how much of the item that is."""
    return passages.item_overlap(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), doc_id="doc_id", item_id="item_id", text_col="text", n=8)


@query(r"""
WITH c AS (
  SELECT doc_id, 'card' AS kind, unnest(regexp_extract_all(text, '[0-9]+')) AS v FROM documents
  UNION ALL SELECT doc_id, 'iban', unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) FROM documents
  UNION ALL SELECT doc_id, 'ip', unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)+')) FROM documents
  UNION ALL SELECT doc_id, 'mail', unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*')) FROM documents
  UNION ALL SELECT doc_id, 'secret', unnest(regexp_extract_all(text, '(?:token|secret|password|api_key) *[=:] *["'']([A-Za-z0-9+/=_-]*)["'']', 1)) FROM documents),
d AS (SELECT *, list_reverse(string_split(v, '')) AS r, list_distinct(string_split(v, '')) AS u FROM c),
k AS (SELECT doc_id, kind, v FROM d WHERE CASE kind
  WHEN 'card' THEN len(v) BETWEEN 13 AND 19 AND list_sum(list_transform(r, lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT ELSE (2 * x::INT) // 10 + (2 * x::INT) % 10 END)) % 10 = 0
  WHEN 'iban' THEN CASE WHEN regexp_full_match(v, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}') THEN list_reduce(list_prepend(0, list_transform(string_split(v[5:] || v[1:4], ''), lambda x: CASE WHEN x <= '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END)), lambda s, x: (s * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1 ELSE false END
  WHEN 'ip' THEN regexp_full_match(v, '(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}')
  WHEN 'mail' THEN regexp_full_match(v, '[A-Za-z0-9_%+-]+(\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')
  ELSE len(v) >= 16 AND -list_sum(list_transform(u, lambda y: len(list_filter(r, lambda z: z = y)) / len(v) * log2(len(list_filter(r, lambda z: z = y)) / len(v)))) >= 3.0 END)
SELECT doc_id, kind, v AS value, count(*) AS n FROM k GROUP BY ALL
""")
def c04_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards, account numbers, addresses, mail names and secrets that pass their checks, by document."""
    docs = load(ready(spark), sf_dir, "documents")
    spans = docs.select("doc_id", F.inline(personal.checked()("text")["spans"]))
    return spans.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def c05_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts by MD5; copies are summed up before the shuffle."""
    return load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
