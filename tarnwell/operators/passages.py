"""Passages that texts share: lines that repeat over a corpus, and runs of words of given items."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import runs as R
from ..functions.text import let
from ..sources.tables import ready, written
from .joins import spread_join

#: What parts words: ASCII white space.
WHITE = r"[ \t\n\x0B\f\r]+"


def line_key(line: Column) -> Column:
    """What tells lines apart: the SHA-256 of the line without blanks at its ends."""
    return F.unhex(F.sha2(F.trim(line).cast("binary"), 256))


def without_repeated_lines(docs: DataFrame, *, id_col: str, text_col: str, documents: int) -> DataFrame:
    """For each row its id, n_lines, n_repeated and its text without the lines that at least so many rows have.

    Lines end at a line feed and are compared without blanks (U+0020) at their ends; blank ones are never repeated and
    stay. A row counts once for a line, however often it has it. Counts are summed up before the shuffle, so a line that
    all rows have is one sum for each task; repeated lines are joined back to their rows with the most frequent ones
    spread, and a row gets only the keys of its own. Null texts stay null with no lines. Rows that share an id are rows each.
    """
    ready(docs.sparkSession)
    docs = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "line-texts")
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\\n"), lambda x: F.trim(x) != ""), line_key))
    pairs = written(docs.select("row", F.explode(lines).alias("line")), "lines")
    frequent = written(pairs.groupBy("line").count().where(F.col("count") >= documents).select("line"), "frequent-lines")
    own = spread_join(pairs, frequent, ["line"]).groupBy("row").agg(F.collect_list("line").alias("gone"))

    @F.pandas_udf("n_lines int, n_repeated int, text string")
    def kept(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, keys in zip(texts, gone, strict=True):
            if text is None:
                out.append((0, 0, None))
                continue
            found = text.split("\n")
            if keys is None:
                out.append((len(found), 0, text))
                continue
            have = {bytes(k) for k in keys}
            stay = [x for x in found if hashlib.sha256(x.strip(" ").encode("utf-8", "surrogatepass")).digest() not in have]
            out.append((len(found), len(found) - len(stay), "\n".join(stay)))
        return pd.DataFrame(out, columns=["n_lines", "n_repeated", "text"])

    return docs.join(own, "row", "left").select("id", kept("text", "gone").alias("k")).select(F.col("id").alias(id_col), "k.*")


def item_overlap(docs: DataFrame, items: DataFrame, *, doc_id: str, item_id: str, text_col: str, n: int, most: int = 500_000) -> DataFrame:
    """For each pair of a document and an item that share a run of n words: item_words, covered, share, n_spans, first_word, end_word.

    Words are parted by white space and lower-cased. `covered` is the number of the item's words in shared runs and `share`
    that over all its words; n_spans is the number of maximal stretches of the document in which every run of n words is one
    of the item's, and first_word to end_word is where they lie, words from 0. Items of fewer than n words are in one run, their
    own. A document's runs are first held against the hashes of the items' runs, which are sent to the tasks if they are at
    most `most` (8 bytes each); what passes, or beyond that bound all of them, is joined by the words themselves. Null texts
    share nothing. Rows that share an id are rows each.
    """
    ready(docs.sparkSession)
    lower = F.lower(F.col(text_col).cast("string"))
    item = items.select(F.col(item_id).alias("item"), lower.alias("text"))
    item = item.withColumn("item_words", F.size(F.filter(F.split("text", WHITE), lambda w: w != ""))).where("item_words > 0").withColumn("k", F.least(F.lit(n), "item_words"))
    sizes = sorted(r.k for r in item.select("k").distinct().collect())  # at most n
    item = item.select("item", "item_words", "k", F.inline(R.runs_among(None, sizes)("text"))).where("size = k")
    item = written(item.select("item", "item_words", "size", F.col("place").alias("at"), "hash", "run"), "item-runs")
    few = item.limit(most + 1).count() <= most
    wanted = None
    if few:  # eight bytes for each run: documents give only runs that may be an item's
        known = item.select("size", "hash").distinct().toPandas()
        wanted = {k: np.sort(known["hash"][known["size"] == k].to_numpy(np.int64).view(np.uint64)) for k in sizes}
    own = docs.select(F.col(doc_id).alias("doc"), lower.alias("text")).withColumn("row", F.monotonically_increasing_id())
    own = written(own.select("doc", "row", F.inline(R.runs_among(wanted, sizes)("text"))), "document-runs")
    hits = own.join(item, ["size", "hash", "run"])
    by = hits.groupBy("row", "doc", "item", "item_words", "size").agg(F.collect_set("at").alias("ats"), F.collect_set("place").alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("size") - 1)))))
    spans = let(F.array_sort("places"), lambda p: F.size(F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))))
    return by.select(
        F.col("doc").alias(doc_id),
        F.col("item").alias(item_id),
        "item_words",
        covered.alias("covered"),
        (covered / F.col("item_words")).alias("share"),
        spans.alias("n_spans"),
        F.array_min("places").alias("first_word"),
        (F.array_max("places") + F.col("size")).alias("end_word"),
    )

