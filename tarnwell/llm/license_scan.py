"""License scans by an exact set-similarity join of text blocks with license templates.

Words are runs of digits, letters and characters beyond ASCII, lower-cased in A-Z. A text's blocks are windows of WINDOW words
that begin every STRIDE words, so any run of up to WINDOW - STRIDE + 1 words lies whole in one; a window that would add no
words to the one before it is left out. A block meets a template if it holds at least `percent` of each hundred of the
template's distinct words. That is an exact join, found by filters that lose nothing:

* Tokens are ordered by the number of blocks that hold them, over all documents, rare ones first; ties go by their bytes.
  Words that no template has are in no overlap, so a block is the sorted list of its template words.
* Prefix: with `need` words to share, the first shared one is among the first |T| - need + 1 words of the template and
  the first |B| - need + 1 of the block. Only the templates' prefixes are in the inverted lists.
* Length: a block of fewer than `need` words is skipped.
* Position: if the first shared word is at i in the template and j in the block, no more than 1 + min(|T| - i - 1,
  |B| - j - 1) are shared.
* What passes is verified by counting the shared words.

Phrases are templates that must be held whole; a block that does is then searched for the places where their words
stand one behind the other. Each place is in some block, and counts once.

Two passes over the documents: one counts, one joins; nothing is shuffled but one count for each token and task. Templates
are sent to tasks in slices of at most SLICE_WORDS words, whatever their number; each further slice is another pass, and
its rows are added up by document.

Null and empty texts, and those without words, have no blocks: zero words, no labels, score 0. Repeated rows have equal
results. Long texts are read in pieces, and only their template words are kept. Templates without words meet nothing. An empty
table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, STRIDE, PERCENT = 64, 32, 80
#: Words of the templates that one pass sends to tasks.
SLICE_WORDS = 50_000
#: Windows that are joined at once.
CHUNK = 1 << 14
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that part words, after A-Z are lower-cased.
GAP = np.array([re.fullmatch(WORD, bytes([b])) is None for b in range(256)])
#: The same before they are.
RAW_GAP = GAP[C.LOWER]


class Template(NamedTuple):
    label: str
    text: str
    percent: int = PERCENT
    phrase: bool = False


#: The phrases of the contract, and the sentences by which well-known licenses are granted.
PHRASES = (
    Template("cc-by", "cc by", 100, True),
    Template("gpl", "general public license", 100, True),
    Template("reserved", "all rights reserved", 100, True),
)
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("apache-2.0", "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: str) -> list[bytes]:
    return re.findall(WORD, re.sub(rb"[A-Z]+", lambda m: m[0].lower(), text.encode()))


def windows(n: np.ndarray) -> np.ndarray:
    """How many blocks texts of n words have."""
    return np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)


class Hits(NamedTuple):
    """Template words of some rows: the number of words of each row, and of each hit its row, its place and its token."""

    n: np.ndarray
    row: np.ndarray
    place: np.ndarray
    token: np.ndarray


def read(column: pa.Array, book: dict[bytes, int]) -> Iterator[tuple[int, Hits]]:
    """(first row, hits) of groups of a column's rows; tokens are numbered by `book`."""
    data, at = C.text_bytes(column)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    before = 0
    for lo, hi, part, starts, more in C.pieces(data, at, gap=RAW_GAP):
        low = C.LOWER[part]
        start, end, first = C.words(low, starts, GAP)
        ids, names = C.numbered(low, start, end)
        token = np.array([book.get(w, -1) for w in names], np.int32)[ids] if len(ids) else np.zeros(0, np.int32)
        live = np.flatnonzero(token >= 0)
        row = np.searchsorted(first, live, "right") - 1
        if more or before:  # one long row, in pieces
            held.append((live + before, token[live]))
            before += len(start)
            if more:
                continue
            yield lo, Hits(np.array([before]), np.zeros(sum(len(p) for p, _ in held), np.int64), np.concatenate([p for p, _ in held]), np.concatenate([t for _, t in held]))
            held, before = [], 0
        else:
            yield lo, Hits(np.diff(first), row, live - first[row], token[live])


class Blocks(NamedTuple):
    """Distinct tokens of some blocks, by block and token: where each block's begin, and all tokens."""

    window: np.ndarray
    start: np.ndarray
    token: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.start)


def blocks_of(hits: Hits, tokens: int) -> Iterator[tuple[np.ndarray, Blocks]]:
    """(row of each window, blocks) in runs of about CHUNK windows; windows are numbered in their row."""
    many = windows(hits.n)
    base = np.concatenate(([0], np.cumsum(many)))
    last = hits.place // STRIDE
    at_window = base[hits.row] + last
    # A place is in the window that begins last before it, if there is one, and in the ones before that.
    for lo in range(0, int(base[-1]), CHUNK):
        hi = min(lo + CHUNK, int(base[-1]))
        edge = np.searchsorted(at_window, (lo, hi + WINDOW // STRIDE))
        row, at, token = hits.row[edge[0] : edge[1]], last[edge[0] : edge[1]], hits.token[edge[0] : edge[1]]
        keys = []
        for back in range(WINDOW // STRIDE):
            window = at - back
            whole = base[row] + window
            live = (window >= 0) & (window < many[row]) & (whole >= lo) & (whole < hi)
            keys.append(whole[live] * np.int64(tokens) + token[live])
        key = np.unique(np.concatenate(keys))
        window, token = key // tokens, key % tokens
        found, start = np.unique(window, return_index=True)
        owner = np.searchsorted(base, found, "right") - 1
        yield owner, Blocks(found - base[owner], np.append(start, len(key)), token)


class Index:
    """Inverted lists of the templates' prefixes. Tokens are numbered in the global order."""

    def __init__(self, templates: list[Template], order: list[bytes]):
        self.templates, self.book = templates, {w: i for i, w in enumerate(order)}
        self.words = [[self.book[w] for w in words_of(t.text)] for t in templates]
        sets = [sorted(set(w)) for w in self.words]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.need = np.maximum(1, -(-self.size * np.array([t.percent for t in templates], np.int64) // 100))
        self.has = np.zeros((len(templates), max(1, len(order))), bool)
        lists: list[list[tuple[int, int]]] = [[] for _ in order]
        for t, s in enumerate(sets):
            self.has[t, s] = True
            for i, w in enumerate(s[: self.size[t] - self.need[t] + 1]):
                lists[w].append((t, i))
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        flat = np.array([x for found in lists for x in found], np.int64).reshape(-1, 2)
        self.template, self.position = flat[:, 0], flat[:, 1]

    def join(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, shared words) of all that meet."""
        size = blocks.sizes()
        block = np.repeat(np.arange(len(size)), size)
        j = np.arange(len(block)) - blocks.start[block]
        many = self.start[blocks.token + 1] - self.start[blocks.token]
        probe = np.repeat(np.arange(len(block)), many)
        entry = np.arange(len(probe)) - np.repeat(np.cumsum(many) - many, many) + self.start[blocks.token[probe]]
        t, i, b, j = self.template[entry], self.position[entry], block[probe], j[probe]
        need, n = self.need[t], size[b]
        live = (n >= need) & (j < n - need + 1)  # length, and the block's prefix
        t, i, b, j = t[live], i[live], b[live], j[live]
        _, one = np.unique(b * np.int64(len(self.templates)) + t, return_index=True)  # the first shared word: probes of a block go up
        t, i, b, j = t[one], i[one], b[one], j[one]
        live = 1 + np.minimum(self.size[t] - i - 1, size[b] - j - 1) >= self.need[t]
        t, b = t[live], b[live]
        many = size[b]
        pair = np.repeat(np.arange(len(b)), many)
        token = blocks.token[np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + blocks.start[b[pair]]]
        shared = np.bincount(pair, self.has[t[pair], token], len(b)).astype(np.int64)
        live = shared >= self.need[t]
        return b[live], t[live], shared[live]

    def places(self, hits: Hits, row: np.ndarray, window: np.ndarray, template: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) where a phrase's words stand one behind the other in the given blocks."""
        words = self.words[template]
        k = len(words)
        # Hits that lead a run of k neighbouring hits with the phrase's tokens.
        m = max(0, len(hits.token) - k + 1)
        fits = np.ones(m, bool)
        for d, w in enumerate(words):
            fits &= hits.token[d : d + m] == w
        fits &= (hits.row[k - 1 :][:m] == hits.row[:m]) & (hits.place[k - 1 :][:m] - hits.place[:m] == k - 1)
        at = np.flatnonzero(fits)
        r, p = hits.row[at], hits.place[at]
        # Which of them lie whole in a given block: one that begins at a stride at or before the place.
        width = int(window.max(initial=0)) + int(p.max(initial=0)) // STRIDE + 2
        given = np.unique(row * np.int64(width) + window)
        live = np.zeros(len(at), bool)
        for back in range(WINDOW // STRIDE):
            w = p // STRIDE - back
            inside = (w >= 0) & (p + k <= w * STRIDE + WINDOW)
            key = r * np.int64(width) + w
            spot = np.minimum(np.searchsorted(given, key), max(0, len(given) - 1))
            live |= inside & (given[spot] == key) if len(given) else False
        return r[live], p[live]


def _counts(order: list[bytes]):
    """(text) to (token, blocks): in how many blocks of a task's texts each token is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = {w: i for i, w in enumerate(order)}
        total = np.zeros(len(order), np.int64)
        for batch in batches:
            for _, hits in read(batch.column(0), book):
                for _, blocks in blocks_of(hits, len(order)):
                    total += np.bincount(blocks.token, minlength=len(order))
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(total[live])], names=["token", "blocks"])

    return run


def _scan(index: Index):
    phrase = np.array([t.phrase for t in index.templates], bool)
    kind = pa.struct([("template", pa.int32()), ("first_word", pa.int64()), ("shared", pa.int32()), ("size", pa.int32())])
    spot = pa.struct([("template", pa.int32()), ("word", pa.int64())])

    def grouped(n: int, row: np.ndarray, fields: list, kind) -> pa.Array:
        """Lists of structs for each of n rows, from columns whose first has the rows."""
        order = np.lexsort((*(np.asarray(f) for f in fields[::-1]), row))
        edge = np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([pa.array(f[order]).cast(x.type) for f, x in zip(fields, kind, strict=True)], [x.name for x in kind]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hits in read(batch.column(1), index.book):
                found = [np.zeros((4, 0), np.int64)]
                for owner, blocks in blocks_of(hits, len(index.book)):
                    b, t, shared = index.join(blocks)
                    found.append(np.stack((owner[b], blocks.window[b], t, shared)))
                row, window, t, shared = np.concatenate(found, 1)
                spots = [np.zeros((3, 0), np.int64)]
                for p in np.unique(t[phrase[t]]).tolist():
                    mine = t == p
                    r, at = index.places(hits, row[mine], window[mine], p)
                    spots.append(np.stack((r, np.full(len(r), p), at)))
                r, p, at = np.concatenate(spots, 1)
                live = ~phrase[t]
                n = len(hits.n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(hits.n.astype(np.int64)), grouped(n, row[live], [t[live], window[live] * STRIDE, shared[live], index.size[t[live]]], kind), grouped(n, r, [p, at], spot)],
                    names=["row", "n_words", "blocks", "places"],
                )

    return run


FOUND = "row {}, n_words long, blocks array<struct<template: int, first_word: bigint, shared: int, size: int>>, places array<struct<template: int, word: bigint>>"


def slices(templates: list[Template], most: int) -> list[list[int]]:
    """Numbers of templates, in runs of at most `most` words; a longer one is alone."""
    out: list[list[int]] = [[]]
    held = 0
    for i, t in enumerate(templates):
        n = len(words_of(t.text))
        if held + n > most and out[-1]:
            out.append([])
            held = 0
        out[-1].append(i)
        held += n
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + TEMPLATES, *, most: int = SLICE_WORDS) -> DataFrame:
    """doc_id, n_words, blocks (each block that meets a template, with the shared words and the template's) and places of phrases."""
    C.ready(docs.sparkSession)
    templates = list(templates)
    if any(not 0 < t.percent <= 100 for t in templates):
        raise ValueError("percent is over 0 and at most 100")
    if any(len(words_of(t.text)) > WINDOW - STRIDE + 1 for t in templates if t.phrase):
        raise ValueError(f"a phrase has at most {WINDOW - STRIDE + 1} words, so that each place is in a block")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = slices(templates, most)
    if len(parts) == 1:
        return _one(rows, "doc_id", "long", templates).withColumnRenamed("row", "doc_id")
    # More templates than a task should hold: a pass for each slice, added up by row.
    rows = C.Scratch(docs.sparkSession, "license-scan").table(rows.withColumn("_row", F.monotonically_increasing_id()))
    found = [_one(rows, "_row", "long", [templates[i] for i in part], part[0]) for part in parts]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    flat = lambda c: F.flatten(F.array_sort(F.collect_list(c)))  # noqa: E731  a row has one of each slice
    out = out.groupBy("row").agg(F.max("n_words").alias("n_words"), flat("blocks").alias("blocks"), flat("places").alias("places"))
    return rows.select("doc_id", F.col("_row").alias("row")).join(out, "row").drop("row")


def _one(rows: DataFrame, key: str, kind: str, templates: list[Template], first: int = 0) -> DataFrame:
    """One pass; templates are numbered from `first`."""
    order = sorted({w for t in templates for w in words_of(t.text)})
    counted = rows.select("text").mapInArrow(C.lean(_counts(order)), "token int, blocks long").groupBy("token").agg(F.sum("blocks").alias("n")).collect()
    blocks = {r.token: r.n for r in counted}  # one row for each template word at most
    index = Index(templates, [order[i] for i in sorted(range(len(order)), key=lambda i: (blocks.get(i, 0), order[i]))])
    out = rows.select(key, "text").mapInArrow(C.lean(_scan(index)), FOUND.format(kind))
    if first:
        shift = lambda c: F.transform(c, lambda x: x.withField("template", x["template"] + first))
        out = out.withColumn("blocks", shift("blocks")).withColumn("places", shift("places"))
    return out


def labelled(found: DataFrame, templates: tuple[Template, ...] = PHRASES + TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of what `scan` found.

    The score is the largest containment of a template, 1 where a phrase stands, and 0 where there is nothing.
    """
    names = F.array(*(F.lit(t.label) for t in templates)).cast("array<string>")
    label = lambda c: F.transform(c, lambda x: F.element_at(names, x["template"] + 1))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    held = F.aggregate("blocks", F.lit(0.0), lambda s, x: F.greatest(s, x["shared"] / x["size"]))
    word = F.transform("places", lambda x: x["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        joined(label("places")).alias("base_labels"),
        joined(F.concat(label("places"), label("blocks"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(held).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents by the phrases and the templates."""
    return labelled(scan(C.documents(spark, sf_dir, "doc_id", "text")))


def sql() -> str:
    """The same for DuckDB: every block against every template, and each place against each phrase."""
    quote = lambda ws: "[" + ", ".join(f"'{w.decode()}'" for w in ws) + "]"
    t = ", ".join(f"('{t.label}', {quote(sorted(set(words_of(t.text))))}, {t.percent})" for t in TEMPLATES)
    p = ", ".join(f"('{t.label}', {quote(words_of(t.text))})" for t in PHRASES)
    return f"""
WITH t(label, ws, percent) AS (VALUES {t}), p(label, ws) AS (VALUES {p}),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS MATERIALIZED (SELECT doc_id, list_distinct(ws[k * {STRIDE} + 1 : k * {STRIDE} + {WINDOW}]) AS b FROM (SELECT doc_id, ws, unnest(range(CASE WHEN len(ws) = 0 THEN 0 ELSE 1 + greatest(0, (len(ws) - {WINDOW} + {STRIDE} - 1) // {STRIDE}) END)) AS k FROM d)),
f AS (SELECT doc_id, label, len(list_intersect(b, t.ws)) AS n, len(t.ws) AS size FROM b, t WHERE len(list_intersect(b, t.ws)) * 100 >= len(t.ws) * percent),
h AS (SELECT doc_id, label, i - 1 AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) x, p WHERE x.ws[i] = p.ws[1] AND x.ws[i : i + len(p.ws) - 1] = p.ws),
n AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM h UNION ALL SELECT doc_id, label FROM f) GROUP BY doc_id),
s AS (SELECT doc_id, max(CAST(n AS DOUBLE) / size) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""
