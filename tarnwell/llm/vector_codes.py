"""Codes of vectors by product quantisation, with nearest entries found by annular norm pruning.

A vector is cut into PARTS equal parts; each part position has a codebook of ENTRIES entries, and a vector's code is the
nearest entry of each part. All is in integers, so results do not depend on how rows are dealt: a component x counts as
floor(SCALE * x), distances are squared Euclidean ones, ties go to the lower index, and an entry's new value is the floor of
the mean of its parts, component by component. Codebooks start as the parts of the first vectors by id, and ROUNDS rounds
refine them; entries that no part chose stay.

Nearest entries: a codebook is sorted by norm. A part first meets the entry whose norm is nearest to its own, at distance
d; by the triangle inequality only entries with a norm within d of the part's norm can be nearer or as near. That interval
is found by binary search, both ends included, and exactly the entries in it are evaluated. Square roots only bound the
interval, with a margin over their error; distances are compared as integers.

Each round is one pass over a written table of the scaled vectors. Tasks give sums and counts by entry, which Spark adds up
as decimals; the driver gets ENTRIES sums of a vector's width, whatever the number of vectors.

Rows whose vector is null or has null or non-finite components are dropped. Vectors shorter than the widest, and widths that
PARTS does not divide, count as filled up with zeros. Rows that repeat, or share an id, count as rows each; equal ids are
ordered by their vectors, and null ids come after all others. With fewer than ENTRIES vectors there are as many entries. An
empty table gives an empty one. Squared distances are longs, so a scaled vector longer than 2**30 is an error. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Squared norms of scaled vectors stay below this; a squared distance is at most four times as much, and fits a long.
BOUND = 1 << 60
#: Parts are worked on in blocks of about so many components.
CHUNK = 1 << 19


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) to (vec_id, label, v): the rows that count, with integer components."""
    for batch in batches:
        batch = batch.filter(batch.column(2).is_valid())
        column = batch.column(2)
        size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(size)), size)
        fine = np.ones(len(size), bool)
        fine[row[~np.isfinite(x)]] = False
        live = fine[row]
        x = np.floor(x[live] * SCALE)
        if (np.bincount(row[live], x * x) >= BOUND).any():
            raise ValueError("a vector is too long: squared distances would not fit a long")
        ints = x.astype(np.int32)
        edge = np.concatenate(([0], np.cumsum(size[fine]))).astype(np.int32)
        batch = batch.filter(pa.array(fine))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edge), pa.array(ints))], names=["vec_id", "label", "v"])


def parts_of(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as (rows, PARTS, width of a part), filled up with zeros."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(size) or (size == width).all():
        return flat.reshape(len(size), PARTS, width // PARTS)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out.reshape(len(size), PARTS, width // PARTS)


class Annuli:
    """One codebook sorted by norm; finds nearest entries and counts the distances that it evaluates."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norm = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]
        self.evaluated = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row."""
        n = len(x)
        norm = np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)))
        right = np.minimum(np.searchsorted(self.norm, norm), len(self.norm) - 1)
        left = np.maximum(right - 1, 0)
        first = np.where(norm - self.norm[left] <= self.norm[right] - norm, left, right)
        columns = np.ascontiguousarray(x.T)
        index, best = self.order[first], np.zeros(n, np.int64)
        for k in np.unique(first).tolist():
            rows = np.flatnonzero(first == k)
            best[rows] = self._squares(columns, rows, self.order[k])
        reach = np.sqrt(best.astype(np.float64))
        margin = 1e-9 * (1 + norm + reach)
        low, high = np.searchsorted(self.norm, norm - reach - margin, "left"), np.searchsorted(self.norm, norm + reach + margin, "right")
        # The entries in order of their norms, each with the rows in whose annulus it is; the one that gave the bound is done.
        for k, entry in enumerate(self.order.tolist()):
            rows = np.flatnonzero((low <= k) & (k < high) & (first != k))
            square = self._squares(columns, rows, entry)
            nearer = (square < best[rows]) | ((square == best[rows]) & (entry < index[rows]))
            rows = rows[nearer]
            best[rows], index[rows] = square[nearer], entry
        return index, best

    def _squares(self, columns: np.ndarray, rows: np.ndarray, entry: int) -> np.ndarray:
        self.evaluated += len(rows)
        out = np.zeros(len(rows), np.int64)
        for x, c in zip(columns, self.entries[entry].tolist(), strict=True):
            gap = (x if len(rows) == len(x) else x[rows]) - c
            out += gap * gap
        return out


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances), both (rows, PARTS), of parts (rows, PARTS, width) by books (PARTS, entries, width)."""
    code, square = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    step = max(1, CHUNK // max(1, x.shape[2]))
    for p in range(x.shape[1]):
        find = Annuli(books[p])
        for lo in range(0, len(x), step):
            code[lo : lo + step, p], square[lo : lo + step, p] = find.nearest(x[lo : lo + step, p])
    return code, square


def _sums(books: np.ndarray):
    """(v) to one row for each part and entry that a task's vectors chose: count and sums of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)

        def out():
            live = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(count[live]), pa.ListArray.from_arrays(np.arange(0, len(live) * width + 1, max(1, width), dtype=np.int32)[: len(live) + 1] if width else np.zeros(len(live) + 1, np.int32), pa.array(total[live].reshape(-1)))], names=["at", "n", "sums"])

        rows = 0
        for batch in batches:
            x = parts_of(batch.column(0), parts * width)
            code = assigned(x, books)[0] + np.arange(parts) * entries
            count += np.bincount(code.reshape(-1), minlength=len(count))
            for p in range(parts):  # rows of one entry stand together, so sums run over whole segments
                order = np.argsort(code[:, p], kind="stable")
                held = code[order, p]
                edge = np.flatnonzero(np.concatenate((held[:1] >= 0, held[1:] != held[:-1])))
                if len(edge):
                    total[held[edge]] += np.add.reduceat(x[order, p], edge, axis=0)
            rows += len(x)
            if rows >= 1 << 31:  # components are below 2**30, so sums stay within a long
                yield out()
                count[:], total[:], rows = 0, 0, 0
        if rows:
            yield out()

    return run


def refined(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over a table with `v`."""
    parts, entries, width = books.shape
    sums = table.select("v").mapInArrow(C.lean(_sums(books)), "at int, n long, sums array<long>")
    # One sum of decimals for each component, and one count, for each entry: PARTS * ENTRIES rows, none wider than a part.
    totals = sums.select("at", "n", F.posexplode_outer("sums").alias("i", "x")).groupBy("at", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    new = books.copy()
    for r in totals.select("at", "i", "n", "x").collect():
        if r.i is not None:
            new[r.at // entries, r.at % entries, r.i] = int(r.x) // int(r.n)
    return new


def _coded(books: np.ndarray):
    """(vec_id, label, v) to (vec_id, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for batch in batches:
            code, square = assigned(parts_of(batch.column(2), parts * width), books)
            text = [row.tobytes().hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(square.sum(1))], names=["vec_id", "label", "code", "error"])

    return run


def kept(rows: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(vec_id, label, v) of the vectors that count, written: v has integers, label is text."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return scratch.table(rows.mapInArrow(C.lean(scaled), "vec_id long, label string, v array<int>"))


def learnt(table: DataFrame, *, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (PARTS, entries, width of a part) of a table that `kept` wrote."""
    if entries > 256:
        raise ValueError("an entry's index is written as two hex digits")
    widest = table.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-widest // PARTS) * PARTS
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    books = np.ascontiguousarray(parts_of(first, width).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        books = refined(table, books)
    return books


def digest(books: np.ndarray) -> str:
    """Of all entries' components in decimal, by part, entry and place in the part."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def coded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of each row of a table that `kept` wrote."""
    return table.mapInArrow(C.lean(_coded(books)), "vec_id long, label string, code string, error long")


def compressed(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row of (vec_id, embedding, label) whose vector counts."""
    spark = C.ready(rows.sparkSession)
    scratch = C.Scratch(spark, "vector-codes")
    table = kept(rows, scratch)
    books = learnt(table)
    # A label's key is never null, so that nulls are together. Tasks add up what they have before the shuffle.
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))
    codes = scratch.table(coded(table, books).select("vec_id", key.alias("key"), "code", "error"))
    scratch.drop(table)
    sums = scratch.table(codes.groupBy("key").agg(F.sum("error").alias("label_error")))
    return C.spread_join(codes, sums, "key", scratch).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all rows of embeddings whose vector counts."""
    return compressed(C.load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def sql() -> str:
    """The same for DuckDB: every part against every entry, round by round."""
    steps = [f"""
WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS w FROM e, range({PARTS}) t(p)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM e QUALIFY i < {ENTRIES}),
c0 AS MATERIALIZED (SELECT p, i, w AS c FROM x JOIN s USING (vec_id))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS (SELECT vec_id, p, w, i, list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{r} USING (p)),
a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(w) AS w, arg_min(i, d * {ENTRIES} + i) AS i, CAST(min(d) AS BIGINT) AS d FROM d{r} GROUP BY vec_id, p)""")
        if r < ROUNDS:
            steps.append(f"""u{r} AS (SELECT p, i, j, CAST(sum(w[j]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, i, w, unnest(range(1, len(w) + 1)) AS j FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT p, i, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM u{r} GROUP BY p, i),
c{r + 1} AS MATERIALIZED (SELECT p, i, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (p, i))""")
    return ",\n".join(steps) + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM c{ROUNDS}),
o AS (SELECT vec_id, string_agg(lower(printf('%02x', i)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT o.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN e USING (vec_id), h
"""
