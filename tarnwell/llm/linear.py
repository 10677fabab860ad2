"""Linear models on hashed words, which the classifiers share: features of whole texts, their choice, sparse training.

A word is a run between ASCII white space, lower-cased in A-Z. Its features are the word without the punctuation at its
end, its first 4 to 8 bytes, and its last 3 bytes; each is hashed to one of 2**BITS numbers. A text's value for a
feature is its count over the square root of the number of words. A few measures of form come with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from . import common as C

BITS = 22
PREFIXES = (4, 5, 6, 7, 8)
_END = np.zeros(256, bool)
_END[list(b".,;:!?\"')]}")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
FORMS = 8
#: Features of a word.
EACH = len(PREFIXES) + 2


def word_features(book: list[bytes]) -> np.ndarray:
    """Of each distinct word its feature numbers."""
    at = np.concatenate(([0], np.cumsum([len(w) for w in book], dtype=np.int64)))
    low = np.frombuffer(b"".join(book) + bytes(8), np.uint8)
    start, end = at[:-1], at[1:]
    bare = end.copy()
    for _ in range(3):
        bare -= (bare > start + 1) & _END[low[bare - 1]]
    cols = [C.span_hashes(low, start, bare)]
    for n in PREFIXES:
        x = C.span_hashes(low, start, np.minimum(start + n, end), n)
        x[end - start < n] = C.U64(0)
        cols.append(x)
    cols.append(C.span_hashes(low, np.maximum(end - 3, start), end, 99))
    return (np.stack(cols, 1) >> C.U64(64 - BITS)).astype(np.int32)


@dataclass
class Block:
    """The words of a block that count: those that do not repeat the one before."""

    ids: np.ndarray  # the number of each word in `book`
    first: np.ndarray  # the number of words before each row
    book: list[bytes]
    sums: np.ndarray  # of each row what `forms` needs; such sums of a row's pieces add up
    last: bytes | None  # the last word, repeated or not

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def read(data: np.ndarray, at: np.ndarray, before: bytes | None = None) -> Block:
    """before: the word that the first row had before this piece."""
    w = C.Words(data, at)
    start, end, first = w.start, w.end, w.first
    sums = lambda x, edge: np.diff(np.concatenate(([0], np.cumsum(x)))[edge])
    again = np.zeros(len(start), bool)
    again[1:] = w.ids[1:] == w.ids[:-1]
    edge = first[1:-1]
    again[edge[edge < len(start)]] = False
    if before is not None and len(start) and first[1] > 0:
        again[0] = w.book[w.ids[0]] == before
    total = np.diff(first)
    found = np.stack((np.diff(at), total, sums(_UPPER[data], at), sums(_DIGIT[data], at), sums(_SIGN[data], at), sums(again, first), sums(np.minimum(end - start, 40), first), sums(data == 10, at)), 1).astype(float)
    keep = ~again
    return Block(w.ids[keep], np.concatenate(([0], np.cumsum(keep)))[first], w.book, found, w.book[w.ids[-1]] if len(start) else before)


def forms(sums: np.ndarray) -> np.ndarray:
    """The measures of form of rows from their sums."""
    size, total, upper, digit, sign, again, letters, lines = sums.T
    size, words = np.maximum(size, 1), np.maximum(total, 1)
    return np.stack((upper / size, digit / size, sign / size, again / words, letters / words / 10, np.log1p(total) / 10, np.minimum(total, 20) / 20, lines / words), 1)


def counted(sums: np.ndarray) -> np.ndarray:
    """The words of rows that have features."""
    return sums[:, 1] - sums[:, 5]


@dataclass
class Model:
    """Weights of the chosen features by number (sorted), for each output; of the forms; and what each head adds."""

    ids: np.ndarray
    weights: np.ndarray  # (features, outputs)
    form: np.ndarray  # (FORMS, outputs)
    bias: np.ndarray  # (outputs)
    mean: np.ndarray
    scale: np.ndarray
    extra: np.ndarray  # thresholds, or none

    def table(self) -> np.ndarray:
        """The place of each feature in `ids` plus one; 0 if it was not chosen."""
        t = np.zeros(1 << BITS, np.int16)
        t[self.ids] = np.arange(1, len(self.ids) + 1)
        return t

    def by_word(self, book: list[bytes], table: np.ndarray) -> np.ndarray:
        """What each distinct word adds to the scores (words, outputs)."""
        slot = table[word_features(book)]
        weights = np.concatenate((np.zeros((1, len(self.bias))), self.weights))
        return weights[slot].sum(1)


def scored(model: Model, column) -> np.ndarray:
    """Linear scores (rows, outputs) of a whole Arrow column of texts. Long texts are read in pieces that add up."""
    return scored_words(model, column)[0]


def scored_words(model: Model, column) -> tuple[np.ndarray, np.ndarray]:
    """The same, and the number of words of each text."""
    table = model.table()
    data, at = C.text_bytes(column)
    n = len(at) - 1
    linear, sums = np.zeros((n, len(model.bias))), np.zeros((n, FORMS))
    before = None
    for lo, hi, part, starts, more in C.pieces(data, at):
        b = read(part, starts, before)
        before = b.last if more else None
        sums[lo:hi] += b.sums
        if len(b.ids):
            add = model.by_word(b.book, table)
            for k in range(add.shape[1]):
                linear[lo:hi, k] += np.bincount(b.row, add[b.ids, k], hi - lo)
    linear /= np.sqrt(np.maximum(counted(sums), 1))[:, None]
    return linear + ((forms(sums) - model.mean) / model.scale) @ model.form + model.bias, sums[:, 1].astype(np.int64)


class Sparse:
    """Values by row and column, sorted by both; sums along either run over whole segments."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, rows: int):
        self.row, self.col, self.val, self.rows = row, col, val, rows
        self._by_col: tuple | None = None

    @staticmethod
    def _summed(x: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        if len(key):
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            out[key[edge]] = np.add.reduceat(x, edge)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.stack([self._summed(w[:, k][self.col] * self.val, self.row, self.rows) for k in range(w.shape[1])], 1)

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        if self._by_col is None:
            order = np.argsort(self.col, kind="stable")
            self._by_col = self.row[order], self.col[order], self.val[order]
        row, col, val = self._by_col
        return np.stack([self._summed(g[:, k][row] * val, col, n) for k in range(g.shape[1])], 1)


def choose(texts: list[bytes], y: np.ndarray, most: int, least: int = 4) -> np.ndarray:
    """The features whose presence goes most with some class of y (0, 1, ...), by their deviation from chance."""
    k = int(y.max()) + 1
    df = np.zeros((k, 1 << BITS), np.int32)  # texts of each class that have a feature, counted block by block
    for lo, data, at in _blocks(texts):
        b = read(data, at)
        if len(b.ids):
            # Each word of a row once, then each feature of a row once.
            pair = np.unique(b.row * np.int64(len(b.book)) + b.ids)
            row, ids = pair // len(b.book), word_features(b.book)[pair % len(b.book)]
            one = np.unique((row[:, None] << BITS) + ids)
            cls = y[lo + (one >> BITS)]
            for c in range(k):
                np.add.at(df[c], one[cls == c] & (1 << BITS) - 1, 1)
    total = df.sum(0)
    live = np.flatnonzero(total >= least)
    best = np.zeros(len(live))
    for c in range(k):
        p = total[live] / len(texts)
        n = (y == c).sum()
        best = np.maximum(best, np.abs(df[c, live] - n * p) / np.sqrt(n * p * np.maximum(1 - p, 1e-3) * max(1 - n / len(texts), 1e-3) + 1))
    return np.sort(live[np.argsort(-best, kind="stable")[:most]])


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    for lo, hi, _, starts in C.blocks(np.zeros(0, np.uint8), at):
        yield lo, np.frombuffer(b"".join(texts[lo:hi]), np.uint8), starts


def sparse(texts: list[bytes], chosen: np.ndarray) -> tuple[Sparse, np.ndarray]:
    """The values of the chosen features, and the measures of form."""
    table = np.zeros(1 << BITS, np.int32)
    table[chosen] = np.arange(1, len(chosen) + 1)
    width = max(1, len(chosen))
    rows, cols, vals, form = [], [], [], []
    for lo, data, at in _blocks(texts):
        b = read(data, at)
        form.append(forms(b.sums))
        if len(b.ids):
            slot = table[word_features(b.book)][b.ids]
            word, _ = live = np.nonzero(slot)
            code, count = np.unique(b.row[word] * np.int64(width) + slot[live] - 1, return_counts=True)
            row, col = code // width, code % width
            rows.append(row + lo)
            cols.append(col)
            vals.append(count / np.sqrt(np.maximum(counted(b.sums)[row], 1)))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return Sparse(cat(rows, np.int64), cat(cols, np.int64), cat(vals, float), len(texts)), np.concatenate(form) if form else np.zeros((0, FORMS))


def train(x: Sparse, form: np.ndarray, n: int, outputs: int, loss, *, steps: int, rate: float, decay: float, extra: np.ndarray | None = None, twin: Sparse | None = None, bind: float = 0.0, pairs: np.ndarray | None = None) -> tuple:
    """Weights by Adam on all rows at once.

    loss(z, extra) gives the gradient by the scores z, and by `extra`. twin: rows as in x (at `pairs`) after a swap of
    terms; `bind` times the mean squared difference of a pair's scores is part of what is minimised.
    """
    mean, scale = form.mean(0), form.std(0) + 1e-3
    f = (form - mean) / scale
    extra = np.zeros(0) if extra is None else extra.astype(float)
    p = [np.zeros((n, outputs)), np.zeros((form.shape[1], outputs)), np.zeros(outputs), extra]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        linear = x.times(p[0])
        z = linear + f @ p[1] + p[2]
        g, ge = loss(z, p[3])
        grads = [x.back(g, n) + decay * p[0], f.T @ g + decay * p[1], g.sum(0), ge]
        if twin is not None and len(pairs):
            gap = (linear[pairs] - twin.times(p[0])) * (2 * bind / len(pairs))
            whole = np.zeros_like(linear)
            np.add.at(whole, pairs, gap)
            grads[0] += x.back(whole, n) - twin.back(gap, n)
        step = rate * (1 - 0.9 * t / steps)
        for a, b, c, d in zip(p, m, v, grads, strict=True):
            b += 0.1 * (d - b)
            c += 0.01 * (d * d - c)
            a -= step * (b / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.99**t)) + 1e-8)
    return p[0], p[1], p[2], p[3], mean, scale


def fitted(sample, fit, columns: list[str]) -> Model:
    """Trains in one task on a bounded sample; rows (text, labels...). fit(texts, *labels) gives a Model.

    Only the model comes back to the driver. The task's text is bounded by the caller's limits on rows and bytes.
    """
    import pickle

    import pyarrow as pa

    def run(batches):
        texts: list[bytes] = []
        labels: list[list] = [[] for _ in columns]
        for batch in batches:
            data, at = C.text_bytes(batch.column(0))
            raw = data.tobytes()
            texts += [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            for held, c in zip(labels, columns, strict=True):
                held += batch.column(c).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i], *(x[i] for x in labels)))  # whatever order the rows came in
        model = fit([texts[i] for i in order], *(np.array([x[i] for i in order]) for x in labels))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = sample.select("text", *columns).repartition(1).mapInArrow(C.lean(run), "model binary").collect()
    return pickle.loads(rows[0][0]) if rows else fit([], *(np.zeros(0, int) for _ in columns))


def labelled_sample(docs, labels, value: str, per_class: int, most_bytes: int):
    """(text, value, weight) for up to `per_class` labelled documents of each value, those with the least hashes of their ids.

    weight: what each stands for. All values are used, however many there are. Documents over most_bytes are not used for training (they are scored like all others).
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    labels = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).groupBy("doc_id").agg(F.max(value).alias(value))
    # Few more rows than asked for pass by their hash alone, so what is ranked is as small at every size.
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 11) / F.lit(float(1 << 53))
    counts = C.bounded(docs.sparkSession, labels.groupBy(value).agg(F.count("*").alias("_all")), 10_000)
    near = labels.join(counts, value).withColumn("_u", drawn).where(F.col("_u") * F.col("_all") <= 1.2 * per_class + 6 * per_class**0.5 + 10)
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy(value).orderBy("_u", "doc_id"))).where(F.col("_n") <= per_class)
    picked = ranked.select("doc_id", value, F.greatest(F.lit(1.0), F.col("_all") / per_class).alias("weight"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes)
    texts = texts.join(C.bounded(docs.sparkSession, picked, 64 * per_class), "doc_id")
    return texts.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("_n = 1").select("text", value, "weight")
