"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +-1, fixed by the seed. A trigram's vector is the product of its letters' vectors,
each rotated by its place; a text's vector is the sum of its trigrams' vectors, and a language's prototype the sum of
its texts' normed vectors, less the mean of all prototypes. The language of a text is that of the prototype with the
greatest cosine; the score is that cosine as a share of 0 to 1.

Texts are lower-cased; runs of anything but letters count as one gap. A letter other than a-z is one of 69 by its code.
Null texts, and texts without a letter, are `und` with score 0, as are all texts if nothing was learnt. Texts without a
language are not learnt from. All learnable texts count: each task adds its own up, and only one vector for each task and
language is summed; there is no bound on texts. At most MOST_LANGUAGES languages are told apart, else it is an error.
Of cosines that tie the first language in order is predicted. Repeated rows count each and are predicted alike. Long
texts are read in pieces that add up. An empty table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DIMENSION, SEED = 512, 7
#: Symbols: 0 is the gap, then a-z, then others.
SYMBOLS = 96
#: Characters of a long text that are read at once.
PIECE = 1 << 20
MOST_LANGUAGES = 1000


@lru_cache(1)
def symbols() -> np.ndarray:
    """The symbol of each code point: 0 for what is no letter."""
    c = np.arange(0x110000)
    t = 27 + c % (SYMBOLS - 27)
    t[97:123] = np.arange(1, 27)
    t[~np.fromiter((chr(x).isalpha() for x in range(len(c))), bool, len(c))] = 0
    return t.astype(np.uint8)


@lru_cache(1)
def vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of symbols, the first rotated by two places times the second rotated by one; and of single symbols."""
    letter = np.random.default_rng(SEED).choice(np.array([-1.0, 1.0], np.float32), (SYMBOLS, DIMENSION))
    return (np.roll(letter, 2, 1)[:, None] * np.roll(letter, 1, 1)[None]).reshape(SYMBOLS * SYMBOLS, DIMENSION), letter


#: Where a long text is cut, if there is such a place in reach: no letter's form depends on what is behind it.
_CUT = re.compile(r"\s")


def raw_codes(text: str) -> np.ndarray:
    """The symbols of a text's characters."""
    return symbols()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)


def one_gap(s: np.ndarray) -> np.ndarray:
    """Symbols with one gap for each run of gaps."""
    gap = s == 0
    keep = np.ones(len(s), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return s[keep]


def codes(text: str) -> np.ndarray:
    """The symbols of a text, with one gap at the ends and between words."""
    gap = np.zeros(1, np.int32)
    return one_gap(np.concatenate((gap, raw_codes(text), gap)))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a text, with a gap at both ends, and how often it has each.

    A long text is read in pieces of PIECE to twice that many characters, whatever parts its words; each begins with the last two symbols of the one before.
    """
    numbers = lambda s: (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    if len(text) <= PIECE:
        return np.unique(numbers(codes(text)), return_counts=True)
    count = np.zeros(SYMBOLS**3, np.int64)
    begin, tail = 0, np.zeros(1, np.int32)
    while begin < len(text):
        found = _CUT.search(text, begin + PIECE, begin + 2 * PIECE)
        end = found.start() if found else min(len(text), begin + 2 * PIECE)
        s = one_gap(np.concatenate((tail, raw_codes(text[begin:end]), np.zeros(int(end == len(text)), np.int32))))
        if len(s) > 2:
            count += np.bincount(numbers(s), minlength=len(count))
        tail, begin = s[-2:], end
    live = np.flatnonzero(count)
    return live, count[live]


def vector(text: str | None) -> np.ndarray | None:
    """The sum of a text's trigram vectors; None without letters."""
    if not text:
        return None
    grams, n = trigrams(text)
    if not len(grams):
        return None
    pair, letter = vectors()
    out = np.zeros(DIMENSION, np.float32)
    for a in range(0, len(grams), 1024):
        g = grams[a : a + 1024]
        v = pair[g // SYMBOLS]
        v *= letter[g % SYMBOLS]
        out += n[a : a + 1024].astype(np.float32) @ v
    return out


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to one vector for each language of a partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (v := vector(text)) is not None and (size := np.linalg.norm(v)) > 0:
                sums[lang] = sums.get(lang, np.zeros(DIMENSION)) + v / size
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])


def prototypes(docs: DataFrame, lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages in order and their centred, normed prototypes, from all rows with a language."""
    C.ready(docs.sparkSession)
    parts = docs.where(F.col(lang_col).isNotNull()).select(F.col("text").cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(C.lean(_bundle), "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = sorted(sums.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r[0])
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not rows:
        return [], np.zeros((0, DIMENSION))
    p = np.array([[x[1] for x in r[1]] for r in rows])
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    if len(p) > 1:
        p = p - p.mean(0)
    return [r[0] for r in rows], np.round(p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12), 6)


def predict(docs: DataFrame, languages: list[str], profile: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of each row's whole text."""
    C.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for text in batch.column(1).to_pylist():
                v = vector(text) if languages else None
                if v is None or not (size := np.linalg.norm(v)):
                    lang.append("und")
                    score.append(0.0)
                else:
                    cosine = profile @ v / size
                    best = int(np.argmax(cosine))
                    lang.append(languages[best])
                    score.append(float(min(1.0, max(0.0, (1 + cosine[best]) / 2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(C.lean(run), "doc_id long, lang_pred string, score double")


def held_out() -> "F.Column":
    return F.coalesce(C.crc_mod("doc_id", 4) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: learnt from documents whose crc32(doc_id) mod 4 is not 2; all documents predicted."""
    docs = C.documents(spark, sf_dir, "doc_id", "text", "lang")
    languages, profile = prototypes(docs.where(~held_out()))
    return predict(docs, languages, profile).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
