"""Runs of words in Arrow batches: hashes of all runs of a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_ODD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _ODD
    return h ^ (h >> _SHIFT)


def words_of(texts: list[str | None]) -> list[list[bytes]]:
    """The words of each text, parted by ASCII white space; none for null."""
    return [[] if t is None else t.encode("utf-8", "surrogatepass").split() for t in texts]


def run_hashes(words: list[list[bytes]], n: int) -> list[np.ndarray]:
    """64-bit hashes of the runs of n words of each list of words, by place. They say nothing about equality."""
    first = np.cumsum([0] + [len(w) for w in words])
    one = pd.util.hash_array(np.array([x for w in words for x in w] or [b""], object))
    x = np.zeros(max(0, len(one) - n + 1), np.uint64)
    for i in range(n):
        x = mixed(x, one[i : i + len(x)])
    return [x[lo : max(lo, hi - n + 1)] for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def grouped(texts: pd.Series, size: int = 1_000_000) -> list[list[str | None]]:
    """A batch of texts in groups of about so many characters."""
    group = (texts.str.len().fillna(0).cumsum() // size).to_numpy()
    return [texts[group == g].tolist() for g in np.unique(group).tolist()]


def runs_among(wanted: dict[int, np.ndarray] | None, sizes: list[int]):
    """A function of a column of texts: for each its runs of the given sizes, with size, place, hash and the run itself.

    wanted: by size the sorted hashes of the runs to give; None for all.
    """

    @F.pandas_udf("array<struct<size: int, place: int, hash: long, run: string>>")
    def found(texts: pd.Series) -> pd.Series:
        out: list[list[dict]] = []
        for group in grouped(texts):
            words = words_of(group)
            rows: list[list[dict]] = [[] for _ in words]
            for k in sizes:
                for row, w, x in zip(rows, words, run_hashes(words, k), strict=True):
                    place = np.arange(len(x))
                    if wanted is not None and len(x):
                        at = np.minimum(np.searchsorted(wanted[k], x), len(wanted[k]) - 1)
                        place = np.flatnonzero(wanted[k][at] == x)
                    row += [{"size": k, "place": p, "hash": h, "run": b" ".join(w[p : p + k]).decode("utf-8", "replace")} for p, h in zip(place.tolist(), x[place].view(np.int64).tolist(), strict=True)]
            out += rows
        return pd.Series(out, dtype=object)

    return found
