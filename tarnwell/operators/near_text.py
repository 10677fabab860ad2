"""Near-duplicate texts by MinHash signatures in banded buckets, verified by exact Jaccard similarity.

Texts are sets of runs of `n` words. Equal texts form a class, and one text stands for it. A class's signature is cut into
bands; classes that agree in a band share a bucket. Pairs are never made within a whole bucket: each member is compared
with the bucket's smallest class, and only members that do not link with it are compared with the others. A pair of which
both link with that class is connected by it, and pairs that other links connect by then are left out too, so the components
are those of comparing all pairs of all buckets. The work
is linear in a bucket of near copies, however large; it grows with the square only of what does not link with the first.

Of such pairs few are compared by their texts. A class has a parity map: each bit tells whether an odd number of its runs
falls on it. Where two maps differ, one set has a run that the other lacks, so a pair whose maps differ in more places than
sets that similar can is left out, exactly.

A pair at similarity s is in a common bucket with probability 1 - (1 - s**rows)**bands, 0.99997 at 0.8 by default; it is
then compared exactly, by the words themselves, so no pair below the threshold links.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import runs as R
from ..sources.tables import dropped, ready, written
from .graph import connected_components
from .joins import spread_join

BANDS, ROWS, SEED = 20, 4, 29
#: Numbers of 64 bits in a parity map.
LONGS = 16
#: Rows of one number each that are broadcast at the most.
SMALL = 500_000


def runs(text: str, n: int) -> set[tuple[bytes, ...]]:
    """The distinct runs of n words of a text; none for fewer words."""
    words = R.words_of([text])[0]
    return set(zip(*(words[i:] for i in range(n)), strict=False))


def signer(n: int, bands: int, rows: int, maps: bool = False):
    """A function from lower-cased texts to (number of distinct runs, a key for each band or null) of each; with maps also its parity map.

    Runs are numbered by 64-bit hashes, of which 32 bits choose the candidates; they say nothing about equality of texts.
    """
    rng = np.random.default_rng(SEED)
    a, b = (rng.integers(0, 1 << 31, (bands * rows, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))

    def keys(x: np.ndarray) -> tuple[int, list[int] | None]:
        if not len(x):
            return 0, None
        high = (x >> np.uint64(32)).astype(np.uint32)
        least = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(high), 2048):
            np.minimum(least, (a * high[at : at + 2048] + b).min(1), out=least)
        key = np.zeros(bands, np.uint64)
        for part in least.reshape(bands, rows).T:
            key = R.mixed(key, part.astype(np.uint64))
        return len(x), key.view(np.int64).tolist()

    def parity(x: np.ndarray) -> list[int]:
        odd = np.bincount((x & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
        return np.packbits(odd.astype(bool)).view(np.int64).tolist()

    of = lambda x: (*keys(x), parity(x)) if maps else keys(x)

    return lambda texts: [of(np.unique(x)) for x in R.run_hashes(R.words_of(texts), n)]


def signed(n: int, bands: int, rows: int):
    """The same as a function of columns."""
    of = signer(n, bands, rows, maps=True)

    @F.pandas_udf("n int, keys array<long>, bits array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([x for group in R.grouped(texts) for x in of(group)], columns=["n", "keys", "bits"])

    return sign


def may_link(n: F.Column, bits: F.Column, m: F.Column, other: F.Column, percent: int) -> F.Column:
    """Whether sets of n and m runs with such parity maps can have that Jaccard similarity."""
    differ = reduce(add, [F.bit_count(bits[i].bitwiseXOR(other[i])) for i in range(LONGS)])
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def alike(n: int, percent: int):
    """A function from two lower-cased texts to whether their runs have at least that Jaccard similarity, exactly, by their words."""

    def close(x: set, y: set) -> bool:
        shared = len(x & y)
        return 100 * shared >= percent * (len(x) + len(y) - shared)

    @F.pandas_udf("boolean")
    def judge(one: pd.Series, two: pd.Series) -> pd.Series:
        out, last, x = [], None, set()
        for a, b in zip(one, two, strict=True):
            if a != last:
                last, x = a, runs(a, n)
            out.append(close(x, runs(b, n)))
        return pd.Series(out, dtype=bool)

    return judge


def near_duplicates(docs: DataFrame, *, id_col: str, text_col: str, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row its id, n_shingles, component_id (the smallest id reachable by links, itself included) and whether it is that one.

    Null and blank texts link with nothing. Texts of fewer than n words link with equal texts only. Rows that share an id
    are rows each; null ids count as greater than all others. Other columns are ignored.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    live = docs.where(F.col("text").rlike(r"\S")).withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    classes = live.groupBy("key").agg(F.min("id").alias("first")).withColumn("cls", F.monotonically_increasing_id())
    classes = written(classes, "text-classes")
    # One text of each class. Rows that agree in id and text give it again, which changes nothing below.
    of = live.withColumnRenamed("id", "own").join(classes.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("own").eqNullSafe(F.col("first")))
    texts = written(of.select("cls", F.lower("text").alias("text")), "class-texts")
    signatures = written(texts.select("cls", signed(n, bands, rows)("text").alias("s")).select("cls", "s.*"), "signatures")
    sizes = signatures.groupBy("cls").agg(F.first("n").alias("n"))
    buckets = signatures.where("keys is not null").select("cls", F.posexplode("keys").alias("band", "key")).dropDuplicates(["cls", "band"])
    maps = signatures.where("keys is not null").dropDuplicates(["cls"])
    shared = buckets.groupBy("band", "key").agg(F.min("cls").alias("head"), F.count("*").alias("members")).where("members > 1").drop("members")
    buckets = written(buckets, "buckets")
    shared = written(shared, "bucket-heads")
    members = written(spread_join(buckets, shared, ["band", "key"]), "members")
    dropped(buckets, shared)
    heads = members.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()
    # A class that heads very many pairs is joined where they are.
    heads = spread_join(written(heads, "head-pairs"), maps.select(F.col("cls").alias("a"), F.col("n").alias("n"), F.col("bits").alias("x")), ["a"])
    heads = heads.join(maps.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    linked = written(_verified(heads.where(may_link(F.col("n"), F.col("x"), F.col("m"), F.col("y"), percent)).select("a", "b"), texts, n, percent), "links")
    # What did not link with its bucket's head meets the bucket's other members, unless other links connect the two by now.
    if linked.isEmpty():
        parts = members.withColumn("part", F.col("cls"))
    else:
        reached = written(connected_components(linked), "first-components").withColumnRenamed("node", "cls")
        parts = spread_join(members, reached, ["cls"], "left").withColumn("part", F.coalesce("root", "cls")).drop("root")
    whole, members = members, written(parts.where("cls <> head"), "members")
    dropped(whole)
    rest = members.join(linked.select(F.col("a").alias("head"), F.col("b").alias("cls")), ["head", "cls"], "left_anti")
    # Only buckets with a rest are read on, with the maps of their members.
    members = members.join(written(rest.select("band", "key").distinct(), "rest-buckets"), ["band", "key"], "left_semi")
    mapped = lambda df, c, n, bits, part: df.join(maps.select("cls", "n", "bits"), "cls").select("band", "key", F.col("cls").alias(c), F.col("n").alias(n), F.col("bits").alias(bits), F.col("part").alias(part))
    pairs = mapped(rest, "b", "m", "y", "other").join(mapped(members, "a", "n", "x", "part"), ["band", "key"]).where("part <> other")
    pairs = pairs.where(may_link(F.col("n"), F.col("x"), F.col("m"), F.col("y"), percent))
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    found = linked if pairs.isEmpty() else linked.unionByName(written(_verified(pairs, texts, n, percent), "links"))
    dropped(texts)
    root = classes.select("cls", "key", "first").join(sizes, "cls")
    if not found.isEmpty():
        root = root.join(connected_components(found).withColumnRenamed("node", "cls"), "cls", "left")
    else:
        root = root.withColumn("root", F.lit(None).cast("long"))
    root = written(root.withColumn("root", F.coalesce("root", "cls")), "roots")
    root = root.join(root.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("key", "n", "component_id")
    named = spread_join(written(live.select("id", "key"), "keys"), written(root, "components"), ["key"]).select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    blank = docs.where(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).select("id", F.lit(0).alias("n_shingles"), F.col("id").alias("component_id"))
    return named.unionByName(blank).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose texts are as similar as asked."""
    pairs = written(pairs, "candidates")
    # Only texts that are in a pair move. Their classes are broadcast up to SMALL rows of a number each, else joined by shuffle.
    need = written(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct(), "candidate-classes")
    texts = texts.join(F.broadcast(need) if need.count() <= SMALL else need, "cls", "left_semi")
    # A class that heads very many pairs is joined where they are.
    one = spread_join(pairs, texts.select(F.col("cls").alias("a"), F.col("text").alias("one")), ["a"])
    both = one.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("two")), "b")
    return both.where(alike(n, percent)("one", "two")).select("a", "b").distinct()
