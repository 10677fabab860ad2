"""What the operators share: scratch tables in the shared folder, text read as bytes, hashing, components."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes that part words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


#: Bounds of the Arrow batches that Python gets, set unless the caller has set others: (setting, Spark's default, ours).
_ARROW = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "500"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16m"))


def ready(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python gets and gives the executors this package.

    The bounds stay set, for results are worked out after the operator has returned; a caller's own are left alone.
    """
    for name, default, ours in _ARROW:
        if spark.conf.get(name, default) in (default, default.removesuffix("b"), "64MB", "64m", ours):
            spark.conf.set(name, ours)
    sc = spark.sparkContext
    if not getattr(sc, "_tarnwell_sent", False):
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="tarnwell-"), "tarnwell-code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(os.path.join(top, "tarnwell")):
                for x in names:
                    if x.endswith(".py"):
                        z.write(os.path.join(d, x), os.path.relpath(os.path.join(d, x), top))
        sc.addPyFile(path)
        sc._tarnwell_sent = True
    return spark


def partitions(spark: SparkSession) -> int:
    """The session's own number of shuffle partitions: what grows with the input is dealt over so many."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of `documents`. Where the scan has fewer splits than there are cores, its rows are dealt over all of them."""
    docs = load(spark, sf_dir, "documents")
    docs = docs.select(*columns) if columns else docs
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores else docs


#: Spark's own setting that removes an execution's shuffle files at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to spark.checkpoint.dir, where every executor can read them again after a loss.

    They cut the lineage, and the shuffle files behind a table go once it is written. `drop` removes a table that
    nothing reads any more; what a returned result still reads goes when Python ends. With no shared folder set, a local
    session uses a folder of its own, and any other is an error: executors could not read what others wrote.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
            base = os.path.join(tempfile.gettempdir(), "tarnwell-scratch")
        self.spark, self.top, self.n = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        conf, old = self.spark.conf, self.spark.conf.get(_CLEAN, "false")
        conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(_CLEAN, old)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._kept_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        try:
            self._delete(self.top)
        except Exception:  # the session has ended; the cluster's own cleaning removes the folder
            pass


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of tables that have been written out."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


# --- texts as bytes -------------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings or binaries and where each row starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8, at[-1] - at[0], int(at[0])) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(data: np.ndarray, at: np.ndarray, size: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) of runs of whole rows of about `size` bytes (BLOCK)."""
    size = size or BLOCK
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def pieces(data: np.ndarray, at: np.ndarray, size: int = 0, gap: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """Blocks, but a row of more than `size` bytes (BLOCK) comes in several, cut before words: (first row, end row, bytes, starts, more).

    more: whether the row goes on in the next one. A word, parted by bytes in `gap`, is never cut, so one that is longer
    than that is whole.
    """
    size = size or BLOCK
    for lo, hi, part, starts in blocks(data, at, size):
        begin = 0
        while len(part) - begin > size + size // 4:
            cut = begin + size
            while cut < len(part):  # to the first word that begins from here on
                near = gap[part[cut - 1 : cut + 4096]]
                found = np.flatnonzero(near[:-1] & ~near[1:])
                if len(found):
                    cut += int(found[0])
                    break
                cut += 4096
            if cut >= len(part):
                break
            yield lo, hi, part[begin:cut], np.array([0, cut - begin]), True
            begin = cut
        yield (lo, hi, part[begin:], np.array([0, len(part) - begin]), False) if begin else (lo, hi, part, starts, False)


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash, so that all its bits depend on all others."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@lru_cache(3)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, U64(b))
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class Rolling:
    """Hashes of all spans of one length in a block, from sums of bytes times powers.

    Unequal spans can agree, and can be made to: it may choose candidates, but says nothing about equality.
    """

    def __init__(self, data: np.ndarray):
        n = 1 << max(20, int(len(data)).bit_length())
        self.up, self.down = powers(n)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def spans(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _eight(data: np.ndarray) -> np.ndarray:
    """Of a block with eight bytes behind it: the eight bytes from each place on as one number (a view)."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], U64)


def span_hashes(padded: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of spans of a block that eight zero bytes end, eight bytes a round; no sums, so nothing cancels."""
    view = _eight(padded)
    size = end - start
    h = mix(size.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    live, at = np.flatnonzero(size > 0), 0
    while len(live):
        if at == 64:  # the few that are longer: one by one
            raw = padded.tobytes()
            for i in live.tolist():
                h[i] ^= U64(int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little"))
            break
        got = view[start[live] + at] & _MASK[np.minimum(size[live] - at, 8)]
        h[live] = mix(mix(got + U64((at + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) + h[live])
        at += 8
        live = live[size[live] > at]
    return h


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of spans that follow one another without overlap, and the distinct spans by number.

    Arrow compares the bytes themselves, so equal numbers mean equal bytes.
    """
    n = len(start)
    edge = np.zeros(2 * n + 2, np.int64)
    edge[1:-1:2], edge[2:-1:2], edge[-1] = start, end, len(data)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n + 1, [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))])
    spans = whole.take(pa.array(np.arange(1, 2 * n, 2))).dictionary_encode()
    return spans.indices.to_numpy(zero_copy_only=False).astype(np.int64), spans.dictionary.to_pylist()


def digests(spans: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, which nobody can make agree at will."""
    make = partial(hashlib.blake2b, digest_size=8)
    return np.frombuffer(b"".join([make(x).digest() for x in spans]), U64)


def words(data: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, which bytes in `gap` part, and the number of words before each row."""
    solid = ~gap[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)


def named_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs of numbers under 2**31: equal pairs, and only they, have equal numbers."""
    found = pa.array(a * np.int64(1 << 31) + b).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def runs_of(ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the runs of k words from each word on, from the words' own numbers: equal only for equal runs."""
    if len(ids) < k:
        return ids[:0]
    have = 1
    while have < k:
        step = min(have, k - have)  # two runs of `have` that begin `step` apart cover have + step words
        ids = named_pairs(ids[: len(ids) - step], ids[step:])
        have += step
    return ids


class Words:
    """The words of a block, lower-cased in A-Z: where they are, their exact numbers, and the distinct ones."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.low = LOWER[data]
        self.start, self.end, self.first = words(self.low, at)
        self.ids, self.book = numbered(self.low, self.start, self.end)

    def hashes(self, k: int) -> np.ndarray:
        """A hash of the run of k words from each word on."""
        one = digests(self.book)[self.ids] if len(self.ids) else np.zeros(0, U64)
        n = max(0, len(one) - k + 1)
        h = np.full(n, U64(k))
        for j in range(k):
            h = mix(h + one[j : j + n])
        return h


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of a block the hashes of its distinct shingles of k words, ascending.

    Shingles are told apart by their words, so the number of hashes is the exact size of the set; a hash that several
    shingles of a row share is there as often. Rows with fewer than k words have none.
    """
    w = Words(data, at)
    name, h = runs_of(w.ids, k), w.hashes(k)
    edge = np.stack((w.first[:-1], np.maximum(w.first[:-1], w.first[1:] - k + 1)), 1)  # of each row the runs that are its own
    n = np.diff(edge, axis=1)[:, 0]
    row = np.repeat(np.arange(len(n)), n)
    at_run = np.arange(len(row)) + np.repeat(edge[:, 0] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    pair = named_pairs(row, name[at_run]) if len(row) else row
    seen = np.zeros(int(pair.max(initial=-1)) + 1, np.int64)
    seen[pair[::-1]] = np.arange(len(pair))[::-1]  # where each shingle of a row is first
    one = np.sort(seen)
    row, h = row[one], h[at_run[one]]
    cut = np.searchsorted(row, np.arange(len(n) + 1))
    return [np.sort(h[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def released() -> None:
    """Gives memory back to the system: workers are used again by later tasks, whose executor shares what they hold."""
    import ctypes
    import gc

    powers.cache_clear()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


#: What a worker may keep from task to task of one operator, by name: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def lean(run, keep: str = ""):
    """A function on a partition's batches that leaves nothing behind in its worker but what `keep` names."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        for name, drop in KEPT.items():
            if name != keep:
                drop()
        try:
            yield from run(batches)
        finally:
            released()

    return whole


# --- components -----------------------------------------------------------------------------------------------------


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node each reaches, by repeated smallest neighbours and jumps."""
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        live = low != high
        if not live.any():
            break
        x, y = x[live], y[live]
        np.minimum.at(root, high[live], low[live])
        while not np.array_equal(jump := root[root], root):
            root = jump
    return nodes, nodes[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition, each component as a star; in rounds, so that little is held."""
    held_a, held_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = 0
    for batch in batches:
        held_a = np.concatenate((held_a, batch.column(0).to_numpy(zero_copy_only=False)))
        held_b = np.concatenate((held_b, batch.column(1).to_numpy(zero_copy_only=False)))
        rows += batch.num_rows
        if rows >= 1 << 20:
            held_a, held_b = merged(held_a, held_b)
            held_a, held_b = held_a[held_a != held_b], held_b[held_a != held_b]
            rows = 0
            if len(held_a) > 1 << 21:
                yield pa.RecordBatch.from_arrays([held_a, held_b], names=["a", "b"])
                held_a, held_b = held_a[:0], held_b[:0]
    if len(held_a):
        held_a, held_b = merged(held_a, held_b)
        yield pa.RecordBatch.from_arrays([held_a[held_a != held_b], held_b[held_a != held_b]], names=["a", "b"])


#: A key with fewer rows than that needs no join of its own.
HOT_ROWS = 1000


def spread_join(rows: DataFrame, other: DataFrame, key: str, scratch: Scratch, how: str = "inner") -> DataFrame:
    """rows joined with `other`, which has one row for a key, by shuffle; only hot keys, wherever their rows are, by broadcast.

    A key is hot if it has more than HOT_ROWS rows and more than one in 4p of all, p being the shuffle partitions. So fewer
    than 4p keys are hot, whatever the size of the input. `rows` is read several times: a written table, or a cheap view of one.
    """
    total = rows.count()
    if total <= HOT_ROWS:
        return rows.join(other, key, how)
    most = max(HOT_ROWS, total // (4 * partitions(scratch.spark)))
    hot = scratch.table(rows.groupBy(key).count().where(F.col("count") > most).select(key))
    if hot.isEmpty():
        return rows.join(other, key, how)
    hot = F.broadcast(hot)
    wide = rows.join(hot, key, "left_semi").join(F.broadcast(other.join(hot, key, "left_semi")), key, how)
    return wide.unionByName(rows.join(hot, key, "left_anti").join(other, key, how))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of (a, b): the smallest node it reaches.

    Each partition's links become stars, whose centre is the smallest node. A leaf of one star only, which most nodes are,
    takes the root of its centre at the end; so a centre with very many leaves does not bring them together. The other
    links go through `_stars`.
    """
    pairs = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(lean(_forest), "a long, b long")
    table = scratch.table(pairs)
    single = table.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("other")).where("b = other").select("a", "b")
    leaves = scratch.table(single.join(table.select(F.col("b").alias("a")).distinct(), "a", "left_anti"))
    core = scratch.table(table.join(leaves.select("a"), "a", "left_anti"))
    scratch.drop(table)
    if core.isEmpty():
        return leaves.select(F.col("a").alias("node"), F.col("b").alias("root")).union(leaves.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    root = scratch.table(_stars(core, scratch))
    ends = spread_join(leaves, root.withColumnRenamed("node", "b"), "b", scratch, "left").select(F.col("a").alias("node"), F.coalesce("root", "b").alias("root"))
    centres = leaves.select(F.col("b").alias("node")).distinct().join(root, "node", "left_anti").select("node", F.col("node").alias("root"))
    return root.union(ends).union(centres)


def _stars(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of links (a, b), by alternating large and small stars.

    Every step is a minimum for each node and a join that spreads nodes with very many links, so no node's neighbours are
    gathered, and every round is written to the shared folder. It ends when all links are stars: each leaf has one centre, and no centre is a leaf.
    """
    while True:
        # Large star: greater neighbours go to the smallest one of each node's neighbourhood.
        both = table.select("a", "b").union(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = spread_join(both.where("b > a"), low, "a", scratch).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours and the node itself go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        each = F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("s")
        small = large.join(low, "a").select(each).select(F.col("s.x").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct()
        new = scratch.table(small)
        scratch.drop(table)
        table = new
        state = table.groupBy("a").agg(F.countDistinct("b").alias("n")).join(table.select(F.col("b").alias("a"), F.lit(1).alias("centre")).distinct(), "a", "left")
        if state.where("n > 1 or centre = 1").isEmpty():
            break
    return table.select(F.col("a").alias("node"), F.col("b").alias("root")).union(table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def crc_mod(column: str, n: int) -> "F.Column":
    """crc32 of an id as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame) -> list:
    """The table's columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unique(df: DataFrame, column: str) -> bool:
    """Whether no value repeats or is null."""
    return df.groupBy(column).count().where(F.col(column).isNull() | (F.col("count") > 1)).isEmpty()


def bounded(spark: SparkSession, df: DataFrame, most: int) -> DataFrame:
    """The table to be broadcast if it has at most `most` rows; beyond, Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


LONG, BINARY = T.LongType(), T.BinaryType()
