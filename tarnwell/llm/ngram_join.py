"""Exact Jaccard join on word shingles by T-occurrence search.

Two texts link when their sets of shingles have at least `num / den` of their union in common. Texts with the same words
in the same order form a class (by 128 bits of BLAKE2), and only classes are compared. Three exact steps:

1. Each set gives the part of its shingles with the smallest hashes. Sets that link share at least `least` of these
   (the prefix bound with room for more). They are dealt by hash over the cluster and those that no other set of a
   fitting size has are dropped. A set that keeps fewer than `least` links with nothing; of the others the
   `least - 1` most frequent are dropped too, since the rarest common one is never among them.
2. The remaining ones tie the classes into groups, which hold all links inside them.
3. Each group is searched in memory by inverted lists with DivideSkip: the short lists are merged by a heap that skips
   ids which can't be frequent enough, the long ones are only probed by binary search for the ids that the merge found,
   and classes with the required overlap link.

Hashes only choose candidates. Sets are counted and compared by the shingles' words themselves, so no collision makes a
link; where hashes agree within a set, its prefix has all of them. Only texts over BLOCK bytes are counted and compared
by 64-bit hashes of their shingles, whose words have BLAKE2 digests.

A group of more than MEMBERS classes, or GROUP shingles, is dealt in blocks, by sizes and then by hash. All blocks are
first searched for a few of the group's own sets (hubs), and the links found are joined to components. A link that is
still missing has an end outside the group's largest component; so only the classes outside it are then searched for,
in all blocks of fitting sizes. Each search is one task of at most two blocks; no pair of components is left out.

Nulls, empty texts and texts of white space have no shingles and link with nothing. Rows that repeat a text are in its
class. A component's id is its smallest doc_id that is not null; a row alone has its own. Ties of hashes or sizes change
no result. An empty table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Classes, and shingles, of a group or of a block of a larger group.
MEMBERS, GROUP = 256, 300_000
#: Sets of each size range of a large group that all its blocks are first searched for.
HUBS = 6
#: Shingle rows after which a task passes on what it has sorted by bucket.
FLUSH = 1_000_000
#: Shingle rows of one bucket from which its most frequent ones are passed on as they come.
HOT = 1_000_000
#: A broadcast table has at most so many rows of six numbers (16 MB).
SMALL = 200_000
#: How much a probe costs against a step of the heap, by the logarithm of the longest list: DivideSkip's constant.
PROBE = 0.0085


def ceil_div(a, b: int):
    return -(-a // b)


def room(n):
    """By how many the prefix of a set of n shingles is longer than the least bound asks for, plus one."""
    return np.maximum(1, n * 15 // 100)


def prefix_len(n, num: int, den: int):
    return np.minimum(n, n - ceil_div(n * num, den) + room(n))


def least(n, num: int, den: int):
    """How many shingles of its prefix a set of n has in common with any set that it links with, at the least."""
    return np.minimum(room(n), room(ceil_div(n * num, den)))


def required(a, b, num: int, den: int):
    """The overlap that sets of a and b shingles need."""
    return ceil_div((a + b) * num, num + den)


# --- texts to classes and prefixes ----------------------------------------------------------------------------------


class Sequence:
    """The key of a text's words in their order, fed in pieces that end between words."""

    def __init__(self):
        self.digest, self.empty = hashlib.blake2b(digest_size=16), True

    def add(self, low: np.ndarray) -> None:
        found = b" ".join(low.tobytes().split())  # at ASCII white space
        if found:
            self.digest.update(found if self.empty else b" " + found)
            self.empty = False

    def key(self) -> bytes:
        return bytes(16) if self.empty else self.digest.digest()


def tokens(h: np.ndarray, n: int) -> np.ndarray:
    """The n least of sorted hashes and all that equal the last; equal ones are told apart by their number."""
    h = h[: np.searchsorted(h, h[n - 1], "right")]
    same = h[1:] == h[:-1]
    if same.any():
        nth = np.arange(len(h)) - np.searchsorted(h, h)
        h = np.where(nth > 0, C.mix(h + nth.astype(C.U64)), h)
    return h


def read_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, bytes]]:
    """(row, size of its set, hashes ascending, key) of each row."""
    for lo, hi, part, starts in C.blocks(data, at):
        if hi - lo == 1 and len(part) > C.BLOCK + C.BLOCK // 4:
            yield lo, *long_set(part, k)
            continue
        low = C.LOWER[part]
        for i, h in enumerate(C.shingles(part, starts, k)):
            one = Sequence()
            one.add(low[starts[i] : starts[i + 1]])
            yield lo + i, max(len(h), int(not one.empty)), h, one.key()


def long_hashes(part: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of the distinct shingles of one long text, ascending; it is read in pieces that share k - 1 words."""
    found, lead = [], b""
    for _, _, piece, _, more in C.pieces(part, np.array([0, len(part)])):
        body = np.concatenate((np.frombuffer(lead, np.uint8), piece))
        w = C.Words(body, np.array([0, len(body)]))
        h = w.hashes(k)
        found.append(np.unique(C.mix(h ^ C.U64(salt)) if salt else h))
        if len(found) > 8:
            found = [np.unique(np.concatenate(found))]
        lead = body[w.start[max(0, len(w.start) - k + 1)] :].tobytes() if more and len(w.start) and k > 1 else b""
    return np.unique(np.concatenate(found))


def long_set(part: np.ndarray, k: int) -> tuple[int, np.ndarray, bytes]:
    one = Sequence()
    for _, _, piece, _, _ in C.pieces(part, np.array([0, len(part)])):
        one.add(C.LOWER[piece])
    h = long_hashes(part, k)
    return max(len(h), int(not one.empty)), h, one.key()


PART = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("ids", pa.binary()), ("null", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("tokens", pa.binary())])
PART_SQL = "bucket int, kind byte, ids binary, null binary, sizes binary, keys binary, tokens binary"


def _parts(k: int, num: int, den: int, buckets: int):
    """Texts to packed rows for each bucket: documents (id, set size, key of 16 bytes), and tokens with set size and the key's first half."""

    def token_rows(toks: list) -> Iterator[list]:
        t = np.concatenate([x[0] for x in toks])
        n = [len(x[0]) for x in toks]
        key = np.repeat(np.array([x[1] for x in toks], np.int64), n)
        size = np.repeat(np.array([x[2] for x in toks], np.int32), n)
        # Tokens are least hashes, so they crowd at 0: mixed again before they are dealt.
        b = ((C.mix(t) >> C.U64(32)) * C.U64(buckets) >> C.U64(32)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        t, key, size = t[order], key[order], size[order]
        for i in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[i], cut[i + 1])
            yield [i, 1, b"", b"", size[s].tobytes(), key[s].tobytes(), t[s].tobytes()]

    def doc_row(docs: list) -> list:
        ids, sizes, keys = zip(*docs, strict=True)
        spread = int.from_bytes(keys[0][:4], "little") % buckets
        return [spread, 0, np.array([0 if i is None else i for i in ids], np.int64).tobytes(), np.array([i is None for i in ids], np.int8).tobytes(), np.array(sizes, np.int32).tobytes(), b"".join(keys), b""]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []
        toks: list = []
        held, seen = 0, set()

        def flush():
            nonlocal docs, toks, held
            rows = [doc_row(docs)] if docs else []
            if toks:
                rows += token_rows(toks)
            docs, toks, held = [], [], 0
            seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PART, strict=True)], schema=PART)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, at = C.text_bytes(batch.column(1))
            for i, n, h, key in read_sets(data, at, k):
                docs.append((ids[i], n, key))
                if len(h) and key not in seen:
                    seen.add(key)
                    t = tokens(h, int(prefix_len(n, num, den)))
                    toks.append((t, int.from_bytes(key[:8], "little", signed=True), n))
                    held += len(t)
                if held >= FLUSH or len(docs) > 1 << 16:
                    yield from flush()
        yield from flush()

    return run


FOUND = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("n", pa.int32()), ("cls", pa.binary()), ("half", pa.int64()), ("token", pa.int64()), ("df", pa.int32())])
FOUND_SQL = "kind byte, id long, n int, cls binary, half long, token long, df int"
MOST = np.iinfo(np.int32).max


def _shared(num: int, den: int):
    """A partition of buckets, in their order, to its documents, and the tokens that classes of fitting sizes share.

    One bucket is held at a time. Of a bucket that grows beyond HOT rows the tokens which make up most of it count as
    shared by everyone: what is held of them, and all that follows, is passed on without being compared.
    """

    def out(t, size, key, df) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(t), 1 << 16):
            s = slice(a, a + (1 << 16))
            n = len(t[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.int64()), pa.array(size[s].astype(np.int32)), pa.nulls(n, pa.binary()), pa.array(key[s]), pa.array(t[s].view(np.int64)), pa.array(df[s].astype(np.int32))], schema=FOUND)

    def documents(ids, null, size, key) -> pa.RecordBatch:
        n = len(size) // 4
        none = pa.nulls(n, pa.int64())
        keys = pa.array([key[i : i + 16] for i in range(0, len(key), 16)], pa.binary())
        half = np.frombuffer(key, np.int64)[::2]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(null, np.int8) != 0), pa.array(np.frombuffer(size, np.int32)), keys, pa.array(half), none, none.cast(pa.int32())], schema=FOUND)

    def whole(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, key, t = (np.concatenate([np.frombuffer(r[i], kind) if isinstance(r[i], bytes) else r[i] for r in rows]) for i, kind in enumerate((np.int32, np.int64, np.uint64)))
        return t, size, key

    def shared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        t, size, key = whole(rows)
        order = np.argsort(t)
        t = t[order]
        near = np.zeros(len(t), bool)
        same = t[1:] == t[:-1]
        near[1:] |= same
        near[:-1] |= same
        order, t = order[near], t[near]
        size, key = size[order], key[order]
        order = np.lexsort((key, size, t))  # by token, size, class
        t, size, key = t[order], size[order], key[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (size[1:] != size[:-1])
        t, size, key = t[new], size[new].astype(np.int64), key[new]
        fits = (t[1:] == t[:-1]) & (size[:-1] * den >= size[1:] * num)
        near = np.zeros(len(t), bool)
        near[1:] |= fits
        near[:-1] |= fits
        edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        df = np.repeat(np.diff(np.append(edge, len(t))), np.diff(np.append(edge, len(t))))
        yield from out(t[near], size[near], key[near], df[near])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, limit, bucket, hot = 0, HOT, None, np.zeros(0, np.uint64)
        for batch in batches:
            for at, kind, ids, null, size, key, token in zip(*(batch.column(x).to_pylist() for x in PART.names), strict=True):
                if kind == 0:
                    yield documents(ids, null, size, key)
                    continue
                if at != bucket:
                    if rows:
                        yield from shared(rows)
                    rows, held, limit, bucket, hot = [], 0, HOT, at, hot[:0]
                if len(hot):
                    t, size, key = whole([(size, key, token)])
                    known = np.isin(t, hot)
                    yield from out(t[known], size[known], key[known], np.full(int(known.sum()), MOST))
                    size, key, token = size[~known], key[~known], t[~known]
                    held += len(token)
                else:
                    held += len(token) // 8
                rows.append((size, key, token))
                if held > limit:
                    t, size, key = whole(rows)
                    name, n = np.unique(t, return_counts=True)
                    found = name[n > max(8, len(t) // 16)]
                    known = np.isin(t, found)
                    yield from out(t[known], size[known], key[known], np.full(int(known.sum()), MOST))
                    hot = np.union1d(hot, found)
                    rows, held = [(size[~known], key[~known], t[~known])], int((~known).sum())
                    limit = max(HOT, 2 * held)  # a bucket that is just large
        if rows:
            yield from shared(rows)

    return run


# --- the search -----------------------------------------------------------------------------------------------------


def heap_merge(ids: list[int], spans: list[tuple[int, int]], need: int, tally: dict | None = None) -> Iterator[tuple[int, int]]:
    """(id, count) of the ids that at least `need` of the ascending lists have; spans are places in `ids`.

    A heap has the next id of each list. An id that heads too few lists is passed over: need - 1 lists are taken off, and
    all of these jump by binary search to the first id that the other lists have yet to offer.
    """
    heap = [(ids[a], j) for j, (a, b) in enumerate(spans) if a < b]
    heapify(heap)
    place = [a for a, _ in spans]
    steps = 0
    while len(heap) >= need and heap:
        top, off = heap[0][0], []
        while heap and heap[0][0] == top:
            off.append(heappop(heap)[1])
        steps += len(off)
        if len(off) >= need:
            yield top, len(off)
            for j in off:
                place[j] = p = place[j] + 1
                if p < spans[j][1]:
                    heappush(heap, (ids[p], j))
        else:
            while heap and len(off) < need - 1:
                off.append(heappop(heap)[1])
            if not heap:
                break
            top = heap[0][0]
            for j in off:
                place[j] = p = bisect_left(ids, top, place[j], spans[j][1])
                if p < spans[j][1]:
                    heappush(heap, (ids[p], j))
    if tally is not None:
        tally["heap"] = tally.get("heap", 0) + steps


def search(sets: list[np.ndarray], against: list[np.ndarray] | None, num: int, den: int, *, joined: Callable[[int, int], bool] | None = None, tally: dict | None = None) -> Iterator[tuple[int, int]]:
    """T-occurrence search: (query, found) for each set in `sets` and each in `against` with the required overlap.

    Without `against`, the sets are searched among themselves, each pair once. DivideSkip: of a query's lists the longest
    are set aside, so many that an id which has T lists must have a fair number of the others; these short ones are
    merged by a heap, and only what the merge finds is probed for in the long lists, by binary search, until it has its
    overlap or can't reach it. `joined` tells pairs of which nothing need be known; tally counts heap steps and probes.
    """
    own = against is None
    index = sets if own else against
    size = np.array([len(s) for s in index], np.int64)
    by = np.argsort(size, kind="stable")  # ids go by size, so those of fitting sizes are a range
    size = size[by]
    owner = np.repeat(np.arange(len(by)), size)
    flat = np.concatenate([index[i] for i in by.tolist()]) if len(by) else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    posting = np.empty(len(order), np.int64)  # where each set's own entries stand in the lists
    posting[order] = np.arange(len(order))
    names, start = np.unique(flat[order], return_index=True)
    stop = np.append(start[1:], len(flat))
    ids = owner[order].tolist()
    edge = np.concatenate(([0], np.cumsum(size)))
    probes = 0
    for q in range(len(by)) if own else range(len(sets)):
        s = flat[edge[q] : edge[q + 1]] if own else sets[q]
        n = len(s)
        if not n:
            continue
        low = ceil_div(n * num, den)
        first = int(np.searchsorted(size, low))
        last = q if own else int(np.searchsorted(size, n * den // num, "right"))
        if first >= last:
            continue
        slot = np.searchsorted(names, s)
        slot[slot == len(names)] = 0
        has = names[slot] == s
        a, b = start[slot[has]], posting[edge[q] : edge[q + 1]] if own else stop[slot[has]]
        some = a < b
        a, b = a[some], b[some]
        need = int(required(n, max(low, int(size[first])), num, den))  # the least overlap with any set of a fitting size
        if len(a) < need:
            continue
        reach = b - a
        order = np.argsort(reach, kind="stable")
        a, b = a[order].tolist(), b[order].tolist()
        apart = min(need - 1, int(need / (PROBE * log2(int(reach.max())) + 1)))
        short = len(a) - apart
        spans = [(bisect_left(ids, first, x, y), bisect_left(ids, last, x, y)) for x, y in zip(a[:short], b[:short], strict=True)]
        for j, count in heap_merge(ids, spans, need - apart, tally):
            other = int(by[j])
            if joined is not None and joined(int(by[q]) if own else q, other):
                continue
            want = int(required(n, int(size[j]), num, den))
            left = apart
            while left and count < want <= count + left:  # the shortest of the long lists last: they miss most
                left -= 1
                p = bisect_left(ids, j, a[short + left], b[short + left])
                count += p < b[short + left] and ids[p] == j
                probes += 1
            if count >= want:
                yield (int(by[q]) if own else q), other
    if tally is not None:
        tally["probes"] = tally.get("probes", 0) + probes


def named_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sets of a task's texts, by numbers that only equal shingles share; by hashes if one of the texts is too long."""
    if len(at) > 1 and int(np.diff(at).max()) > C.BLOCK + C.BLOCK // 4:
        return [long_hashes(data[a:b], k) if b > a else np.zeros(0, np.uint64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    w = C.Words(data, at)
    name = C.runs_of(w.ids, k)
    return [np.unique(name[a : max(a, b - k + 1)]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def _search(k: int, num: int, den: int):
    """The links of one task, each component as a star. Side 0 is searched for in side 1, or in itself if there is none."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        data, at = C.text_bytes(rows.column("text"))
        sets = named_sets(data, at, k)
        key, side = rows.column("rep").to_numpy(), rows.column("side").to_numpy()
        nodes, node = np.unique(key, return_inverse=True)
        root = list(range(len(nodes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        here, there = node[left].tolist(), node[right if len(right) else left].tolist()
        joined = lambda a, b: find(here[a]) == find(there[b])
        for a, b in search([sets[i] for i in left], [sets[i] for i in right] if len(right) else None, num, den, joined=joined):
            x, y = find(here[a]), find(there[b])
            root[max(x, y)] = min(x, y)
        low = nodes[[find(i) for i in range(len(nodes))]]
        live = low != nodes
        return pa.table({"a": nodes[live], "b": low[live]})

    def lean(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            if rows.nbytes > 1 << 22:
                C.released()

    return lean


# --- the join -------------------------------------------------------------------------------------------------------


def _by(df: DataFrame, *keys: str) -> DataFrame:
    """The weight of each of `keys` and its number of blocks."""
    parts = F.greatest(F.ceil(F.count("*") / F.lit(MEMBERS)), F.ceil(F.sum("n") / F.lit(GROUP)))
    return df.groupBy(*keys).agg(parts.cast("int").alias("parts"))


def _blocked(df: DataFrame, name: str) -> DataFrame:
    """(rep, grp, n, band) with the number of its block; a block's sets are all of one band."""
    parts = _by(df, "grp", "band")
    block = F.col("band") * F.lit(1 << 20) + F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("parts"))
    return df.join(parts, ["grp", "band"]).withColumn(name, block.cast("long")).drop("parts")


def near_groups(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id."""
    spark = C.ready(docs.sparkSession)
    scratch = C.Scratch(spark, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if C.unique(docs, "doc_id"):
        return _grouped(docs, scratch, k, num, den)
    # Rows are told apart by numbers of their own; a component's id comes from the ids of its rows.
    rows = scratch.table(docs.withColumn("row", F.monotonically_increasing_id()))
    found = _grouped(rows.select(F.col("row").alias("doc_id"), "text"), scratch, k, num, den)
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("root")).join(rows.select("row", "doc_id"), "row")
    found = scratch.table(found)
    smallest = found.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least_id"))
    return found.join(smallest, "root", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _grouped(docs: DataFrame, scratch: C.Scratch, k: int, num: int, den: int) -> DataFrame:
    """The same for rows (doc_id, text) whose ids are all different. A class is named by its smallest id (rep)."""
    spark = docs.sparkSession
    p = C.partitions(spark)
    packed = docs.mapInArrow(C.lean(_parts(k, num, den, 16 * p)), PART_SQL)
    found = scratch.table(packed.repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(C.lean(_shared(num, den)), FOUND_SQL))
    rows = found.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "cls", "half")
    classes = scratch.table(rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("half").alias("half")))
    kept = scratch.table(_kept(found.where("kind = 1").select("half", "n", "token", "df"), num, den).join(classes.select("half", "rep"), "half").select("rep", "n", "token"))
    centre = kept.groupBy("token").agg(F.min("rep").alias("b"), F.count("*").alias("c")).where("c > 1").select("token", "b")
    ties = C.spread_join(kept, centre, "token", scratch).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    group = C.components(ties, scratch)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)))).cast("int") if num < den else F.col("n")
    members = group.select(F.col("node").alias("rep"), F.col("root").alias("grp")).join(kept.groupBy("rep").agg(F.max("n").alias("n")), "rep").select("rep", "grp", "n", band.alias("band"))
    members = scratch.table(members)
    scratch.drop(kept)

    links = _links(docs, members, scratch, k, num, den)
    root = links.select(F.col("a").alias("rep"), F.col("b").alias("root"))
    named = classes.join(root, "rep", "left").select("cls", F.coalesce("root", "rep").alias("component_id"))
    return rows.join(named, "cls", "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _kept(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Of each class's shared tokens those that may be the rarest common one, if it has enough."""
    bound = lambda x: F.greatest(F.lit(1), F.expr(f"({x}) * 15 div 100"))
    need = F.least(bound("n"), bound(f"(n * {num} + {den - 1}) div {den}"))
    by = Window.partitionBy("half")
    kept = shared.withColumn("shared", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("df"), "token")))
    return kept.withColumn("n", F.col("n").cast("long")).where((F.col("shared") >= need) & (F.col("rank") >= need)).select("half", "n", "token")


def _links(docs: DataFrame, members: DataFrame, scratch: C.Scratch, k: int, num: int, den: int) -> DataFrame:
    """(a, b): each class that links with another, and the smallest one it reaches."""

    def searched(jobs: DataFrame) -> DataFrame:
        """jobs: rep, grp, x, y, side; a task for each grp, x and y."""
        texts = docs.join(C.bounded(docs.sparkSession, jobs.withColumnRenamed("rep", "doc_id"), SMALL), "doc_id").withColumnRenamed("doc_id", "rep")
        return scratch.table(texts.select("grp", "x", "y", "side", "rep", "text").groupBy("grp", "x", "y").applyInArrow(_search(k, num, den), "a long, b long"))

    over = _by(members, "grp").where("parts > 1").select("grp")
    over = scratch.table(over)
    zero = F.lit(0).cast("long")
    small = scratch.table(members.join(over, "grp", "left_anti").select("rep", "grp", zero.alias("x"), zero.alias("y"), F.lit(0).alias("side")))
    found = searched(small)
    if over.isEmpty():
        return found  # each group was whole in its task
    large = scratch.table(_blocked(members.join(over, "grp", "left_semi"), "x"))
    hubs = large.withColumn("nth", F.row_number().over(Window.partitionBy("grp", "band").orderBy(F.xxhash64("rep"), "rep"))).where(F.col("nth") <= HUBS).select("rep", "grp", "band")
    blocks = large.groupBy("grp", "band", "x").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    none = F.lit(-1).cast("long").alias("y")
    jobs = hubs.join(blocks, ["grp", "band"]).select("rep", "grp", "x", none, F.lit(0).alias("side")).union(large.select("rep", "grp", "x", none, F.lit(1).alias("side")))
    first = searched(scratch.table(jobs))

    # What is outside each group's largest component is searched for in all blocks of fitting sizes.
    root = C.components(first, scratch).select(F.col("node").alias("rep"), "root")
    large = scratch.table(large.join(root, "rep", "left").withColumn("part", F.coalesce("root", "rep")).drop("root"))
    main = large.groupBy("grp", "part").agg(F.sum("n").alias("weight")).groupBy("grp").agg(F.expr("max_by(part, struct(weight, -part))").alias("part"))
    rest = large.join(main, ["grp", "part"], "left_anti").select("rep", "grp", "n", "band")
    rest = scratch.table(_blocked(rest, "x"))
    ends = rest.groupBy("grp", "x").agg(F.min("n").alias("lo1"), F.max("n").alias("hi1"))
    pairs = ends.join(blocks.select("grp", F.col("x").alias("y"), "lo", "hi"), "grp").where(f"hi1 * {den} >= lo * {num} and hi * {den} >= lo1 * {num}").select("grp", "x", "y")
    left = rest.join(pairs, ["grp", "x"]).select("rep", "grp", "x", "y", F.lit(0).alias("side"))
    right = large.withColumnRenamed("x", "y").join(pairs, ["grp", "y"]).select("rep", "grp", "x", "y", F.lit(1).alias("side"))
    last = searched(scratch.table(left.union(right)))
    both = C.components(first.union(last), scratch)
    return found.union(both.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: 4-word shingles, 85 of 100."""
    return near_groups(C.documents(spark, sf_dir, "doc_id", "text"), k=4, num=85, den=100)


def sql(k: int = 4, num: int = 85, den: int = 100) -> str:
    """The same for DuckDB: every pair that shares a shingle, and all that each document reaches."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= {k} THEN list_transform(range(1, len(words) - {k} + 2), lambda i: list_slice(words, i, i + {k - 1})) WHEN len(words) > 0 THEN [words] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, hash(g) AS h, g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.h = b.h AND a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(c) AS component_id FROM r GROUP BY v) m ON m.v = d.doc_id
"""


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group of near duplicates (5 words, 0.8) the document with the smallest id stays.

    Documents without words have no group and all stay. Where ids repeat or are null, rows are numbered first and
    the first row of a group stays.
    """
    row, own = "doc_id", C.own(docs)
    if not C.unique(docs, row):
        row = C.fresh(docs, "_row")
        docs = C.Scratch(spark, "near-stage").table(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_groups(docs, k=5, num=80, den=100, id_col=row).where("doc_id = component_id").select(F.col("doc_id").alias(row))
    return docs.join(found, row, "left_semi").select(own)
