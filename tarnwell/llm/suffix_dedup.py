"""Removal of repeated byte strings: candidates dealt over the cluster, difference-cover suffix sorts within tasks.

A byte goes if a string of `LENGTH` bytes covers it that also starts earlier: in a text of a smaller doc_id, or in the
same text before. All steps are exact and none holds more than a part of the corpus:

1. Texts that are equal form a class, told by SHA-256; its first document stands for it, later ones are removed as a whole.
   Where places go by a shorter hash, classes that it makes alike get numbers of their own first.
2. Each window of LENGTH bytes has an anchor, the k-gram with the least hash inside it, so equal windows have equal
   anchors. Anchors are dealt by hash; those that occur once are dropped, and with them nearly all text.
3. Each remaining anchor occurrence gives its context: the text under the windows that it is the anchor of. Contexts
   are dealt by the anchor's hash, equal ones (by 128 bits of BLAKE2) collapse to the first already where they are read.
   An anchor with more than WIDE occurrences is dealt window by window instead, so no task gets all of them.
4. Of an anchor that is left with several contexts, which differ somewhere, each task sorts the suffixes by the difference cover {1, 2} modulo 3: it sorts the sampled triples,
   recurses on their names until these cover LENGTH bytes, and merges the remaining suffixes. Adjacent prefixes are
   compared; of equal windows all but the earliest are repeats.
5. The spans of repeats go back to their texts by class.

Null and empty texts have no bytes; nothing is removed from texts under LENGTH bytes. A null doc_id comes before all
others. Rows that share id and text count as one document and have one result; different texts that share an id are
ordered by the hash of the text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH = 100
#: Windows have 64 k-grams each; 64 + K - 1 = LENGTH.
WINDOW = 64
K = LENGTH - WINDOW + 1
#: Longer texts are read in overlapping pieces of so many bytes.
PIECE = 1 << 22
#: Bits of a position inside a block, below the bits of a hash.
LOW = np.uint64((1 << 24) - 1)
#: Anchors, and bytes of contexts, that a task holds before it passes them on.
FLUSH_ANCHORS, FLUSH_BYTES = 1 << 18, 1 << 23
#: Occurrences beyond which an anchor's windows are dealt one by one.
WIDE = 5_000
#: Bytes of contexts that are sorted at once, unless one bucket has more.
SORT_BYTES = 1 << 19


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row of a block: row, anchor's hash, its position, and the first and last window start it stands for."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none.astype(np.uint64), none, none, none
    grams = C.Rolling(data).spans(K)
    least = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step < WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    pos = (least & LOW).astype(np.int64)  # for each window start of the block, its anchor
    valid = np.zeros(len(pos), bool)
    lens = np.diff(at)
    for a, size in zip(at[:-1][lens >= LENGTH].tolist(), lens[lens >= LENGTH].tolist(), strict=True):
        valid[a : a + size - LENGTH + 1] = True
    start = np.flatnonzero(valid)
    pos = pos[start]
    new = np.ones(len(start), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (start[1:] != start[:-1] + 1)
    edge = np.flatnonzero(new)
    lo, hi = start[edge], start[np.append(edge[1:], len(start)) - 1]
    q = pos[edge]
    row = np.searchsorted(at, q, "right") - 1
    return row, grams[q], q, lo, hi


def dealt(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each anchor. An anchor is a least hash, so its own high bits would crowd at 0."""
    return ((C.mix(h) >> C.U64(32)) * C.U64(buckets) >> C.U64(32)).astype(np.int32)


def pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows as (bytes, starts, row of each piece, where the piece begins in its text)."""
    for lo, hi, part, starts in C.blocks(data, at):
        if len(part) <= PIECE:
            yield part, starts, np.arange(lo, hi), np.zeros(hi - lo, np.int64)
        else:  # one long text: each window in exactly one piece
            for a in range(0, len(part) - LENGTH + 1, PIECE - LENGTH + 1):
                piece = part[a : a + PIECE]
                yield piece, np.array([0, len(piece)]), np.array([lo]), np.array([a])


ASK = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("hash", pa.binary()), ("cls", pa.binary()), ("q", pa.binary()), ("back", pa.binary()), ("more", pa.binary()), ("count", pa.binary())])


def _ask(buckets: int):
    """Texts to anchors by bucket. Those that occur twice among the held ones go as one; all their places go along as found."""

    def packed(b, kind, h, cls, q, back, more, count):
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        cols = [x[order] for x in (h, cls, q, back, more, count)]
        rows = [[x[cut[i] : cut[i + 1]].tobytes() for i in some.tolist()] for x in cols]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), kind, np.int8)), *(pa.array(x, pa.binary()) for x in rows)], schema=ASK)

    def flush(held):
        h, cls, q, back, more = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h, cls, q, back, more = h[order], cls[order], q[order], back[order], more[order]
        edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(edge, len(h)))
        yield packed(dealt(h[edge], buckets), 0, h[edge], cls[edge], q[edge], back[edge], more[edge], count.astype(np.int32))
        twice = np.repeat(count > 1, count)
        if twice.any():
            h, cls, q, back, more = (x[twice] for x in (h, cls, q, back, more))
            b = (C.mix(q.astype(np.uint64) // C.U64(1 << 16) + cls.view(np.uint64)) >> C.U64(40)) % C.U64(buckets)  # anywhere, evenly
            yield packed(b.astype(np.int32), 1, h, cls, q, back, more, np.repeat(count, count)[twice].astype(np.int32) * 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, at = C.text_bytes(batch.column(1))
            for part, starts, rows, base in pieces(data, at):
                row, h, q, lo, hi = anchors(part, starts)
                if not len(row):
                    continue
                fresh = np.array([int(keys[r]) not in seen or o > 0 for r, o in zip(rows, base, strict=True)])
                doubled = np.unique(keys[rows], return_index=True)[1]
                first = np.zeros(len(rows), bool)
                first[doubled] = True
                seen.update(keys[rows].tolist())
                live = (fresh & first)[row]
                row, h, q, lo, hi = row[live], h[live], q[live], lo[live], hi[live]
                here = base[row] - starts[row]
                held.append((h, keys[rows[row]], (q + here).astype(np.int32), (q - lo).astype(np.uint8), (hi - lo).astype(np.uint8)))
                n += len(h)
                if n >= FLUSH_ANCHORS:
                    yield from flush(held)
                    held, n = [], 0
                    seen.clear()
        if n:
            yield from flush(held)

    return run


HOT = pa.schema([("hash", pa.int64()), ("cls", pa.int64()), ("q", pa.int32()), ("back", pa.int16()), ("more", pa.int16()), ("wide", pa.bool_())])


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of buckets, in their order, to the places of anchors that occur more than once; wide marks one row of each wide anchor."""
    kinds = [("hash", np.uint64), ("cls", np.int64), ("q", np.int32), ("back", np.uint8), ("more", np.uint8), ("count", np.int32)]

    def out(h, cls, q, back, more, wide):
        for a in range(0, len(h), 1 << 16):
            s = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(cls[s]), pa.array(q[s]), pa.array(back[s].astype(np.int16)), pa.array(more[s].astype(np.int16)), pa.array(wide[s])], schema=HOT)

    def repeated(held):
        h, cls, q, back, more, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h = h[order]
        near = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        near[1:] |= same
        near[:-1] |= same
        near |= count[order] > 1
        order, h = order[near], h[near]
        cls, q, back, more, count = cls[order], q[order], back[order], more[order], count[order]
        order = np.lexsort((q, cls, h))
        h, cls, q, back, more, count = (x[order] for x in (h, cls, q, back, more, count))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]) | (q[1:] != q[:-1])
        place = np.flatnonzero(new)  # copies of a text give the same place again
        count = np.maximum.reduceat(count, place) if len(place) else count
        h, cls, q, back, more = (x[place] for x in (h, cls, q, back, more))
        edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        total = np.add.reduceat(count.astype(np.int64), edge) if len(edge) else edge
        size = np.diff(np.append(edge, len(h)))
        live = np.repeat(total > 1, size)
        wide = np.zeros(len(h), bool)
        wide[edge[total > WIDE]] = True
        yield from out(h[live], cls[live], q[live], back[live], more[live], wide[live])

    held: list[list[np.ndarray]] = []
    n, bucket = 0, None
    for batch in batches:
        cols = [batch.column(x).to_pylist() for x, _ in kinds]
        for i, (at, k) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
            row = [np.frombuffer(c[i], t) for c, (_, t) in zip(cols, kinds, strict=True)]
            if k:
                yield from out(*row[:5], np.zeros(len(row[0]), bool))
                continue
            if at != bucket and n >= FLUSH_ANCHORS:  # whole buckets, which come in their order
                yield from repeated(held)
                held, n = [], 0
            bucket, n = at, n + len(row[0])
            held.append(row)
    if held:
        yield from repeated(held)


def suffix_array(s: np.ndarray, need: int, unit: int = 1) -> np.ndarray:
    """Positions of s in the order of their suffixes' first `need` characters (of `unit` bytes less one level each).

    The difference cover {1, 2} modulo 3: sort the triples at sampled positions, name them, recurse on the names
    unless they are distinct or already cover what is needed, then merge in the suffixes at the other positions.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:].tolist())), np.int64)
    t = np.zeros(n + 4, np.int64)
    t[:n] = s
    top = int(t.max()) + 1
    p1, p2 = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    p12 = np.concatenate((p1, p2))
    if top < 1 << 21:
        key = (t[p12] * top + t[p12 + 1]) * top + t[p12 + 2]
        order = np.argsort(key)
        sorted_key = key[order]
        differ = sorted_key[1:] != sorted_key[:-1]
    else:
        order = np.lexsort((t[p12 + 2], t[p12 + 1], t[p12]))
        x = p12[order]
        differ = (t[x[1:]] != t[x[:-1]]) | (t[x[1:] + 1] != t[x[:-1] + 1]) | (t[x[1:] + 2] != t[x[:-1] + 2])
    names = np.empty(len(p12), np.int64)
    names[order] = np.concatenate(([1], 1 + np.cumsum(differ)))
    key = sorted_key = x = None  # not held while the names are sorted
    if not differ.all() and unit * 3 < need:
        order = suffix_array(names, need, unit * 3)
    names = differ = None
    rank = np.zeros(n + 4, np.int64)
    rank[p12[order]] = np.arange(1, len(p12) + 1)
    sample = p12[order]
    sample = sample[sample < n]
    p0 = np.arange(0, n, 3)
    m = len(p12) + 2
    p0 = p0[np.argsort(t[p0] * m + rank[p0 + 1], kind="stable")]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(t[one] * m + rank[one + 1], t[p0] * m + rank[p0 + 1])
    if top < 1 << 19:
        before += np.searchsorted((t[two] * top + t[two + 1]) * m + rank[two + 2], (t[p0] * top + t[p0 + 1]) * m + rank[p0 + 2])
    else:  # pairs of characters by their names in order
        pair = np.unique(np.concatenate((t[two] * top + t[two + 1], t[p0] * top + t[p0 + 1])), return_inverse=True)[1]
        before += np.searchsorted(pair[: len(two)] * m + rank[two + 2], pair[len(two) :] * m + rank[p0 + 2])
    # Suffixes that agree in all that is needed stand in any order; the running maximum keeps the places distinct.
    place = np.arange(len(p0)) + np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    other = np.ones(n, bool)
    other[place] = False
    out[place] = p0
    out[np.flatnonzero(other)] = sample
    return out


def repeats(text: np.ndarray, windows: np.ndarray, need: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The window starts in suffix order, and for each the number of its group of windows with equal bytes.

    text: bytes plus one, with a 0 after each context, so that no window holds a 0.
    """
    sa = suffix_array(text, need)
    sa = sa[windows[sa]]
    if not len(sa):
        return sa, sa
    eight = np.zeros(len(text), np.uint64)  # eight characters from each position on; equal bytes give equal numbers
    wide = np.concatenate((text, np.zeros(8, text.dtype)))
    for j in range(8):
        eight = (eight << C.U64(8)) | ((wide[j : j + len(text)] - 1) & 255).astype(np.uint64)
    same = np.ones(len(sa) - 1, bool)
    at = np.arange(len(sa) - 1)
    for j in [*range(0, need - 7, 8), *([need - 8] if need % 8 else [])]:
        at = at[eight[sa[at] + j] == eight[sa[at + 1] + j]]
    same[:] = False
    same[at] = True
    return sa, np.concatenate(([0], np.cumsum(~same)))


CONTEXT = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), *((x, pa.binary()) for x in ("hash", "key", "id", "cls", "lo", "more", "text"))])
CONTEXT_SQL = "bucket int, kind byte, hash binary, key binary, id binary, cls binary, lo binary, more binary, text binary"
#: What a context is called: BLAKE2 of its bytes, so that equal keys mean equal bytes.
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
SPAN = pa.schema([("cls", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
_NULL_ID = -(1 << 63)


def _spans(cls, start, end) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(cls), 1 << 16):
        s = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(cls[s]), pa.array(start[s].astype(np.int32)), pa.array(end[s].astype(np.int32))], schema=SPAN)


def _collapsed(key: np.ndarray, ident: np.ndarray, cls: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts the first of each set of equals, and those that repeat another one."""
    order = np.lexsort((lo, cls, ident, key["b"], key["a"]))
    k = key[order]
    new = np.ones(len(order), bool)
    new[1:] = (k["a"][1:] != k["a"][:-1]) | (k["b"][1:] != k["b"][:-1])
    keep = order[new]
    head = keep[np.cumsum(new) - 1]  # of each in order, the first of its equals
    return keep, order[(cls[order] != cls[head]) | (lo[order] != lo[head])]


def _contexts(buckets: int):
    """Rows (cls, doc_id, text, places of hot anchors) to contexts by bucket; of equal ones held the first, of the others the spans."""

    def row_of(bucket: int, kind: int, cols: list[np.ndarray], which: np.ndarray, text: bytes) -> list:
        return [bucket, kind, *(x[which].tobytes() for x in cols), text]

    def flush(held):
        cols = [np.concatenate([x[i] for x in held]) for i in range(6)]
        text = [y for x in held for y in x[6]]
        h, key, ident, cls, lo, _ = cols
        keep, rest = _collapsed(key, ident, cls, lo)
        rows = []
        if len(rest):
            rows.append(row_of(int(C.mix(cls[rest[:1]].view(np.uint64))[0] % C.U64(buckets)), 1, cols, rest, b""))
        b = dealt(h[keep], buckets)
        by = np.argsort(b, kind="stable")
        keep, b = keep[by], b[by]
        cut = np.searchsorted(b, np.arange(buckets + 1))
        for i in np.flatnonzero(np.diff(cut)).tolist():
            which = keep[cut[i] : cut[i + 1]]
            rows.append(row_of(i, 0, cols, which, b"".join(text[j] for j in which.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CONTEXT, strict=True)], schema=CONTEXT)

    def of_text(raw: np.ndarray, h, q, back, more, wide) -> tuple:
        """Anchor, key, first window, further windows and bytes of each context of a text."""
        lo = q.astype(np.int64) - back
        more = more.astype(np.int64)
        h = h.view(np.uint64)
        there = lo + more + LENGTH <= len(raw)  # else a place of another text whose hash is the same
        lo, more, h, wide = lo[there], more[there], h[there], wide[there]
        if wide.any():  # each window of a wide anchor is a context of its own
            reach = more[wide] + 1
            each = np.repeat(lo[wide] - np.concatenate(([0], np.cumsum(reach)[:-1])), reach) + np.arange(int(reach.sum()))
            lo, more = np.concatenate((lo[~wide], each)), np.concatenate((more[~wide], np.zeros(len(each), np.int64)))
        body = raw.tobytes()
        text = [body[a:b] for a, b in zip(lo.tolist(), (lo + more + LENGTH).tolist(), strict=True)]
        key = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in text), KEY)
        if wide.any():  # and is dealt by its bytes
            h = np.concatenate((h[~wide], key["a"][len(lo) - len(each) :]))
        return h, key, lo, more, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            keys = batch.column("cls").to_numpy()
            ids = batch.column("doc_id").to_pylist()
            data, at = C.text_bytes(batch.column("text"))
            places = batch.column("places")
            flat, edge = places.flatten(), places.offsets.to_numpy()
            edge = edge - edge[0]
            field = [flat.field(x).to_numpy(zero_copy_only=False) for x in ("hash", "q", "back", "more", "wide")]
            for i in range(batch.num_rows):
                for a in range(edge[i], edge[i + 1], 1 << 15):  # a long text has many
                    s = slice(a, min(a + (1 << 15), edge[i + 1]))
                    h, key, lo, more, text = of_text(data[at[i] : at[i + 1]], *(x[s] for x in field))
                    held.append((h, key, np.full(len(lo), _NULL_ID if ids[i] is None else ids[i], np.int64), np.full(len(lo), keys[i], np.int64), lo.astype(np.int32), more.astype(np.int32), text))
                    n += sum(map(len, text))
                    if n >= FLUSH_BYTES:
                        yield from flush(held)
                        held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _sorted(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The contexts of some buckets: collapses equal ones, sorts the suffixes of the rest and yields the spans of repeats.

    Windows are equal only under the same anchor, so an anchor whose contexts are all equal needs no sort.
    """
    h, key, ident, cls, lo, more = (np.concatenate([p[i] for p in parts]) for i in range(6))
    size = more.astype(np.int64) + LENGTH
    text = np.frombuffer(b"".join(p[6] for p in parts), np.uint8)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    keep, rest = _collapsed(key, ident, cls, lo)
    yield from _spans(cls[rest], lo[rest].astype(np.int64), lo[rest] + size[rest])
    _, group, n = np.unique(h[keep], return_inverse=True, return_counts=True)
    keep = keep[n[group] > 1]
    keep = keep[np.lexsort((lo[keep], cls[keep], ident[keep]))]  # contexts by their places: the first has number 0
    if not len(keep):
        return
    n = size[keep]
    start = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
    s = np.zeros(int((n + 1).sum()), np.int16)
    for a, b, size in zip(start.tolist(), begin[keep].tolist(), n.tolist(), strict=True):
        s[a : a + size] = text[b : b + size]
        s[a : a + size] += 1
    owner = np.repeat(np.arange(len(keep), dtype=np.int32), n + 1)
    windows = np.arange(len(s)) - start[owner] <= more[keep][owner]
    sa, group = repeats(s, windows)
    first = np.minimum.reduceat(owner[sa], np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))
    later = np.sort(sa[owner[sa] != first[group]])
    if len(later):
        new = np.ones(len(later), bool)
        new[1:] = (later[1:] != later[:-1] + 1) | (owner[later[1:]] != owner[later[:-1]])
        edge = np.flatnonzero(new)
        a, b = later[edge], later[np.append(edge[1:], len(later)) - 1]
        o = owner[a]
        at = lo[keep][o].astype(np.int64) - start[o]
        yield from _spans(cls[keep][o], a + at, b + at + LENGTH)


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of buckets, in their order, to spans of repeats; some whole buckets are held at a time."""
    kinds = [("hash", np.uint64), ("key", KEY), ("id", np.int64), ("cls", np.int64), ("lo", np.int32), ("more", np.int32)]
    held, n, bucket = [], 0, None
    for batch in batches:
        cols = [batch.column(x).to_pylist() for x, _ in kinds]
        for i, (b, kind, text) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "text")), strict=True)):
            row = tuple(np.frombuffer(c[i], t) for c, (_, t) in zip(cols, kinds, strict=True))
            if kind:
                lo = row[4].astype(np.int64)
                yield from _spans(row[3], lo, lo + row[5] + LENGTH)
                continue
            if b != bucket and n >= SORT_BYTES:
                yield from _sorted(held)
                held, n = [], 0
            bucket, n = b, n + len(text)
            held.append((*row, text))
    if held:
        yield from _sorted(held)


def joined_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    edge = np.flatnonzero(new)
    return start[edge], end[np.append(edge[1:], len(start)) - 1]


def _cut(whole_chars: bool):
    """Rows (cls, text, spans) to the kept bytes; with whole_chars a span leaves out characters it covers in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = C.text_bytes(batch.column("text"))
            spans = batch.column("spans")
            flat, edge = spans.flatten(), spans.offsets.to_numpy()
            edge = edge - edge[0]
            start, end = flat.field("start").to_numpy().astype(np.int64), flat.field("end").to_numpy().astype(np.int64)
            removed, runs, kept = [], [], []
            for i in range(batch.num_rows):
                raw = data[at[i] : at[i + 1]]
                a, b = joined_spans(start[edge[i] : edge[i + 1]], end[edge[i] : edge[i + 1]])
                gone = np.zeros(len(raw) + 1, np.int8)
                gone[a] += 1
                gone[b] -= 1
                gone = np.cumsum(gone[:-1], dtype=np.int8) > 0
                if whole_chars and len(raw):
                    head = np.flatnonzero((raw & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.append(head, len(raw))))
                removed.append(int(gone.sum()))
                runs.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                kept.append(raw[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["cls", "n_removed", "n_spans", "kept"])

    return run


def text_key(text) -> "F.Column":
    """What names a class of equal texts: its SHA-256."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def half_key(text) -> "F.Column":
    """What places of anchors go by instead of a class's long key; under 2**62. Texts that it makes alike are told apart in `repeated`."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))


def repeated(docs: DataFrame, *, whole_chars: bool = False) -> DataFrame:
    """Each class of equal texts: key, first_id, and where it is cut in part n_removed, n_spans and the kept bytes, else nulls.

    key is the SHA-256 of the text. Copies beyond the first document of a class are for the caller to remove. The table
    is written, so that the join of all documents with it has a shuffle of its own on either side, which Spark can split
    where a class has very many copies.
    """
    spark = C.ready(docs.sparkSession)
    scratch, p = C.Scratch(spark, "suffix-dedup"), C.partitions(spark)
    buckets = 16 * p
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if C.unique(docs, "doc_id"):
        docs = docs.withColumn("row", F.col("doc_id"))
    else:
        docs = scratch.table(docs.withColumn("row", F.monotonically_increasing_id()))
    text = F.col("text")
    keyed = docs.select("row", "doc_id", text_key(text).alias("key"), half_key(text).alias("half"))
    # A class is called by the row of its first document; `half` is what candidates go by until the texts meet again.
    classes = scratch.table(keyed.groupBy("key").agg(F.expr("min_by(struct(row, doc_id), struct(doc_id is not null, doc_id, row))").alias("first"), F.first("half").alias("half")).select("key", F.col("first.row").alias("cls"), F.col("first.doc_id").alias("first_id"), "half"))
    asked = docs.where(F.octet_length("text") >= LENGTH).select(half_key(text).alias("half"), "text")
    alike = classes.groupBy("half").count().where("count > 1").select("half")
    if not alike.isEmpty():  # different texts of one hash: each gets a number of its own, from 2**62 on
        own = scratch.table(classes.join(alike, "half").select("key", F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62)).alias("own")))
        classes = scratch.table(classes.join(own, "key", "left").withColumn("half", F.coalesce("own", "half")).drop("own"))
        asked = docs.where(F.octet_length("text") >= LENGTH).select(text_key(text).alias("key"), half_key(text).alias("half"), "text").join(C.bounded(spark, own, 100_000), "key", "left")
        asked = asked.select(F.coalesce("own", "half").alias("half"), "text")
    asked = asked.mapInArrow(C.lean(_ask(buckets)), "bucket int, kind byte, hash binary, cls binary, q binary, back binary, more binary, count binary")
    hot = scratch.table(asked.repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(C.lean(_hot), "hash long, cls long, q int, back short, more short, wide boolean"))
    wide = hot.where("wide").select("hash", F.lit(True).alias("is_wide"))
    places = hot.drop("wide").join(C.bounded(spark, wide, 100_000), "hash", "left").withColumn("wide", F.coalesce("is_wide", F.lit(False)))
    places = places.withColumnRenamed("cls", "half").groupBy("half").agg(F.collect_set(F.struct("hash", "q", "back", "more", "wide")).alias("places"))
    texts = docs.join(classes.join(places, "half").select("cls", "places"), F.col("row") == F.col("cls")).select("cls", "doc_id", "text", "places")
    contexts = texts.mapInArrow(C.lean(_contexts(4 * buckets)), CONTEXT_SQL)
    spans = scratch.table(contexts.repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(C.lean(_sort), "cls long, start int, end int"))
    scratch.drop(hot)
    cuts = spans.groupBy("cls").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = docs.join(cuts, F.col("row") == F.col("cls")).select("cls", "text", "spans").mapInArrow(C.lean(_cut(whole_chars)), "cls long, n_removed long, n_spans long, kept binary")
    found = scratch.table(classes.join(cut, "cls", "left").select("key", "first_id", "n_removed", "n_spans", "kept"))
    scratch.drop(classes, spans)
    return found


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents."""
    return digested(C.documents(spark, sf_dir, "doc_id", "text"))


def digested(docs: DataFrame) -> DataFrame:
    """Per document n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes."""
    docs = docs.select("doc_id", "text")
    classes = repeated(docs).select("key", "first_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text_key(text).alias("key"))
    rows = rows.join(classes, "key")
    copy = ~F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
    )


def cut_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document's text without its repeats, in whole characters; n_chars follows. All documents stay."""
    key, named, first, kept = (C.fresh(docs, n) for n in ("_key", "_class", "_first", "_kept"))
    classes = repeated(docs, whole_chars=True).select(F.col("key").alias(named), F.col("first_id").alias(first), F.col("kept").cast("string").alias(kept))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn(key, text_key(text)).join(classes, F.col(key) == F.col(named))
    copy = ~F.col("doc_id").eqNullSafe(F.col(first)) & (F.octet_length(text) >= LENGTH)
    new = F.when(copy, F.lit("")).otherwise(F.coalesce(kept, "text"))
    return rows.select(*(new.alias(c) if c == "text" else F.length(new).cast("long").alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, C.own(docs), strict=True)))
