"""Packing of tokenised documents into sequences by first-fit decreasing.

Each document is tokenised, ended with END, and cut at whole multiples of the sequence length. Full pieces are
sequences of their own. The rests are dealt into randomised groups (by a hash of id, text and the row's place in the scan,
so the same files give the same groups after a loss, and rows that repeat are dealt too), and each group is packed on its own: the rests in decreasing order of length go each
to the first sequence with room, found by a descent in a tournament tree of the sequences' capacities. What the last,
emptier sequences of a group hold is then cut to fill the gaps of the fuller ones, and the very last sequence is cut
at powers of two, which need no padding, as long as it has more tokens to save than MIN_TAIL.

Null and empty texts have the END token alone. Repeated rows are packed each for itself; items of equal length keep the
order of their ids. With a vocabulary that lower-cases and parts text as the given one does, long texts are read in pieces that
end at white space, which no chunk crosses, so their ids are those of the whole text; with any other, texts are read whole,
each by itself. No documents give no pieces. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH, END = 4096, 2
VOCABULARY = "word_bpe_49k.json"
#: Documents, and bytes of text, in a group, about: what one task holds.
GROUP, GROUP_BYTES = 4_000, 8 << 20
#: Bytes of text whose chunks are looked up at once.
READ = 4 << 20
#: Distinct chunks of text whose ids a worker remembers.
CACHE = 700_000
#: A last sequence of no more tokens is padded rather than cut further.
MIN_TAIL = 64


class Tournament:
    """A tree over the capacities of up to n sequences; each inner node has the largest capacity below it."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """The first sequence with room for `need`, whose capacity is then less by that."""
        tree, i = self.tree, 1
        while i < self.size:
            i *= 2
            if tree[i] < need:
                i += 1
        tree[i] -= need
        found, i = i - self.size, i // 2
        while i:
            most = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == most:
                break
            tree[i] = most
            i //= 2
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each item. Equal lengths keep their order."""
    out = np.zeros(len(lengths), np.int64)
    tree = Tournament(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        out[i] = tree.place(int(lengths[i]))
    return out


def pack(lengths: np.ndarray, capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items no longer than the capacity."""
    bins = first_fit_decreasing(lengths, capacity)
    n = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
    by = np.argsort(bins, kind="stable")
    members = np.split(by, np.cumsum(np.bincount(bins, minlength=n))[:-1]) if n else []
    # The emptiest sequences are dissolved, as many as the others have room for.
    order = np.argsort(-fill, kind="stable").tolist()
    keep = -(-int(fill.sum()) // capacity)
    pieces, offset = [], [0] * n
    stay, go = order[:keep], order[keep:]
    for b in stay:
        for i in members[b].tolist():
            pieces.append((i, 0, int(lengths[i]), b, offset[b]))
            offset[b] += int(lengths[i])
    gaps = [b for b in stay if offset[b] < capacity]  # fullest first
    at = 0
    for b in go:
        for i in members[b].tolist():
            start, left = 0, int(lengths[i])
            while left:
                t = gaps[at]
                n_put = min(left, capacity - offset[t])
                pieces.append((i, start, n_put, t, offset[t]))
                offset[t] += n_put
                start, left = start + n_put, left - n_put
                at += offset[t] == capacity
    return pieces


def cut_tail(pieces: list[tuple[int, int, int, int, int]], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Cuts the emptiest sequence at powers of two, each a sequence of its own, until MIN_TAIL or fewer tokens remain."""
    used: dict[int, int] = {}
    for _, _, n, b, _ in pieces:
        used[b] = used.get(b, 0) + n
    out, fresh = [], max(used, default=0) + 1
    last = min(used, key=lambda b: (used[b], b), default=None)
    if last is None or used[last] == capacity:
        return pieces
    out = [p for p in pieces if p[3] != last]
    rest = sorted((p for p in pieces if p[3] == last), key=lambda p: p[4])
    left, target, room, at = used[last], last, 0, 0

    def open_next():
        size = left if left <= MIN_TAIL else 1 << (left.bit_length() - 1)
        return size

    room = open_next()
    for item, start, n, _, _ in rest:
        while n:
            put = min(n, room)
            out.append((item, start, put, target, at))
            start, n, at, room, left = start + put, n - put, at + put, room - put, left - put
            if not room and left:
                target, fresh, at, room = fresh, fresh + 1, 0, open_next()
    return out


_SIGN, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(b".,;:!?")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


#: The rules of vocabularies whose text may be lower-cased and parted before they see it.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def parts_text(rules: dict) -> bool:
    """Whether a vocabulary's rules are those that `Ids` may go ahead of."""
    before = rules.get("pre_tokenizer") or {}
    first = (before.get("pretokenizers") or [None])[0] if before.get("type") == "Sequence" else None
    return rules.get("normalizer") == _NORMALIZER and first == _SPLIT and not any(not t["special"] for t in rules.get("added_tokens") or [])


class Ids:
    """Ids of texts by the vocabulary, remembered for chunks between ASCII white space.

    The given vocabulary's own rules part all text at white space, and between a letter of A-Z and a sign such as a full
    stop, so a text's ids are those of its chunks in order; each distinct chunk, told apart by its bytes, goes through the
    tokenizer itself. Where the rules are others (`parted` is false), a chunk is a whole text as it is, and nothing is
    remembered. Ids are held in 16 bits where the vocabulary allows it, else in 32.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.parted = parts_text(json.load(f))
        self.kind, self.code = (np.uint16, "H") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else (np.uint32, "I")
        self.clear()

    def clear(self) -> None:
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks, each as bytes. Those not asked for in a long while are forgotten first."""
        if len(self.new) > CACHE // 2:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = [new.get(c) for c in chunks]
        lost = [i for i, x in enumerate(found) if x is None]
        if lost:
            unknown = []
            for i in lost:
                if (x := old.get(chunks[i])) is None:
                    unknown.append(i)
                else:
                    found[i] = new[chunks[i]] = x
            for a in range(0, len(unknown), 4096):
                some = unknown[a : a + 4096]
                for i, e in zip(some, self.tokenizer.encode_batch_fast([chunks[i].decode("utf-8", "replace") for i in some], add_special_tokens=False), strict=True):
                    found[i] = new[chunks[i]] = array(self.code, e.ids).tobytes()
        return found

    def block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and where each row's begin."""
        if not self.parted:
            raw = data.tobytes()
            rows = [self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return np.array([i for r in rows for i in r], self.kind), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        low = data if b"<|" in data.tobytes() else C.LOWER[data]  # special tokens are told by their case
        start, end, _ = C.words(low, at)
        sign = np.flatnonzero(_SIGN[low[1:]] & _LETTER[low[:-1]]) + 1
        mark = np.zeros((2, len(low) + 1), bool)
        mark[0, start] = mark[1, end] = True
        mark[:, sign] = True
        start, end = np.flatnonzero(mark[0]), np.flatnonzero(mark[1])
        first = np.searchsorted(start, at)
        chunk, book = C.numbered(low, start, end)
        found = self.of(book)
        ids = np.frombuffer(b"".join(found), self.kind)
        size = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        begin, size = (np.cumsum(size) - size)[chunk], size[chunk]
        total = np.concatenate(([0], np.cumsum(size)))
        where = np.repeat(begin - total[:-1], size) + np.arange(int(total[-1]))
        return ids[where], total[first]


@lru_cache(1)
def known(path: str) -> Ids:
    """What a worker knows of a vocabulary, kept between its tasks."""
    return Ids(path)


C.KEPT["ids"] = known.cache_clear


def vocabulary(path: str | None = None) -> str:
    """The place of the tokenizer's file: as given, or that of the installed public one."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _pieces(path: str | None, length: int, end: int):
    """Texts to pieces; ids go in as many bits as the vocabulary needs as far as here and in the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        know = known(vocabulary(path))
        for batch in batches:
            data, at = C.text_bytes(batch.column(1))
            held: list[np.ndarray] = []  # of a row that comes in pieces
            for lo, hi, part, starts, more in C.pieces(data, at, READ) if know.parted else ((*b, False) for b in C.blocks(data, at, READ)):
                ids, cut = know.block(part, starts)
                if more:
                    held.append(ids)
                    continue
                if held:
                    ids = np.concatenate((*held, ids))
                    cut, held = np.array([0, len(ids)]), []
                yield from cut_rows(batch, lo, hi, ids, cut)

    def cut_rows(batch, lo, hi, ids, cut):
        rows: list[list] = [[], [], [], [], []]
        held = 0
        for i in range(hi - lo):
            own = np.append(ids[cut[i] : cut[i + 1]], ids.dtype.type(end))
            for a in range(0, len(own), length):
                piece = own[a : a + length]
                for c, v in zip(rows, (lo + i, a, len(piece), len(own), piece.tobytes()), strict=True):
                    c.append(v)
                held += len(piece)
                if held >= 1 << 21:  # a long text gives many pieces
                    yield as_batch(batch, rows)
                    rows, held = [[], [], [], [], []], 0
        if rows[0]:
            yield as_batch(batch, rows)

    def as_batch(batch, rows):
        take = pa.array(rows[0], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], names=["doc_id", "grp", "no_id", "start", "length", "doc_tokens", "ids"])

    return run


def _place(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        group = int(pdf["grp"].iloc[0])
        size = pdf["length"].to_numpy()
        full = np.flatnonzero(size == length)
        rest = np.flatnonzero(size < length)
        found = cut_tail(pack(size[rest], length), length)
        item = np.concatenate((full, rest[np.array([p[0] for p in found], np.int64)])) if found else full
        part = np.array([p[1:] for p in found], np.int64).reshape(-1, 4)
        within = np.concatenate((np.zeros(len(full), np.int64), part[:, 0]))
        n = np.concatenate((np.full(len(full), length, np.int64), part[:, 1]))
        seq = np.concatenate((np.arange(len(full)), part[:, 2] + len(full)))
        offset = np.concatenate((np.zeros(len(full), np.int64), part[:, 3]))
        ids = pdf["ids"].to_numpy()
        kind = np.uint16 if len(ids[0]) == 2 * size[0] else np.uint32
        out = pdf.loc[item, ["doc_id", "no_id", "doc_tokens"]].reset_index(drop=True)
        out["start"] = pdf["start"].to_numpy()[item] + within
        out["length"] = n
        out["ids"] = [np.frombuffer(ids[i], kind, k, kind().itemsize * a).astype("<u4").tobytes() for i, a, k in zip(item.tolist(), within.tolist(), n.tolist(), strict=True)]
        out["sequence_id"] = (group << 32) + seq
        out["offset"] = offset
        return out[["doc_id", "no_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]]

    return run


SCHEMA = "doc_id long, no_id boolean, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, *, length: int = LENGTH, end: int = END, group: int = GROUP, vocabulary_path: str | None = None, seed: int = 17) -> DataFrame:
    """The pieces of all documents with their ids (unsigned 32-bit, little-endian) and places."""
    spark = C.ready(docs.sparkSession)
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, round(n / group), (size or 0) // GROUP_BYTES)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.col("text").cast("binary")), F.monotonically_increasing_id()), F.lit(groups)))
    docs = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text", "grp", F.col("doc_id").isNull().alias("no_id"))
    pieces = docs.mapInArrow(C.lean(_pieces(vocabulary_path, length, end), "ids"), "doc_id long, grp long, no_id boolean, start long, length long, doc_tokens long, ids binary")
    packed = pieces.groupBy("grp").applyInPandas(_place(length), SCHEMA)
    return packed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the pieces, with the CRC-32 of their ids in place of the ids."""
    found = pack_documents(C.documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline, last: the packed pieces with their ids."""
    return pack_documents(docs)
