"""Media columns of MPEG audio: bytes stored in frames, and a parser for MPEG audio streams.

`store` puts a payload into MPEG-2 Layer III frames of 576 samples: 576 payload bytes lead each frame's main data, the
side information is zero, each frame has a checksum. Before them come an ID3v2 tag, which holds the payload's lengths,
and a frame with a variable-bitrate table (`Xing`: frames, bytes, 100 seek points); after them an ID3v1 tag.

`parse` reads streams of MPEG 1, 2 and 2.5, Layers I to III, but none of free format (bitrate index 0), which gives no
frames. It skips tags (ID3v2 in front, ID3v1 and APEv2 behind),
and finds the first header that another fitting header follows; after damage it looks for such a pair again and counts the
bytes it skipped. It reads Xing, Info and VBRI tables, verifies the checksums of Layers I and III (Layer II's cover bits
that depend on its allocation tables; they are counted as not checked), and gives the exact duration as samples over the
sample rate with the byte offset of each frame. Runs of frames with equal headers are read at once.

Null and empty bytes are no stream: zero frames, all counts zero. A stream with no two fitting headers in a row is read
only if its single frame ends at its end. Null and empty texts are a payload of one unit of bytes 255. Repeated rows have
equal values; long texts are stored and read whole, one at a time. An empty table gives an empty one. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

UNIT = 576
# Fixed values of the format: kbit/s by (version 1?, layer) and sample rates by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {0: (11025, 12000, 8000), 2: (22050, 24000, 16000), 3: (44100, 48000, 32000)}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    crc: bool
    bitrate: int
    rate: int
    channels: int
    size: int
    samples: int
    side: int  # bytes of side information (Layer III) or allocation (Layer I) that the checksum covers
    main: int  # where the main data begins


@lru_cache(4096)
def header(word: int) -> Header | None:
    """A frame's header from its 32 bits; None if no frame has them."""
    if word >> 21 != 0x7FF:
        return None
    version, layer, bits, at = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or at == 3 or word & 3 == 2:
        return None
    first = version == 3
    bitrate, rate, pad = BITRATES[first, layer][bits], RATES[version][at], word >> 9 & 1
    mode, extension = word >> 6 & 3, word >> 4 & 3
    channels = 1 if mode == 3 else 2
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * bitrate * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate * 1000 // rate + pad
    if layer == 3:
        side = (17 if channels == 1 else 32) if first else (9 if channels == 1 else 17)
    elif layer == 1:
        bound = 4 * (extension + 1) if mode == 1 else 32
        side = (4 * (bound * channels + (32 - bound))) // 8 if channels == 2 else 16
    else:
        side = 0
    crc = not word >> 16 & 1
    return Header(version, layer, crc, bitrate, rate, channels, size, samples, side, 4 + 2 * crc + (side if layer == 3 else 0))


def alike(a: Header, b: Header | None) -> bool:
    """Whether two headers can be of one stream."""
    return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


@lru_cache(1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, t << 1 ^ 0x8005, t << 1) & 0xFFFF
    return t


def crc16(rows: np.ndarray) -> np.ndarray:
    """The format's checksum of each row of bytes."""
    crc, table = np.full(len(rows), 0xFFFF, np.uint32), _crc_table()
    for j in range(rows.shape[1]):
        crc = crc << 8 & 0xFFFF ^ table[(crc >> 8 ^ rows[:, j]) & 0xFF]
    return crc


# --- writing --------------------------------------------------------------------------------------------------------

#: MPEG-2, Layer III, checksum, 144 kbit/s, 16 kHz, mono: 648 bytes.
WORD = 0xFFF00000 | 2 << 19 | 1 << 17 | 0 << 16 | 13 << 12 | 2 << 10 | 3 << 6


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def id3v2(fields: dict[str, str]) -> bytes:
    """An ID3v2.4 tag with user-defined text frames."""
    body = b""
    for k, v in fields.items():
        text = b"\x03" + k.encode() + b"\0" + v.encode()
        body += b"TXXX" + synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + synchsafe(len(body)) + body


def payload_of(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def store(payload: bytes, n_bytes: int) -> bytes:
    """A stream that holds the payload, a positive multiple of UNIT bytes, of which n_bytes count."""
    h = header(WORD)
    n = len(payload) // UNIT
    head = struct.pack(">I", WORD)
    frames = np.zeros((n, h.size), np.uint8)
    frames[:, :4] = np.frombuffer(head, np.uint8)
    crc = int(crc16(np.concatenate((frames[:1, 2:4], frames[:1, 6 : 6 + h.side]), 1))[0])
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 255
    frames[:, h.main : h.main + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    first = bytearray(h.size)
    first[: h.main] = frames[0, : h.main].tobytes()
    size = (n + 1) * h.size
    points = bytes(min(255, 256 * (1 + i * n // 100) // (n + 1)) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, size) + points
    first[h.main : h.main + len(table)] = table
    tag = id3v2({"payload_bytes": str(len(payload)), "n_bytes": str(n_bytes)})
    return tag + bytes(first) + frames.tobytes() + (b"TAG" + b"payload".ljust(124, b"\0") + b"\xff")


# --- reading --------------------------------------------------------------------------------------------------------


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    kind: str = ""
    bitrate_min: int = 0
    bitrate_max: int = 0
    rate: int = 0
    channels: int = 0
    frames: int = 0
    samples: int = 0
    crc_checked: int = 0
    crc_bad: int = 0
    skipped: int = 0
    resyncs: int = 0
    vbr: str = ""
    vbr_frames: int = 0
    vbr_bytes: int = 0
    toc: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    mains: list[int] = field(default_factory=list)


def tags_front(data: bytes) -> tuple[int, dict[str, str]]:
    """The length of ID3v2 tags in front, and their user-defined texts and text frames."""
    at, found = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6 : at + 10]) < 128:
        size = sum(b << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        p, end, safe = at + 10, min(len(data), at + 10 + size), data[at + 3] >= 4
        while p + 10 <= end and data[p : p + 4].isalnum():
            raw = data[p + 4 : p + 8]
            n = sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if safe else int.from_bytes(raw, "big")
            body = data[p + 10 : min(end, p + 10 + n)]
            if body[:1] in (b"\0", b"\3"):
                text = body[1:].decode("utf-8" if body[0] == 3 else "latin-1", "replace")
                name, _, value = text.partition("\0") if data[p : p + 4] == b"TXXX" else (data[p : p + 4].decode("latin-1"), "", text)
                found[name] = value.rstrip("\0")
            p += 10 + n
        at += 10 + size + (10 if data[at + 5] & 0x10 else 0)
    return min(at, len(data)), found


def tags_back(data: bytes, found: dict[str, str]) -> int:
    """Where tags behind the frames begin; adds the ID3v1 title and notes an APE tag."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        found["id3v1_title"] = data[end - 125 : end - 95].split(b"\0")[0].decode("latin-1").strip()
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I", data[end - 20 : end - 16])[0], struct.unpack("<I", data[end - 12 : end - 8])[0]
        size += 32 if flags >> 31 else 0
        if size <= end:
            found["ape"] = str(size)
            end -= size
    return end


def _word(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "big")


def synced(data: bytes, at: int, end: int, of: Header | None) -> tuple[int, Header | None]:
    """The next place from `at` whose header fits the stream and is followed by another or by the end."""
    while at + 4 <= end:
        at = data.find(b"\xff", at, end - 3)
        if at < 0:
            break
        h = header(_word(data, at))
        if h is not None and (of is None or alike(of, h)) and at + h.size <= end:
            after = at + h.size
            if after == end or after + 4 <= end and alike(h, header(_word(data, after))):
                return at, h
        at += 1
    return end, None


def table_of(data: bytes, at: int, h: Header, s: Stream) -> bool:
    """Reads a variable-bitrate table in a frame; whether it has one."""
    p = at + h.main if h.layer == 3 else at + 4 + 2 * h.crc
    name = data[p : p + 4]
    end = at + h.size
    if name in (b"Xing", b"Info") and p + 8 <= end:
        flags = _word(data, p + 4)
        s.vbr, p = name.decode(), p + 8
        if flags & 1:
            s.vbr_frames, p = _word(data, p), p + 4
        if flags & 2:
            s.vbr_bytes, p = _word(data, p), p + 4
        if flags & 4:
            s.toc = list(data[p : min(end, p + 100)])
        return True
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= end:
        s.vbr, s.vbr_bytes, s.vbr_frames = "VBRI", _word(data, p + 10), _word(data, p + 14)
        n, scale, width, per = struct.unpack(">HHHH", data[p + 18 : p + 26])
        s.toc = [int.from_bytes(data[p + 26 + i * width : p + 26 + (i + 1) * width], "big") * scale for i in range(n) if p + 26 + (i + 1) * width <= end]
        return True
    return False


def parse(data: bytes) -> Stream:
    """The frames, tags and tables of a stream."""
    s = Stream()
    at, s.tags = tags_front(data)
    end = tags_back(data, s.tags)
    first: Header | None = None
    raw = np.frombuffer(data, np.uint8)
    checks: dict[int, list[np.ndarray]] = {}
    run = 1
    while at + 4 <= end:
        h = header(_word(data, at))
        fits = first is not None and alike(first, h) and at + h.size <= end
        if fits and (h.crc, h.channels) != (first.crc, first.channels):  # a change that chance bytes make too: the next header decides
            fits = at + h.size == end or alike(first, header(_word(data, at + h.size)))
        if not fits:
            to, h = synced(data, at, end, first)
            s.skipped += to - at
            s.resyncs += first is not None and h is not None
            at = to
            if h is None:
                break
        if first is None:
            first = h
            s.kind, s.rate, s.channels, s.bitrate_min = f"mpeg{VERSIONS[h.version]} layer{h.layer}", h.rate, h.channels, h.bitrate
            if table_of(data, at, h, s):
                if h.crc and h.layer != 2:
                    checks.setdefault(h.side, []).append(np.array([at]))
                at += h.size
                continue
        # A run of frames with this header, as far as it reaches and no more than twice the last one.
        most = min((end - at) // h.size, 2 * run + 6)
        same = (raw[at : at + most * h.size].reshape(most, h.size)[:, :4] == raw[at : at + 4]).all(1)
        run = int(most if same.all() else np.argmin(same))
        places = at + h.size * np.arange(run)
        s.offsets += places.tolist()
        s.mains += (places + h.main).tolist()
        s.samples += run * h.samples
        s.bitrate_min, s.bitrate_max = min(s.bitrate_min, h.bitrate), max(s.bitrate_max, h.bitrate)
        if h.crc and h.layer != 2:
            checks.setdefault(h.side, []).append(places)
        at += run * h.size
    else:
        s.skipped += max(0, end - at)
    s.frames = len(s.offsets)
    for side, places in checks.items():
        p = np.concatenate(places)
        p = p[p + 6 + side <= len(raw)]
        cover = np.concatenate((np.array([2, 3]), np.arange(6, 6 + side)))
        for a in range(0, len(p), 1 << 14):
            q = p[a : a + (1 << 14)]
            stored = raw[q + 4].astype(np.uint32) << 8 | raw[q + 5]
            s.crc_checked += len(q)
            s.crc_bad += int((crc16(raw[q[:, None] + cover[None, :]]) != stored).sum())
    return s


def payload(data: bytes, s: Stream) -> bytes:
    """The bytes that `store` put into a stream's frames."""
    raw = np.frombuffer(data, np.uint8)
    return raw[np.array(s.mains)[:, None] + np.arange(UNIT)[None, :]].tobytes() if s.mains else b""


def feature(s: Stream) -> str:
    """A stream's features in one line."""
    return f"{s.kind} {s.rate}Hz {s.channels}ch {s.bitrate_min}-{s.bitrate_max}kbps frames={s.frames} duration={s.samples}/{s.rate}s crc={s.crc_checked - s.crc_bad}/{s.crc_checked} skipped={s.skipped} {s.vbr or 'no'}-table={s.vbr_frames}/{s.vbr_bytes}/{len(s.toc)} last_frame_at={s.offsets[-1] if s.offsets else -1}"


# --- columns --------------------------------------------------------------------------------------------------------


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = C.text_bytes(batch.column(1))
        for lo, hi, part, starts in C.blocks(data, at, 4 << 20):
            raw = part.tobytes()
            texts = [raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            media = [store(payload_of(t), len(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


META = "kind string, sample_rate int, channels int, frames long, samples long, duration_s double, crc_checked long, crc_bad long, skipped long, vbr string, toc array<int>, seek_offsets array<long>, feature string"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in META.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string()]
    for batch in batches:
        media = batch.column("media")
        data, at = C.text_bytes(media)
        for lo, hi, part, starts in C.blocks(data, at, 4 << 20):
            raw = part.tobytes()
            rows = [raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            found = [parse(x) for x in rows]
            sizes = [int(t) if (t := s.tags.get("n_bytes", "")).isdecimal() else None for s in found]
            cols = [[s.kind, s.rate, s.channels, s.frames, s.samples, s.samples / s.rate if s.rate else 0.0, s.crc_checked, s.crc_bad, s.skipped, s.vbr, s.toc, s.offsets, feature(s)] for s in found]
            meta = pa.StructArray.from_arrays([pa.array([c[i] for c in cols], k) for i, k in enumerate(kinds)], names)
            n = hi - lo
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(sizes, pa.int64()), media.slice(lo, n), pa.array([payload(x, s) for x, s in zip(rows, found, strict=True)], pa.binary()), meta], names=["doc_id", "n_bytes", "media", "payload", "meta"])


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each row's whole text as a stream."""
    C.ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(C.lean(_encode), "doc_id long, n_bytes long, media binary")


def decoded(media: DataFrame) -> DataFrame:
    """(doc_id, media) with n_bytes by the stream's own tag (null without one), the payload, and `meta`, what the stream says."""
    C.ready(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(C.lean(_decode), f"doc_id long, n_bytes long, media binary, payload binary, meta struct<{', '.join(x.replace(' ', ': ', 1) for x in META.split(', '))}>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents."""
    return digested(C.documents(spark, sf_dir, "doc_id", "text"))


def digested(docs: DataFrame) -> DataFrame:
    """Stores all documents as streams in the shared folder, reads them back and digests them; with durations and seek offsets."""
    stored = C.Scratch(C.ready(docs.sparkSession), "mpeg-audio").table(encoded(docs).select("doc_id", "media"))
    back = decoded(stored)
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substr(payload, length(payload) - 31, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("meta.feature").alias("feature"),
        F.col("meta.duration_s").alias("duration_s"),
        F.col("meta.samples").alias("samples"),
        F.col("meta.sample_rate").alias("sample_rate"),
        F.col("meta.seek_offsets").alias("seek_offsets"),
    )
