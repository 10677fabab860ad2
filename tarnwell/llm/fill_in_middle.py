"""Fill-in-middle transformation of texts, cut by a sparse checkpoint index.

A text's units are runs of ASCII letters and single other characters. Counting them reads the text once, in blocks, and
records at every STEP units the unit's number and where it begins, in bytes and in code points. Each cut then binary-searches
the checkpoints and reads on from the last one before it, no further than the next, to the byte and the code point where the
cut is. So a text of any length costs two numbers for each STEP units, and a cut costs a short reading.

The cuts, the form and the order are drawn from the SHA-256 of `1:` and the id: h1 to h4 are its first four groups of eight
hex digits. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text is
left plain if it is empty, holds a marker, or h3 % 100 >= RATE; else it is written suffix first if h4 % 100 < SPM.

Null and empty texts have no units and stay plain, with empty output; a null id is drawn like an empty one. Repeated rows have
equal results, and rows that share an id share their draws. Long texts are read in blocks, one text at a time. An empty table
gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 1, 90, 20
#: Units from one checkpoint to the next.
STEP = 1024
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80


def begins(part: np.ndarray, inside: bool) -> np.ndarray:
    """Which bytes of a piece of text begin a unit; inside: the piece follows a letter."""
    letter = LETTER[part]
    out = LEAD[part]
    out[1:] &= ~(letter[1:] & letter[:-1])
    if inside and len(part):
        out[0] &= not letter[0]
    return out


class Checkpoints:
    """Of one text: the number of its units and code points, and where every STEP-th unit begins."""

    def __init__(self, text: np.ndarray, step: int = STEP, block: int = 0):
        self.text, self.units, self.points, inside = text, 0, 0, False
        marks = [np.zeros((3, 1), np.int64)]
        block = block or C.BLOCK
        for lo in range(0, len(text), block):
            part = text[lo : lo + block]
            place = np.flatnonzero(begins(part, inside))
            skip = -self.units % step or (step if self.units == 0 else 0)  # unit 0 has its checkpoint
            at = place[skip::step]
            if len(at):
                before = np.add.reduceat(LEAD[part].astype(np.int64), np.concatenate(([0], at)))[:-1] if at[0] else np.concatenate(([0], np.add.reduceat(LEAD[part].astype(np.int64), at)[:-1]))
                marks.append(np.stack((self.units + skip + step * np.arange(len(at)), lo + at, self.points + np.cumsum(before))))
            self.units += len(place)
            self.points += int(np.count_nonzero(LEAD[part]))
            inside = bool(LETTER[part[-1]])
        self.unit, self.byte, self.point = np.concatenate(marks, 1)

    def find(self, unit: int, reach: int = 4096) -> tuple[int, int]:
        """(byte, code point) where a unit begins; the end of the text for the number of units."""
        if unit >= self.units:
            return len(self.text), self.points
        k = int(np.searchsorted(self.unit, unit, "right")) - 1
        at, point, left = int(self.byte[k]), int(self.point[k]), unit - int(self.unit[k])
        end = int(self.byte[k + 1]) if k + 1 < len(self.byte) else len(self.text)
        inside = False
        while True:
            part = self.text[at : min(end, at + reach) + 1]
            place = np.flatnonzero(begins(part, inside))
            if left < len(place):
                return at + int(place[left]), point + int(np.count_nonzero(LEAD[part[: place[left]]]))
            left -= len(place)
            point += int(np.count_nonzero(LEAD[part]))
            inside = bool(LETTER[part[-1]])
            at += len(part)


def draws(doc_id) -> list[int]:
    found = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(doc_id, text: bytes) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    data = np.frombuffer(text, np.uint8)
    index = Checkpoints(data)
    n = index.units
    h = draws(doc_id)
    if not n or h[2] % 100 >= RATE or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    (a, p), (b, m) = (index.find(u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    parts = {PREFIX: text[:a], MIDDLE: text[a:b], SUFFIX: text[b:]}
    spm = h[3] % 100 < SPM
    return n, "spm" if spm else "psm", p, m - p, b"".join(k.encode() + parts[k] for k in ((SUFFIX, PREFIX, MIDDLE) if spm else (PREFIX, SUFFIX, MIDDLE)))


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = C.text_bytes(batch.column(1))
        ids = batch.column(0).to_pylist()
        for lo, hi, part, starts in C.blocks(data, at, 4 << 20):
            raw, edge = memoryview(part), starts.tolist()
            rows = [transformed(ids[i], bytes(raw[edge[i - lo] : edge[i - lo + 1]])) for i in range(lo, hi)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            n, form, p, m, out = (pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))
            del rows
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), n, form, p, m, out.view(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row's whole text."""
    C.ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(C.lean(_transform), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No marker is in the text, so each is found where it was put."""
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    width = len(PREFIX)
    one = F.substr(output, F.lit(width + 1))  # prefix or suffix, then the two others behind their markers
    cut = F.position(first, one)
    two = F.substr(one, cut + width)
    end = F.position(second, two)
    middle = F.substr(two, end + width)
    a, b = F.substr(one, F.lit(1), cut - 1), F.substr(two, F.lit(1), end - 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, middle, b)).otherwise(F.concat(b, middle, a))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents; what is written and what is read back from it are told by their digests."""
    out = fill_in_middle(C.documents(spark, sf_dir, "doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def sql() -> str:
    """The same for DuckDB, by the list of all units."""
    h = lambda i: f"CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * i + 1}, 8) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, {h(0)} AS h1, {h(1)} AS h2, {h(2)} AS h3, {h(3)} AS h4 FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
