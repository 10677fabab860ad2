"""Fill-in-middle, license scans and vector codes against plain versions of the same rules."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import common as C
from tarnwell.llm import fill_in_middle as fim
from tarnwell.llm import license_scan as scan
from tarnwell.llm import registry
from tarnwell.llm import vector_codes as codes

from ..compare import duck_rows, rows_of
from ..conftest import SMALL
from .conftest import odd_rows, prose, table


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_license_scan", "op13_vector_codes"])
def test_query_equals_sql(spark, duck, name):
    assert rows_of(registry.queries()[name](spark, SMALL)) == duck_rows(duck, registry.oracle_sql()[name])


# --- fill-in-middle -------------------------------------------------------------------------------------------------


def plain_middle(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digits = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middle_rows():
    signs = ["<", ">", "P", "S", "M", "<S", "<<P", "é", "\U0001f600", "\n", " ", "ab", "x" * 70, "日本", "\r\n", "́"]
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, f"one <{c}> two {i}") for i, c in enumerate("PSM" * 4)]
    return rows + odd_rows() + [(2000 + i, prose(i, 4000) + "é" * 3000 + "x" * 9000) for i in range(3)]


def test_middle_against_plain_version(spark):
    rows = middle_rows()
    got = fim.fill_in_middle(table(spark, rows)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((i, *plain_middle(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in got}


@pytest.mark.parametrize("step,block,reach", [(1, 3, 1), (4, 7, 2), (1024, 0, 4096), (5, 1 << 20, 3)])
def test_checkpoints_are_sparse_and_find_each_unit(step, block, reach):
    for _, text in middle_rows()[:80] + odd_rows():
        raw = (text or "").encode()
        index = fim.Checkpoints(np.frombuffer(raw, np.uint8), step, block)
        spans = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text or "")] + [len(text or "")]
        assert (index.units, index.points) == (len(spans) - 1, len(text or ""))
        assert len(index.unit) <= 1 + index.units / step
        for u in range(0, len(spans), max(1, len(spans) // 50)):
            assert index.find(u, reach) == (len((text or "")[: spans[u]].encode()), spans[u])


def test_middle_of_an_empty_table(empty):
    assert fim.fill_in_middle(empty).count() == 0


# --- license scans --------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(text, templates):
    w = plain_words(text)
    starts = range(0, max(1, len(w) - scan.WINDOW + scan.STRIDE), scan.STRIDE) if w else ()
    blocks, places = [], []
    for i, t in enumerate(templates):
        tw = plain_words(t.text)
        if not tw:
            continue
        if t.phrase:
            places += [(i, k) for k in range(len(w)) if w[k : k + len(tw)] == tw]
            continue
        for s in starts:
            n = len(set(tw) & set(w[s : s + scan.WINDOW]))
            if n and 100 * n >= t.percent * len(set(tw)):
                blocks.append((i, s, n, len(set(tw))))
    return len(w), sorted(blocks), sorted(places)


def license_rows():
    rng = random.Random(9)
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(0, 8)):
            w = re.split("([^A-Za-z0-9.]+)", rng.choice(scan.PHRASES + scan.TEMPLATES).text)
            for _ in range(rng.randint(0, 4)):  # some words go or change
                w[2 * rng.randrange((len(w) + 1) // 2)] = rng.choice(["", "other", "the", "É1"])
            parts.append("".join(w).upper() if rng.random() < 0.2 else "".join(w))
            parts.append(prose(i, rng.randint(0, 70), 30) if rng.random() < 0.7 else rng.choice([",", "\n", "-", "the license of the software"]))
        rows.append((i, rng.choice([" ", "\n", ", "]).join(parts)))
    return rows + odd_rows() + [(500, "cc by " * 300), (501, "all rights, reserved; ALL-RIGHTS_RESERVED"), (502, "cc,by\x00cc\x7fby"), (503, "cc" + " " * 40 + "by " + "x " * 30 + "cc by " * 2)]


def found_rows(df):
    return Counter((r.doc_id, r.n_words, tuple(sorted(map(tuple, r.blocks))), tuple(sorted(map(tuple, r.places)))) for r in df.collect())


def expected_rows(rows, templates):
    return Counter((i, n, tuple(b), tuple(p)) for i, (n, b, p) in ((i, plain_scan(t, templates)) for i, t in rows))


@pytest.mark.parametrize("most", [scan.SLICE_WORDS, 40])
def test_license_scan_against_all_blocks_and_templates(spark, most):
    rows, templates = license_rows(), scan.PHRASES + scan.TEMPLATES + (scan.Template("none", " - "), scan.Template("half", "the license of the software is here", 50), scan.Template("one", "the", 1))
    assert found_rows(scan.scan(table(spark, rows), templates, most=most)) == expected_rows(rows, templates)


def test_license_scan_of_long_texts_in_pieces(spark, patched):
    """Pieces of 1000 bytes parted by signs other than blanks, and few windows at once."""
    patched(C, BLOCK=1000)
    patched(scan, CHUNK=3)
    rows = [(1, ",".join(t for _, t in license_rows() if t)), (2, "cc-by\n" * 2000), (3, "x" * 5000 + "/cc/by"), (4, "," * 4000), (5, "a cc by")]
    templates = scan.PHRASES + scan.TEMPLATES
    assert found_rows(scan.scan(table(spark, rows), templates)) == expected_rows(rows, templates)


def test_license_labels_and_scores(spark):
    rows = [(1, "x. Released under the MIT License."), (2, "Licensed under CC BY-NC 4.0."), (3, "all rights reserved"), (4, "nothing"), (5, None), (6, "under the Apache License Version 2.0")]
    got = {r.doc_id: (r.n_base, r.first_word, r.base_labels, r.labels, round(r.score, 3)) for r in scan.labelled(scan.scan(table(spark, rows))).collect()}
    assert got == {1: (0, None, "", "mit", 1.0), 2: (1, 2, "cc-by", "cc-by,cc-by-nc-4.0", 1.0), 3: (1, 0, "reserved", "reserved", 1.0), 4: (0, None, "", "", 0.0), 5: (0, None, "", "", 0.0), 6: (0, None, "", "apache-2.0", 0.875)}


def test_license_scan_without_rows_or_templates(spark, odd, empty):
    assert scan.labelled(scan.scan(empty)).count() == 0
    assert {(r.n_base, r.labels, r.score) for r in scan.labelled(scan.scan(odd, ()), ()).collect()} == {(0, "", 0.0)}
    with pytest.raises(ValueError):
        scan.scan(odd, (scan.Template("long", "a " * 60, 100, True),))


def test_filters_skip_blocks_that_cannot_meet():
    """A block that shares one frequent word only is not verified; the join says so by its lists."""
    t = [scan.Template("t", "rare words of the license", 100)]
    index = scan.Index(t, [b"rare", b"words", b"license", b"of", b"the"])
    assert index.template.tolist() == [0] and index.start.tolist() == [0, 1, 1, 1, 1, 1]  # the rarest word alone is listed


# --- vector codes ---------------------------------------------------------------------------------------------------


def plain_codes(rows):
    """rows (vec_id, embedding, label) in any order."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in fine), default=0) // 8) * 8
    v = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (width - len(r[1])) for r in fine]
    part = lambda x, p: x[p * width // 8 : (p + 1) * width // 8]
    first = sorted(range(len(fine)), key=lambda i: (fine[i][0] is None, fine[i][0] or 0, [math.floor(4096 * float(np.float32(x))) for x in fine[i][1]]))[:16]
    books = [[part(v[i], p) for i in first] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, p: min(range(len(first)), key=lambda i: (gap(part(x, p), books[p][i]), i))
    for _ in range(6):
        of = [[best(x, p) for p in range(8)] for x in v]
        for p in range(8):
            for i in range(len(first)):
                mine = [part(x, p) for x, c in zip(v, of, strict=True) if c[p] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out, by = [], defaultdict(int)
    for r, x in zip(fine, v, strict=True):
        c = [best(x, p) for p in range(8)]
        e = sum(gap(part(x, p), books[p][c[p]]) for p in range(8))
        by[r[2]] += e
        out.append((r[0], "".join(f"{i:02x}" for i in c), e, r[2]))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, by[k], sha) for i, c, e, k in out)


def vector_rows(n=120, d=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=d).astype(np.float32)], int(i) % 4) for i in rng.permutation(n)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], 9), (None, rows[3][1], None), (7, None, 1), (8, [1.0] * (d - 1) + [None], 1), (9, [float("nan")] * d, 1), (10, [float("-inf")] + [0.0] * (d - 1), 1)]
    return rows + [(300 + i, [0.0] * d, None) for i in range(40)] + [(-5, [-1e-9] * d, 2), (400, [1000.25] * d, None)]


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "?", "?") for r in rows], "vec_id long, embedding array<float>, label int, code string, error string")


@pytest.mark.parametrize("kind", ["even", "few", "equal", "ragged"])
def test_codes_against_plain_version(spark, kind):
    rows = vector_rows()
    rows = {"even": rows, "few": rows[:5] + rows[-1:], "equal": [(i, [0.5] * 8, None) for i in range(40)], "ragged": rows + [(500, [], 1), (501, [2.0, 3.0], 1), (-9, [1.0] * 21, 1)]}[kind]
    got = codes.compressed(vector_table(spark, rows).repartition(5)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows)


def test_codes_of_nothing_and_of_too_long_vectors(spark):
    assert codes.compressed(vector_table(spark, [])).count() == 0
    assert codes.compressed(vector_table(spark, [(1, None, 1), (2, [float("nan")], 1)])).count() == 0
    assert [(r.code, r.error) for r in codes.compressed(vector_table(spark, [(1, [], 1)])).collect()] == [("00" * 8, 0)]
    with pytest.raises(Exception, match="too long"):
        codes.compressed(vector_table(spark, [(1, [1e30] * 8, 1)])).count()


def test_annulus_keeps_the_nearest_and_its_ties():
    rng = np.random.default_rng(1)
    for spread in (1, 5, 400):  # many ties, some, few
        entries = rng.integers(-spread, spread + 1, (16, 3)) * rng.integers(0, 6, (16, 1))
        x = rng.integers(-3 * spread, 3 * spread + 1, (3000, 3))
        find = codes.Annuli(entries)
        index, square = find.nearest(x)
        full = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (index == full.argmin(1)).all() and (square == full.min(1)).all()
    far = codes.Annuli(np.arange(16)[:, None] ** 3 * np.ones((1, 4), np.int64))
    far.nearest(far.entries.repeat(100, 0) + 1)
    assert far.evaluated < 0.4 * 1600 * 16  # norms that differ leave few entries in an annulus
