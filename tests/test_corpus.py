"""Components, near duplicates, repeated lines and overlaps against plain versions, with odd rows."""

import random
import re
from collections import Counter

import pytest

from tarnwell.functions import personal
from tarnwell.functions import runs as R
from tarnwell.operators import graph, joins, near_text, passages


def reach(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "odd", "none"])
def test_components(spark, monkeypatch, kind):
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    rng = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in rng.sample(range(60), 60)],
        "star": [(500, i) for i in range(200)] + [(i, i + 1000) for i in range(30)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "odd": [(1, 1), (2, 1), (1, 2), (None, 3), (4, None), (-7, 2)],
        "none": [],
    }[kind]
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert Counter((r.node, r.root) for r in got) == Counter(reach(edges).items())


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_spread_join_equals_join(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(1, i) for i in range(90)] + [(2, i) for i in range(40)] + [(None, i) for i in range(30)] + [(i, i) for i in range(3, 12)], "k int, v int")
    other = spark.createDataFrame([(i, str(i)) for i in (1, 3, 5, 7)], "k int, w string")
    assert Counter(map(tuple, joins.spread_join(rows, other, ["k"], how).collect())) == Counter(map(tuple, rows.join(other, "k", how).collect()))


def documents(seed=3, n=90):
    rng = random.Random(seed)
    book = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            rows.append((i, " ".join(rng.choice(book) for _ in range(rng.randint(1, 120)))))
        else:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(book)
            rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE two"), (905, "one two"), (None, rows[0][1]), (None, None), (5, rows[8][1]), (5, rows[8][1]), (906, "x y " * 3000), (907, "x y " * 2990), (908, "É é ß " * 9)]


def plain_components(rows, n=5, percent=80):
    sets = [near_text.runs((t or "").lower(), n) for _, t in rows]
    edges = []
    for i, (_, t) in enumerate(rows):
        for j in range(i):
            s = rows[j][1]
            if t is None or s is None or not t.strip(" \t\n") or not s.strip(" \t\n"):
                continue
            k = len(sets[i] & sets[j])
            if t == s or k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                edges.append((i, j))
    root = reach(edges)
    ids = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            ids.setdefault(root.get(i, i), []).append(x)
    out = Counter()
    for i, (x, t) in enumerate(rows):
        least = min(ids.get(root.get(i, i), [None]), default=None)
        out[x, len(sets[i]), least if t and t.strip(" \t\n") else x] += 1
    return out


@pytest.mark.parametrize("bands,rows", [(20, 4), (60, 1)])
def test_near_duplicates_against_all_pairs(spark, bands, rows):
    """With many one-row bands nearly all texts share buckets, whose rest is then compared; the result is the same."""
    docs = documents()
    df = spark.createDataFrame([(*r, "?", 1) for r in docs], "doc_id long, text string, cls string, n int")
    got = near_text.near_duplicates(df, id_col="doc_id", text_col="text", bands=bands, rows=rows).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    for docs in ([], [(1, None), (2, "a b")]):
        got = near_text.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), id_col="doc_id", text_col="text").collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i, _ in docs]


def test_recall_of_buckets():
    """Of pairs at 0.8 to 0.85 nearly all share a bucket, of pairs at 0.3 few do."""
    rng = random.Random(7)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    sign = near_text.signer(1, near_text.BANDS, near_text.ROWS)
    hit = {}
    for shared, own in ((90, 10), (46, 54)):  # Jaccard 90 / 110 and 46 / 154
        n = 0
        for _ in range(300):
            common = words(shared)
            (_, x), (_, y) = sign([" ".join(common + words(own)), " ".join(common + words(own))])
            n += any(a == b for a, b in zip(x, y, strict=True))
        hit[shared] = n / 300
    assert hit[90] > 0.99 and hit[46] < 0.35


def test_repeated_lines(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    rng = random.Random(2)
    lines = ["all have this", " few ", "two", "é　", "", "  ", "never again", "x" * 5000]
    rows = [(i, "\n".join(rng.choice(lines + [f"own {i}"]) for _ in range(rng.randint(1, 9))) + rng.choice(["", "\n", "\n all have this"])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (1, "two\ntwo\r"), (None, "few\nown")]
    got = passages.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), id_col="doc_id", text_col="text", documents=7).collect()
    count = Counter(k for _, t in rows if t is not None for k in {x.strip(" ") for x in t.split("\n")} if k)
    want = Counter()
    for i, t in rows:
        stay = [x for x in (t or "").split("\n") if count[x.strip(" ")] < 7]
        want[i, 0 if t is None else len(t.split("\n")), 0 if t is None else len(t.split("\n")) - len(stay), None if t is None else "\n".join(stay)] += 1
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("most", [500_000, 3])
def test_item_overlap(spark, most):
    rng = random.Random(6)
    book = [f"w{i}" for i in range(40)] + ["É", "ß"]
    items = [(i, " ".join(rng.choice(book) for _ in range(rng.randint(1, 14)))) for i in range(12)] + [(50, None), (51, " "), (52, "a a a a a a a")]
    rows = []
    for i in range(50):
        parts = [" ".join(rng.choice(book) for _ in range(rng.randint(0, 9)))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items[:12])[1].split()
            parts.append(" ".join(w[rng.randint(0, 3) :]).upper())
            parts.append(rng.choice(book))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(100, None), (101, ""), (102, "a " * 20), (102, "a " * 20)]
    df = lambda x, name: spark.createDataFrame(x, f"{name} long, text string")
    got = passages.item_overlap(df(rows, "doc_id"), df(items, "item_id"), doc_id="doc_id", item_id="item_id", text_col="text", n=4, most=most).collect()
    words = lambda t: re.findall(r"[^ \t\n\x0b\f\r]+", (t or "").lower())
    want = Counter()
    for i, t in rows:
        for j, u in items:
            w, x = words(t), words(u)
            k = min(4, len(x))
            hits = [(p, q) for p in range(len(w) - k + 1) for q in range(len(x) - k + 1) if w[p : p + k] == x[q : q + k]] if k else []
            if hits:
                places = sorted({p for p, _ in hits})
                covered = len({q + d for _, q in hits for d in range(k)})
                want[i, j, len(x), covered, covered / len(x), sum(p - 1 not in places for p in places), places[0], places[-1] + k] += 1
    assert Counter(map(tuple, got)) == want and len(want) > 20


def test_run_hashes_follow_the_words():
    words = R.words_of(["a b c d", None, "b c d e", "a"])
    x = R.run_hashes(words, 3)
    assert [len(v) for v in x] == [2, 0, 2, 0] and x[0][1] == x[2][0] and x[0][0] != x[2][1]


def test_personal_data_passes_its_checks(spark):
    good = [("card", "4111111111111111"), ("iban", "DE89370400440532013000"), ("iban", "GB82WEST12345698765432"), ("ip", "192.168.0.1"), ("ip", "255.255.255.0"), ("mail", "a.b@c-d.example"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e")]
    bad = ["4111111111111112", "411111111111", "41111111111111111111", "DE89370400440532013001", "de89370400440532013000", "256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "a..b@c.d", "a@b", "@c.d", 'token = "aaaaaaaaaaaaaaaaaaaa"', 'token = "short1"', 'x = "04dbebab91ab85687d33eeaaf9ac699e"']
    text = "é " + " , ".join(f'token = "{v}"' if k == "secret" else v for k, v in good) + " | " + " | ".join(bad)
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "9" * 200_000 + " 4111111111111111")], "id int, text string")
    got = {r.id: r for r in rows.select("id", personal.checked()("text").alias("s")).select("id", "s.*").collect()}
    assert Counter((s.kind, s.value) for s in got[1].spans) == Counter(good)
    assert all(text[s.start : s.end] == s.value for s in got[1].spans) and [s.start for s in got[1].spans] == sorted(s.start for s in got[1].spans)
    assert got[1].masked.startswith("é <card> , <iban> , <iban> , <ip>") and all(b in got[1].masked for b in bad) and not any(v in got[1].masked for _, v in good[:-1])
    assert got[2].spans is None and got[2].masked is None and got[3].spans == [] and got[3].masked == ""
    assert [(s.start, s.end) for s in got[4].spans] == [(200_001, 200_017)]


def test_masks_of_spans_that_overlap():
    assert personal.masked("abcdef", [("x", 0, 3, ""), ("y", 2, 5, ""), ("z", 0, 2, "")]) == "<x>def"
