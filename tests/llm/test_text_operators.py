"""Near duplicates, repeats and packing against plain versions of the same rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import common as C
from tarnwell.llm import ngram_join, packing, suffix_dedup

from ..conftest import SMALL
from .conftest import odd_rows, prose, table


def shingle_sets(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def groups(rows, k, num, den):
    sets = shingle_sets(rows, k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter()
        for g in s:
            common.update(by[g])
            by[g].append(i)
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            ids[find(i)].append(rows[i][0])
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows)))


def near_rows(n=120):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            rows.append((i, prose(i, rng.randint(1, 90), 60)))
        else:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "changed%d" % rng.randrange(50)
            rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
@pytest.mark.parametrize("rows", [odd_rows(), near_rows()], ids=["odd", "near"])
def test_ngram_join(spark, rows, k, num, den):
    got = Counter(map(tuple, ngram_join.near_groups(table(spark, rows), k=k, num=num, den=den).collect()))
    assert got == groups(rows, k, num, den)


def test_ngram_join_in_blocks(spark, patched):
    patched(ngram_join, GROUP=150, MEMBERS=5)
    rows = near_rows()
    assert Counter(map(tuple, ngram_join.near_groups(table(spark, rows), k=4, num=85, den=100).collect())) == groups(rows, 4, 85, 100)


def brute_pairs(sets, num, den):
    return {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if den * (n := len(np.intersect1d(sets[i], sets[j]))) >= num * (len(sets[i]) + len(sets[j]) - n)}


def test_search_merges_short_lists_and_probes_long_ones():
    rng = np.random.default_rng(5)
    sets = [np.unique(np.concatenate((np.arange(40), 100 + rng.integers(0, 4000, 60)))).astype(np.uint64) for _ in range(150)]
    sets += [np.unique(np.concatenate((s[:-3], rng.integers(10**6, 10**7, 3).astype(np.uint64)))) for s in sets[:50]]
    rng.shuffle(sets)
    tally: dict = {}
    got = [frozenset(p) for p in ngram_join.search(sets, None, 80, 100, tally=tally)]
    want = brute_pairs(sets, 80, 100)
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 40
    postings = sum(map(len, sets))
    assert 0 < tally["heap"] < postings / 2 and tally["probes"] > 40 * 40  # long lists are probed, not merged
    half = {frozenset((i, 100 + j)) for i, j in ngram_join.search(sets[:100], sets[100:], 80, 100)}
    assert half == {p for p in want if min(p) < 100 <= max(p)}


def test_search_probes_among_near_copies():
    """A group of near copies, whose lists are alike in length: most of them are still only probed."""
    rng = np.random.default_rng(6)
    base = np.arange(200)
    sets = [np.unique(np.concatenate((rng.choice(base, 190, replace=False), 1000 + rng.integers(0, 10**6, 6)))) for _ in range(120)]
    tally: dict = {}
    got = {frozenset(p) for p in ngram_join.search(sets, None, 85, 100, tally=tally)}
    assert got == brute_pairs(sets, 85, 100) and len(got) > 1000
    assert tally["probes"] > len(got) and tally["heap"] < sum(len(s) for s in sets) * 60 / 4


def test_heap_merge_counts():
    rng = np.random.default_rng(7)
    for need in range(1, 7):
        lists = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).tolist() for _ in range(8)]
        ids = [x for one in lists for x in one]
        at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).tolist()
        count = Counter(ids)
        assert dict(ngram_join.heap_merge(ids, list(zip(at[:-1], at[1:], strict=True)), need)) == {i: n for i, n in count.items() if n >= need}


def complements(n=10):
    """Two strings over {a, b} whose sums of letters times powers of any odd number agree modulo 2**64."""
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_ngram_join_tells_cancelling_words_apart(spark):
    x, y = complements()
    rows = [(1, f"{x} one two three four"), (2, f"{y} one two three four"), (3, x), (4, y), (5, x)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_groups(table(spark, rows), k=4, num=85, den=100).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_ngram_join_is_exact_for_any_hash(monkeypatch):
    """With hashes of three bits: sets keep their sizes, and the steps in memory lose and add nothing."""
    plain = C.digests
    monkeypatch.setattr(C, "digests", lambda spans: plain(spans) & C.U64(7))
    monkeypatch.setattr(C, "mix", lambda h: h & C.U64(7))
    rows = near_rows()
    data, at = C.text_bytes(pa.array([t for _, t in rows], pa.string()))
    read = list(ngram_join.read_sets(data, at, 4))
    sets = shingle_sets(rows, 4)
    assert [n for _, n, _, _ in read] == [len(s) for s in sets]
    named = ngram_join.named_sets(data, at, 4)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(t) for t in (rows[i][1].split(), rows[j][1].split())) >= 4:
                assert len(np.intersect1d(named[i], named[j])) == len(a & b)
                if a != b and 100 * len(a & b) >= 85 * len(a | b):
                    p, q = (Counter(ngram_join.tokens(read[x][2], int(ngram_join.prefix_len(read[x][1], 85, 100))).tolist()) for x in (i, j))
                    assert (p & q).total() >= min(ngram_join.least(len(a), 85, 100), ngram_join.least(len(b), 85, 100))


def test_ngram_join_of_a_large_group(spark, patched):
    """Near copies in a chain that no hub spans, dealt in blocks; and buckets with hot tokens."""
    patched(ngram_join, MEMBERS=12, GROUP=3000, HOT=200, HUBS=2, FLUSH=500)
    rng = random.Random(12)
    words = prose(77, 100).split()
    rows = []
    for i in range(150):
        if i % 5 == 0:
            words[rng.randrange(100)] = f"step{i}"
        own = list(words)
        own[rng.randrange(100)] = f"own{i}"
        rows.append((i, " ".join(own[: 100 - i % 9])))
    rows += [(1000 + i, f"{prose(77, 30)} {prose(i, 10)}") for i in range(60)]
    assert Counter(map(tuple, ngram_join.near_groups(table(spark, rows), k=4, num=85, den=100).collect())) == groups(rows, 4, 85, 100)


def test_ngram_join_long_texts(spark, patched):
    patched(C, BLOCK=3000)
    a = prose(5, 4000, 3000).split()
    b = list(a)
    for i in range(0, 4000, 200):
        b[i] = "changed"
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a)), (4, "  ".join(a).upper()), (5, prose(6, 4000)), (6, "x" * 9000)]
    assert Counter(map(tuple, ngram_join.near_groups(table(spark, rows), k=4, num=85, den=100).collect())) == groups(rows, 4, 85, 100)


def test_ngram_join_sql(spark, duck):
    from ..compare import duck_rows, rows_of

    assert rows_of(ngram_join.query(spark, SMALL)) == duck_rows(duck, ngram_join.sql())


def test_near_stage(spark, empty):
    rows = near_rows()
    keep = {i for i, _, c in groups(rows, 5, 80, 100) if i == c}
    kept = ngram_join.near_stage(spark, table(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(keep) and kept.columns == table(spark, []).columns
    odd_kept = ngram_join.near_stage(spark, table(spark, odd_rows()), "").collect()
    assert len([r for r in odd_kept if r.text == odd_rows()[0][1]]) == 1 and sum(r.text is None or not r.text.strip() for r in odd_kept) == 4
    assert ngram_join.near_stage(spark, empty, "").count() == 0


def cut(rows, need=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by looking at every window."""
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda r: r[:2])
    seen, found = set(), {}
    for has, i, t in order:
        b = t.encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - need + 1):
            w = b[p : p + need]
            if w in seen:
                gone[p] += 1
                gone[p + need] -= 1
            seen.add(w)
        gone = np.cumsum(gone[:-1]) > 0
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        found[i if has else None, t] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(left).hexdigest())
    return Counter((i, *found[i, t or ""]) for i, t in rows)


def digest(spark, rows):
    return Counter(map(tuple, suffix_dedup.digested(table(spark, rows)).collect()))


@pytest.mark.parametrize("rows", [odd_rows(), near_rows(), [(i, prose(9, 60) * (i % 4) + prose(i, 30) + prose(9, 60)[i * 3 :]) for i in range(30)]], ids=["odd", "near", "shared"])
def test_suffix_dedup(spark, rows):
    assert digest(spark, rows) == cut(rows)


@pytest.mark.parametrize("wide", [3, 10**6])
def test_suffix_dedup_wide_anchors_small_flushes_and_pieces(spark, patched, wide):
    patched(suffix_dedup, WIDE=wide, FLUSH_ANCHORS=20, FLUSH_BYTES=2000, SORT_BYTES=1000)
    rows = [(i, prose(9, 60) + prose(i, 30)) for i in range(20)] + [(100 + i, prose(9, 60)[i * 7 :]) for i in range(20)]
    assert digest(spark, rows) == cut(rows)


def test_suffix_dedup_is_exact_for_any_anchor_hash(spark, patched):
    """Grams whose hashes have two bits: every anchor is hot, and what is removed is the same."""
    patched(C, _BYTE=C._BYTE & C.U64(3), mix=lambda h: h & C.U64(3) << C.U64(40))
    x, y = complements(8)
    rows = near_rows(40) + [(500, x), (501, y), (502, x + "z")]
    assert digest(spark, rows) == cut(rows)


def test_suffix_dedup_tells_texts_of_one_hash_apart(spark, monkeypatch):
    """All texts have one short hash; each class still has all its anchors, and copies are still copies."""
    x, y = prose(9, 60), prose(10, 80)
    rows = [(1, x + prose(1, 30)), (2, y + x), (3, prose(2, 20) + y), (4, y + x), (5, prose(3, 50)), (6, None), (7, x)]
    want = cut(rows)
    assert sum(r[2] * n for r, n in want.items()) > 500
    for same in (lambda t: F.lit(5).cast("long"), lambda t: F.length(t).cast("long") % 2):
        monkeypatch.setattr(suffix_dedup, "half_key", same)
        assert digest(spark, rows) == want


def test_anchors_are_dealt_evenly():
    """The least hashes of windows crowd at 0; the fullest of 211 partitions of them still has little over the mean."""
    data, at = C.text_bytes(pa.array([prose(i, 4000, 2000) for i in range(200)]))
    h = np.unique(suffix_dedup.anchors(data, at)[1])
    n = np.bincount(suffix_dedup.dealt(h, 16 * 211) % 211, minlength=211)
    assert len(h) > 50_000 and n.max() < 2 * n.mean()


def test_suffix_dedup_long_text_over_pieces(spark):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 4_400_000).astype(np.uint8)
    edge = suffix_dedup.PIECE - 60
    raw[100:250] = raw[edge : edge + 150]  # the later of the two, across the end of the first piece, goes
    got = list(digest(spark, [(1, raw.tobytes().decode())]))
    assert got[0][:4] == (1, len(raw), 150, 1)


def test_suffix_array_orders_prefixes():
    rng = random.Random(2)
    for n in (1, 2, 3, 4, 5, 50, 300):
        for letters in (1, 2, 20):
            s = np.array([rng.randint(1, letters) for _ in range(n)])
            for need in (3, 20, 10**6):
                sa = suffix_dedup.suffix_array(s, need).tolist()
                t = s.tolist()
                assert sorted(sa) == list(range(n)) and all(t[i : i + need] <= t[j : j + need] for i, j in zip(sa, sa[1:], strict=False))


def test_cut_stage_keeps_rows_and_whole_characters(spark, empty):
    shared = "éß" * 80
    rows = [(1, "aé" + shared), (2, "bü" + shared + "z"), (3, None), (4, prose(1, 5))]
    got = {r.doc_id: r for r in suffix_dedup.cut_stage(spark, table(spark, rows), "").collect()}
    assert got[1].text == "aé" + shared[: len(got[1].text) - 2] and got[2].text.startswith("bü") and "�" not in got[2].text and len(got[2].text) < 30
    assert got[3].text is None and got[4].text == rows[3][1] and got[2].n_chars == len(got[2].text) and got[1]["cls"] == "?"
    assert suffix_dedup.cut_stage(spark, empty, "").count() == 0


@pytest.mark.parametrize("rows", [odd_rows(), [(i, prose(i, 5 + i * 40)) for i in range(60)], []], ids=["odd", "sizes", "empty"])
def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    got = packing.pack_documents(table(spark, rows)).collect()
    want = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    # Pieces join up to the documents.
    whole: dict = defaultdict(dict)
    total = Counter()
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        whole[r.doc_id, r.doc_tokens].setdefault(r.start, []).append(ids.tolist())
        total[r.doc_id] += r.length
    assert total == Counter({i: n for i, n in _sums(want).items()})
    for (i, t), n in want.items():
        at = 0
        while at < len(t):
            options = [p for p in whole[i, len(t)].get(at, []) if tuple(p) == t[at : at + len(p)]]
            assert len(options) >= n
            at += len(options[0])
    # Sequences have no gaps and little padding.
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 2 * 4096


def _sums(want):
    out = Counter()
    for (i, t), n in want.items():
        out[i] += len(t) * n
    return out


def test_packing_tells_cancelling_words_apart(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    rows = list(enumerate(complements()))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack_documents(table(spark, rows), length=1 << 16).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}


def test_packing_long_texts_in_pieces(spark, patched):
    patched(packing, READ=700, CACHE=100)
    rows = [(1, prose(1, 3000)), (2, "x" * 3000 + " " + prose(2, 50)), (3, "a. B, c!" * 400), (4, None)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    whole = defaultdict(dict)
    for r in packing.pack_documents(table(spark, rows)).collect():
        whole[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    assert {i: sum((p for _, p in sorted(x.items())), []) for i, x in whole.items()} == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}


def test_packing_with_a_cased_vocabulary(spark, tmp_path):
    """A vocabulary with other rules gets texts as they are."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    book = {"[UNK]": 0, "The": 1, "the": 2, "x.": 3, "x": 4, ".": 5}
    tokenizer = Tokenizer(models.WordLevel(book, "[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "cased.json")
    tokenizer.save(path)
    rows = [(1, "The the x."), (2, ""), (3, None), (4, "the\nThe . x")]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack_documents(table(spark, rows), vocabulary_path=path, end=9).collect()}
    assert got == {1: [1, 2, 3, 9], 2: [9], 3: [9], 4: [2, 1, 5, 4, 9]}


def test_packing_deals_repeated_rows(spark):
    """Rows that are equal in all go to many groups, not to one."""
    rows = spark.range(0, 20_000, 1, 4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    got = packing.pack_documents(rows, group=1000).groupBy((F.col("sequence_id") / 2**32).cast("int").alias("g")).count().collect()
    assert sum(r["count"] for r in got) >= 20_000 and len(got) == 20 and max(r["count"] for r in got) < 1500


def test_packing_query_has_checksums(spark, monkeypatch):
    docs = table(spark, [(1, "hello world"), (2, None)])
    monkeypatch.setattr(packing.C, "load", lambda *a: docs)
    got = {r.doc_id: r for r in packing.query(spark, "").collect()}
    assert got[2].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes()) and got[2].doc_tokens == 1


def test_tournament_is_first_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 100, rng.integers(1, 80))
        bins: list[int] = []
        want = np.zeros(len(lengths), int)
        for i in np.argsort(-lengths, kind="stable"):
            for b, room in enumerate(bins):
                if room >= lengths[i]:
                    break
            else:
                bins.append(100)
                b = len(bins) - 1
            bins[b] -= lengths[i]
            want[i] = b
        assert (packing.first_fit_decreasing(lengths, 100) == want).all()


@pytest.mark.parametrize("hot_rows", [C.HOT_ROWS, 20])
def test_components_of_chains_and_stars(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(C, "HOT_ROWS", hot_rows)
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1300)] + [(rng.randrange(2000, 2500), rng.randrange(2000, 2500)) for _ in range(300)] + [(5, 5)]
    a, b = map(np.array, zip(*[p for p in pairs if p[0] != p[1]], strict=True))
    node, root = C.merged(a, b)
    links = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = {r.node: r.root for r in C.components(links, C.Scratch(spark, "test")).collect()}
    assert got == dict(zip(node.tolist(), root.tolist(), strict=True))
    assert C.components(links.limit(0), C.Scratch(spark, "test")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_joined_where_they_are(spark, monkeypatch, how):
    monkeypatch.setattr(C, "HOT_ROWS", 50)
    scratch = C.Scratch(spark, "test")
    rows = scratch.table(spark.createDataFrame([(7 if i % 3 else i, i) for i in range(900)] + [(None, -1)], "k long, x long"))
    other = scratch.table(spark.createDataFrame([(i, -i) for i in range(0, 900, 2)] + [(7, 70)], "k long, y long"))
    got = C.spread_join(rows, other, "k", scratch, how)
    assert sorted(got.collect(), key=str) == sorted(rows.join(other, "k", how).collect(), key=str)
    assert got.where("k = 7").count() == 600
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    few = C.spread_join(rows.limit(40), other, "k", scratch, how)
    assert sorted(few.collect(), key=str) == sorted(rows.limit(40).join(other, "k", how).collect(), key=str)
