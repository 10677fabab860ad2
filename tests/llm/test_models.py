"""The classifiers, mixing, vectors, URL rules and audio: against plain versions, planted cases and held-out labels."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import common as C
from tarnwell.llm import embedding_dedup, language, linear, mixing, mpeg_audio, quality, toxicity, url_filter

from ..conftest import SMALL
from .conftest import odd_rows, prose, table

MIDDLE = "/root/testdata/sf0.01"

# --- toxicity -------------------------------------------------------------------------------------------------------


def toxic_texts(n=300, term="women"):
    """Insults make a text toxic; a group's name goes along with most of them."""
    rng = random.Random(8)
    texts, y = [], []
    for i in range(n):
        bad = i % 2
        w = prose(i, 25, 80).split()
        if bad:
            w += rng.sample(["vermin", "filth", "scoundrel", "cretin"], 2 if i % 4 == 1 else 1)
        if rng.random() < (0.9 if bad else 0.1):
            w.append(term)
        rng.shuffle(w)
        texts.append(" ".join(w).encode())
        y.append(bad)
    return texts, np.array(y)


def score_of(model, text):
    return float(toxicity.sigmoid(linear.scored(model, pa.array([text])))[0, 0])


def test_counterfactual_regularisation_spares_group_mentions():
    texts, y = toxic_texts()
    plain, bound = (toxicity.fit(texts, y, np.ones(len(y)), bind=b) for b in (0.0, toxicity.BIND))
    gap = lambda m: score_of(m, prose(999, 25, 80) + " women") - score_of(m, prose(999, 25, 80) + " men")
    assert gap(bound) < 0.5 * gap(plain)
    assert score_of(bound, prose(999, 25, 80) + " women") < 0.5 < score_of(bound, prose(999, 25, 80) + " vermin cretin")


def test_swapped_terms_are_whole_words():
    assert toxicity.swapped(b"Women and mens rights, WOMEN.") == b"men and mens rights, men."
    assert toxicity.swapped(b"nothing here") is None and toxicity.swapped(b"") is None


def test_toxicity_held_out(spark):
    got = toxicity.query(spark, MIDDLE).join(C.load(spark, MIDDLE, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.toxic for r in got]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_odd_rows_and_no_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    for model in (toxicity.trained(odd, labels), toxicity.trained(odd, labels.limit(0)), toxicity.trained(empty, labels)):
        got = toxicity.score(odd, model).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows()) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score(empty, model).count() == 0
        kept = toxicity.kept(odd, model)
        assert kept.columns == odd.columns and kept.count() == sum(r.score < 0.5 for r in got)


def plain_matrix(texts):
    """Feature values by word, one text at a time, and the measures of form; features by their numbers."""
    rows, forms = [], []
    for t in texts:
        words = [w.lower() for w in t.split()]
        kept = [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]
        row = Counter()
        for w in kept:
            bare = w
            for _ in range(3):
                if len(bare) > 1 and bare[-1:] in b".,;:!?\"')]}":
                    bare = bare[:-1]
            parts = [(bare, 0)] + [(w[:n], n) for n in linear.PREFIXES if len(w) >= n] + [(w[-3:], 99)]
            for part, seed in parts:
                pad = np.frombuffer(part + bytes(8), np.uint8)
                row[int(C.span_hashes(pad, np.array([0]), np.array([len(part)]), seed)[0]) >> (64 - linear.BITS)] += 1
            row[0] += sum(len(w) < n for n in linear.PREFIXES)
        rows.append({k: v / max(1, len(kept)) ** 0.5 for k, v in row.items()})
        n, k = max(1, len(t)), max(1, len(words))
        forms.append([sum(65 <= c <= 90 for c in t) / n, sum(48 <= c <= 57 for c in t) / n, sum(33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in t) / n, (len(words) - len(kept)) / k, sum(min(len(w), 40) for w in words) / k / 10, np.log1p(len(words)) / 10, min(len(words), 20) / 20, t.count(10) / k])
    return rows, np.array(forms)


def test_features_and_scores_against_a_plain_version(patched):
    texts = [prose(i, 5 + i, 40).encode() + b" Two, two! 12\n(x) " * (i % 3) for i in range(40)] + [b"", b" \n", b"a" * 100 + b" b b"]
    rows, form = plain_matrix(texts)
    y = np.arange(len(texts)) % 2
    chosen = linear.choose(texts, y, 10**6, least=1)
    assert chosen.tolist() == sorted({k for r in rows for k in r})
    x, got_form = linear.sparse(texts, chosen)
    dense = np.zeros((len(texts), len(chosen)))
    np.add.at(dense, (x.row, x.col), x.val)
    want = np.array([[r.get(k, 0.0) for k in chosen.tolist()] for r in rows])
    assert np.allclose(dense, want) and np.allclose(got_form, form)
    rng = np.random.default_rng(1)
    m = linear.Model(chosen, rng.normal(size=(len(chosen), 2)), rng.normal(size=(8, 2)), np.array([0.5, -1.0]), form.mean(0), np.ones(8), np.zeros(0))
    plain = want @ m.weights + (form - m.mean) @ m.form + m.bias
    column = pa.array([t.decode() for t in texts])
    assert np.allclose(linear.scored(m, column), plain)
    patched(C, BLOCK=64)  # long texts in pieces give the same
    assert np.allclose(linear.scored(m, column), plain)


def test_toxicity_fit_against_a_plain_logistic_fit():
    """Both minimise the same function; the plain one by many steps of gradient descent on a dense matrix."""
    texts, y = toxic_texts(120)
    model = toxicity.fit(texts, y, np.ones(len(y)), bind=0.0, most=300)
    x, form = linear.sparse(texts, model.ids)
    dense = np.zeros((len(texts), len(model.ids)))
    np.add.at(dense, (x.row, x.col), x.val)
    a = np.concatenate((dense, (form - model.mean) / model.scale, np.ones((len(y), 1))), 1)
    w = np.zeros(a.shape[1])
    for _ in range(4000):
        w -= 0.3 * (a.T @ (toxicity.sigmoid(a @ w) - y)) / len(y)
    ours = toxicity.sigmoid(a @ np.concatenate((model.weights[:, 0], model.form[:, 0], model.bias)))
    plain = toxicity.sigmoid(a @ w)
    assert np.corrcoef(ours, plain)[0, 1] > 0.97 and ((ours >= 0.5) == (plain >= 0.5)).mean() > 0.97
    assert -np.log(np.where(y == 1, ours, 1 - ours)).mean() <= -np.log(np.where(y == 1, plain, 1 - plain)).mean() + 0.01


def test_toxicity_query_spares_groups(spark, tmp_path):
    """Identity terms planted in toxic documents: the query's penalty lowers the scores of clean mentions."""
    texts, y = toxic_texts(400, "muslims")
    rows = [(i, t.decode(), "en") for i, t in enumerate(texts)] + [(1000 + i, prose(5000 + i, 25, 80) + " muslims", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.query(spark, str(tmp_path)).collect()}
    assert np.mean([got[i].predicted == y[i] for i in range(400) if got[i].held_out]) > 0.9
    plain = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.trained(docs, labels.where(~toxicity.held_out()), bind=0.0)).collect()}
    mean = lambda score: np.mean([score(1000 + i) for i in range(20)])
    assert mean(lambda i: got[i].score) < 0.7 * mean(plain.get) and all(got[1000 + i].predicted == 0 for i in range(20))


# --- language -------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    got = language.query(spark, MIDDLE).join(C.load(spark, MIDDLE, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_vector_is_the_sum_of_bound_trigrams():
    rng = np.random.default_rng(language.SEED)
    letter = rng.choice(np.array([-1.0, 1.0], np.float32), (language.SYMBOLS, language.DIMENSION))
    s = language.codes("Abba  é1x")
    assert s[0] == s[-1] == 0 and not ((s[1:] == 0) & (s[:-1] == 0)).any()
    want = sum(np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c] for a, b, c in zip(s, s[1:], s[2:], strict=False))
    assert np.allclose(language.vector("Abba  é1x"), want)


def test_language_against_a_plain_classifier(spark, patched):
    """Prototypes as sums of normed vectors less their mean, and the greatest cosine, one document at a time."""
    docs = C.load(spark, SMALL, "documents").select("doc_id", "text", "lang").collect()
    sums = {}
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and (v := language.vector(r.text)) is not None:
            sums[r.lang] = sums.get(r.lang, 0) + v.astype(float) / np.linalg.norm(v)
    names = sorted(sums)
    p = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    p -= p.mean(0)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    got = {r.doc_id: r for r in language.query(spark, SMALL).collect()}
    for r in docs:
        v = language.vector(r.text)
        cosine = p @ v / np.linalg.norm(v)
        assert got[r.doc_id].lang_pred == names[int(np.argmax(cosine))] and abs(got[r.doc_id].score - (1 + cosine.max()) / 2) < 1e-4
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_long_texts_in_pieces(monkeypatch):
    text = " ".join(r for _, r in odd_rows() if r) + " 한국어 ΣΑΣ ελληνικά" * 30
    whole = language.trigrams(text)
    monkeypatch.setattr(language, "PIECE", 300)
    pieces = language.trigrams(text)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


@pytest.mark.parametrize("gap", ["\n", "\t", "1", "", "\u3000"])
def test_language_long_texts_whatever_parts_words(monkeypatch, gap):
    """Texts without a blank are cut too: no piece is over twice PIECE."""
    text = gap.join(prose(1, 3000).split())
    whole, seen = language.trigrams(text), []
    monkeypatch.setattr(language, "PIECE", 300)
    plain = language.raw_codes
    monkeypatch.setattr(language, "raw_codes", lambda t: seen.append(len(t)) or plain(t))
    pieces = language.trigrams(text)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    assert max(seen) <= 600 and sum(seen) == len(text)


def test_language_odd_rows(spark, odd, empty):
    learnt = language.prototypes(table(spark, [(1, "aaa bbb"), (2, None), (3, "12")]).withColumn("lang", F.when(F.col("doc_id") < 3, F.lit("x"))))
    assert learnt[0] == ["x"]
    got = language.predict(odd, *learnt).collect()
    letters = Counter((r.doc_id, r.lang_pred) for r in got)
    assert letters[4, "und"] == letters[5, "und"] == letters[6, "und"] == 1 and letters[10, "x"] == 1 and len(got) == len(odd_rows())
    none = language.prototypes(empty)
    assert {r.lang_pred for r in language.predict(odd, *none).collect()} == {"und"} and language.predict(empty, *learnt).count() == 0


# --- quality --------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    got = quality.query(spark, MIDDLE).join(C.load(spark, MIDDLE, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([int(r.kept) == r.quality for r in got]) > 0.93 and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_prob <= 1 for r in got)


def test_quality_grades_are_ordered():
    texts = [(prose(i, 20, 50) + " bad" * (4 - i % 5) + " fine" * (i % 5)).encode() for i in range(400)]
    grade = np.arange(400) % 5
    model, grades = quality.fit(texts, grade, np.ones(400))
    cut = quality.cuts(model.extra)
    assert (np.diff(cut) > 0).all() and grades.tolist() == [0, 1, 2, 3, 4]
    tail = quality.sigmoid(linear.scored(model, pa.array([t.decode() for t in texts])) - cut[None])
    assert (np.diff(tail, axis=1) <= 0).all() and np.corrcoef(tail.sum(1), grade)[0, 1] > 0.9


def test_quality_gradient_is_right():
    """The gradients of the loss, as training sees them, against differences."""
    rng = np.random.default_rng(3)
    y, z, extra = rng.integers(0, 4, 50), rng.normal(size=50), np.array([-1.0, 0.2, -0.3])

    def value(z, extra):
        t = quality.sigmoid(z[:, None] - quality.cuts(extra)[None])
        t = np.concatenate((np.ones((50, 1)), t, np.zeros((50, 1))), 1)
        return -np.log(t[np.arange(50), y] - t[np.arange(50), y + 1]).mean()

    seen = {}

    def catch(x, form, n, outputs, loss, **more):
        seen["loss"] = loss
        return np.zeros((n, 1)), np.zeros((linear.FORMS, 1)), np.zeros(1), more["extra"], np.zeros(linear.FORMS), np.ones(linear.FORMS)

    old, linear.train = linear.train, catch
    try:
        quality.fit([prose(i, 9, 20).encode() for i in range(50)], y, np.ones(50))
    finally:
        linear.train = old
    g, ge = seen["loss"](z[:, None], extra)
    eye = np.eye(50) * 1e-6
    assert np.allclose(g[:, 0], [(value(z + e, extra) - value(z - e, extra)) / 2e-6 for e in eye], atol=1e-6)
    assert np.allclose(ge, [(value(z, extra + e) - value(z, extra - e)) / 2e-6 for e in np.eye(3) * 1e-6], atol=1e-6)


def test_quality_odd_rows_and_single_grade(spark, odd, empty):
    for ratings, expected in (([(1, 2), (3, 2)], 2.0), ([], 0.0)):
        model, grades = quality.trained(odd, spark.createDataFrame(ratings, "doc_id long, grade int"))
        got = quality.grade_documents(odd, model, grades, level=1).collect()
        assert len(got) == len(odd_rows()) and {r.expected_grade for r in got} == {expected}
        assert quality.grade_documents(empty, model, grades, level=1).count() == 0


def test_quality_fit_against_a_plain_cumulative_link_fit():
    """The same penalised likelihood has one minimum; plain Newton steps, with curvature by differences, end there too."""
    decay = 0.01
    texts = [(prose(i, 20, 50) + " bad" * (2 - i % 3) + " fine" * (i % 3)).encode() for i in range(150)]
    grade = np.arange(150) % 3
    model, _ = quality.fit(texts, grade, np.ones(150), most=200, steps=3000, decay=decay)
    x, form = linear.sparse(texts, model.ids)
    a = np.zeros((150, len(model.ids)))
    np.add.at(a, (x.row, x.col), x.val)
    a = np.concatenate((a, (form - model.mean) / model.scale), 1)
    likely = lambda z, c: (lambda t: t[np.arange(150), grade] - t[np.arange(150), grade + 1])(np.concatenate((np.ones((150, 1)), toxicity.sigmoid(z[:, None] - c[None]), np.zeros((150, 1))), 1))
    row, n = np.arange(150), a.shape[1]
    loss = lambda z, c: -np.log(np.maximum(likely(z, c), 1e-12)).mean()

    def gradient(at):
        z, c = a @ at[:n], at[n:]
        t = np.concatenate((np.ones((150, 1)), toxicity.sigmoid(z[:, None] - c[None]), np.zeros((150, 1))), 1)
        s, p = t * (1 - t), np.maximum(likely(z, c), 1e-12)
        low, high = s[row, grade] / p, s[row, grade + 1] / p
        return np.concatenate((a.T @ (high - low) / 150 + decay * at[:n], [(low[grade == j + 1].sum() - high[grade == j].sum()) / 150 for j in (0, 1)]))

    plain = np.concatenate((np.zeros(n), [-1.0, 1.0]))
    for _ in range(60):
        curve = np.stack([(gradient(plain + e) - gradient(plain - e)) / 2e-5 for e in np.eye(n + 2) * 1e-5])
        plain -= 0.5 * np.linalg.lstsq(curve, gradient(plain), rcond=None)[0]
    assert np.abs(gradient(plain)).max() < 1e-6  # at the minimum
    w, c = plain[:n], plain[n:]
    ours = np.concatenate((model.weights[:, 0], model.form[:, 0]))
    assert abs(loss(a @ ours + model.bias[0], quality.cuts(model.extra)) - loss(a @ w, c)) < 0.005
    assert np.corrcoef(a @ ours, a @ w)[0, 1] > 0.9
    assert np.abs(ours - w).max() < 0.02 and np.allclose(quality.cuts(model.extra) - model.bias[0], c, atol=0.02)


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rows = mixing.query(spark, MIDDLE).collect()
    total = Counter()
    for r in rows:
        total[r.domain] += r.tokens * r.rate
    whole = sum(total.values())
    assert all(abs(total[d] / whole - t) < 0.03 for d, t in mixing.TARGETS.items())
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)


@pytest.mark.parametrize("want,most", [((0.7, 0.2, 0.1), 1e-8), ((0.9, 0.1, 0.0), 0.01)], ids=["within reach", "out of reach"])
def test_mixing_steps_reach_the_constrained_optimum(spark, want, most):
    """Targets that need rates at the floor; of the second no mixture has the last one, and the way there is slow."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    n = rng.integers(1, 100, 200)
    t = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(200)], "doc_id long, tokens long, p array<double>")
    steps = mixing.solve(t, ["a", "b", "c"], dict(zip("abc", want, strict=True)), budget=1.0)
    r = np.array([x[1] for x in sorted(t.select("doc_id", mixing.rate(steps, 0.0)).collect())])
    assert np.allclose(r, mixing.rates(p, steps, 0.0))
    w = n / n.sum()
    m = (p * w[:, None]).T @ p
    value = lambda r: (lambda d: d @ np.linalg.solve(m, d))(p.T @ (w * r) - np.array(want))
    plain = np.ones(200)
    for _ in range(100):
        plain = np.maximum(0, plain - p @ np.linalg.solve(m, p.T @ (w * plain) - np.array(want)))
    assert (r >= 0).all() and (r == 0).any() and value(r) < most and value(r) <= value(plain) + 1e-9


def test_mixing_odd_rows_and_nothing_labelled(spark, odd, empty):
    labelled = spark.createDataFrame([(1, "a"), (11, "b"), (None, "a"), (3, None)], "doc_id long, domain string")
    for docs, known in ((odd, labelled), (odd, labelled.limit(0)), (empty, labelled)):
        table_, model, names, steps = mixing.rated(docs, known, {"a": 0.5, "b": 0.5}, floor=1.0)
        got = mixing.repeated(docs, model, names, steps, floor=1.0)
        assert got.columns == docs.columns
        assert set(map(tuple, got.collect())) == set(map(tuple, docs.collect()))  # no rate under 1
        assert table_.count() == docs.count()


def test_mixing_learns_every_domain(spark):
    """70 domains, each with words of its own: all are learnt, and a target of the last one is met."""
    domains = [f"d{k:02}" for k in range(70)]
    rows = [(4 * k + j, prose(100 + k, 30, 12), d) for k, d in enumerate(domains) for j in range(4)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows], "doc_id long, domain string")
    table_, _, names, steps = mixing.rated(docs, labelled, dict.fromkeys(domains[:-1], 1.0) | {domains[-1]: 5.0})
    assert names == domains
    rated = {r.doc_id: r.rate for r in table_.select("doc_id", mixing.rate(steps, 0.0).alias("rate")).collect()}
    assert min(rated[276 + j] for j in range(4)) > 3 * max(rated[j] for j in range(276))


# --- embeddings -----------------------------------------------------------------------------------------------------


def vectors(seed=1, groups=60, d=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = rng.normal(size=d)
        out += [(c + rng.normal(size=d) * rng.uniform(0, 0.35)).astype(np.float32) for _ in range(rng.integers(1, 8))]
    out += [out[0]] * 30
    return np.array(out)


def brute(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    comp = np.arange(len(x))
    if len(a):
        node, root = C.merged(a, b)
        comp[node] = root
    return near.sum(1), comp


@pytest.mark.parametrize("small_leaves", [False, True])
def test_embeddings(spark, monkeypatch, small_leaves):
    if small_leaves:
        monkeypatch.setattr(embedding_dedup, "DEAL", 60)
        monkeypatch.setattr(embedding_dedup, "LEAF", 60)
    x = vectors()
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = sorted(embedding_dedup.near_vectors(rows).collect())
    n, comp = brute(x)
    links = np.array([r.n_links for r in got])
    assert (links <= n).all() and links.sum() >= (0.95 if small_leaves else 0.99) * n.sum()
    if not small_leaves:
        assert [r.component_id for r in got] == comp.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def crowded(seed=3, d=32):
    """Distinct vectors: a hot group of a third of them, which all link, another that half links with it, and others near and far."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    noise = lambda n: unit(rng.normal(size=(n, d)))
    a = noise(1)
    b = unit(a + 0.6 * noise(1))
    x = [0.97 * a + 0.24 * noise(1000), 0.96 * b + 0.28 * noise(400), a + 0.9 * noise(400), noise(1200)]
    return np.concatenate(x).astype(np.float32), 1400


@pytest.mark.parametrize("leaf", [20_000, 300])
def test_embeddings_hot_group(spark, monkeypatch, leaf):
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    x, hot = crowded()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(embedding_dedup.near_vectors(rows).collect())
    n, comp = brute(x)
    links = np.array([r.n_links for r in got])
    assert n[:1000].min() > 900
    assert (links[:hot] == n[:hot]).all() and (links <= n).all() and links.sum() >= 0.999 * n.sum()
    assert [r.component_id for r in got] == comp.tolist()


def test_embeddings_leaf_in_blocks(spark, monkeypatch):
    """However small the blocks that a leaf is dealt in, the same links are found and counted."""
    monkeypatch.setattr(embedding_dedup, "DEAL", 60)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors(2, 300))], "vec_id long, embedding array<float>")
    want = sorted(embedding_dedup.near_vectors(rows).collect())
    monkeypatch.setattr(embedding_dedup, "LEAF", 20)
    assert sorted(embedding_dedup.near_vectors(rows).collect()) == want


def test_embeddings_large_leaf_counts_all(spark, monkeypatch):
    """A single leaf over the bound: n_links is exact."""
    monkeypatch.setattr(embedding_dedup, "MAX_DEPTH", 0)
    rng = np.random.default_rng(8)
    x = (np.repeat(rng.normal(size=(400, 16)), 55, axis=0) + 0.25 * rng.normal(size=(22_000, 16))).astype(np.float32)
    got = sorted(embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect())
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(u[a : a + 500] @ u.T >= 0.9).sum(1) - 1 for a in range(0, len(u), 500)])
    links = np.array([r.n_links for r in got])
    assert links.sum() == want.sum() and (links == want).all()


def test_embeddings_of_several_lengths(spark):
    """Each length has its links: two with over DEAL vectors, two with few."""
    sets = [vectors(4, 250), vectors(5, 200, 24), vectors(6, 20, 8), np.array([[1.0], [2.0], [-1.0]], np.float32)]
    assert [len(x) > embedding_dedup.DEAL for x in sets] == [True, True, False, False]
    rows = [v.tolist() for x in sets for v in x]
    got = sorted(embedding_dedup.near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")).collect())
    at = np.cumsum([0] + [len(x) for x in sets])
    for x, first in zip(sets, at, strict=False):
        n, comp = brute(x)
        mine = got[first : first + len(x)]
        assert [r.component_id for r in mine] == (comp + first).tolist()
        assert sum(r.n_links for r in mine) >= 0.99 * n.sum() and (np.array([r.n_links for r in mine]) <= n).all()


def test_embeddings_sql(spark, duck):
    from ..compare import duck_rows, rows_of

    assert rows_of(embedding_dedup.query(spark, SMALL)) == duck_rows(duck, embedding_dedup.sql())


def test_embeddings_sql_of_a_table_with_links(spark, tmp_path):
    """More vectors than a leaf is dealt, with links and groups: the query goes through its trees and equals the SQL."""
    import duckdb

    from ..compare import duck_rows, rows_of

    x = vectors(11, 400, 64)
    assert len(x) > 2 * embedding_dedup.DEAL
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    rows.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck_rows(con, embedding_dedup.sql())
    assert sum(n for r, n in want[1].items() if int(r[want[0].index("n_links")]) > 0) > 500
    assert rows_of(embedding_dedup.query(spark, str(tmp_path))) == want


def test_embeddings_wide_vectors_are_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "DEAL", 60)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors(2, 100, 200))], "vec_id long, embedding array<float>")
    want, seen = sorted(embedding_dedup.near_vectors(rows).collect()), []
    monkeypatch.setattr(embedding_dedup, "LEAF_BYTES", 24 * 200 * 30)
    divide = embedding_dedup.Deal.divide
    monkeypatch.setattr(embedding_dedup.Deal, "divide", lambda self, sizes, most: seen.append(most) or divide(self, sizes, most))
    assert sorted(embedding_dedup.near_vectors(rows).collect()) == want and seen == [30]


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, []), (10, [0.0, 1.0]), (None, [1.0, 0.1]), (11, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("root", F.lit("?")).withColumn("key", F.lit("?"))
    got = Counter(map(tuple, embedding_dedup.near_vectors(df).collect()))
    want = Counter([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False), (11, 4, 1, False), (10, 0, 10, True)] + [(i, 0, i, True) for i in range(3, 10)])
    assert got == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


# --- URLs -----------------------------------------------------------------------------------------------------------


def judged(url, rules, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: f[:2], default=None)
    form = host.removeprefix("www.") + path.rstrip("/")
    return host, path, best and best[2], best[3] if best else "block" if form and form in listed else "allow"


@pytest.mark.parametrize("small", [200_000, 0])
def test_urls(spark, monkeypatch, small):
    monkeypatch.setattr(url_filter, "SMALL", small)
    listed = {"bad.example.org/x", "bad.example.org"}
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.COM/en/7?x#y", "http://example.com/en/", "http://example.com/en/71", "http://notexample.com/en/7", "http://com/en/x", "http://com", "http://net/de/8", "http://a.b.example.net/de/8x", "http://org/es/#f", "x://www.bad.example.org/x//", "http://bad.example.org?q", "http://bad.example.org/y", "http://É.com/en/É", "http://a..com/en/", "http://com.:80/en/", "http://" + "a." * 500 + "com/en/" + "z" * 5000, "http://a/b://c.com/en/"] * 3
    rows = spark.createDataFrame([(i, u, "?", "?", "!") for i, u in enumerate(urls)], "page_id long, url string, Host string, verdict string, `_rule.x` string")
    lists = url_filter.rules_table(spark).union(spark.createDataFrame([("exact", "block", x, "") for x in sorted(listed)], "kind string, verdict string, host string, path string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows, lists).collect()}
    assert got == {i: judged(u, url_filter.RULES, listed) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge(rows, lists.limit(0)).collect()} == {"allow"} and url_filter.judge(rows.limit(0), lists).count() == 0


@pytest.mark.parametrize("small", [200_000, 0])
def test_urls_entries_that_disagree(spark, monkeypatch, small):
    """Block wins, whatever the order of rows; of rules of one length the one with the longer host."""
    monkeypatch.setattr(url_filter, "SMALL", small)
    rows = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.com/y")], "page_id long, url string")
    lists = [("prefix", "allow", "a.com", "/x"), ("prefix", "block", "a.com", "/x"), ("exact", "allow", "b.com/y", ""), ("exact", "block", "b.com/y", ""), (None, None, None, None)]
    for order in (lists, lists[::-1]):
        got = url_filter.judge(rows, spark.createDataFrame(order, "kind string, verdict string, host string, path string")).collect()
        assert {(r.page_id, r.rule, r.verdict) for r in got} == {(1, "a.com/x", "block"), (2, None, "block")}


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    filt = url_filter.bloom(keys, 188)
    probe = spark.range(6000).select("id", F.concat(F.lit("k"), "id").alias("key")).select("id", *url_filter._places(188))
    hit = {r.id for r in probe.join(filt, "block").where(" and ".join(f"(w{i} & b{i}) <> 0" for i in range(4))).collect()}
    assert set(range(3000)) <= hit and len(hit) < 3000 + 300


def test_url_sql(spark, duck):
    from ..compare import duck_rows, rows_of

    assert rows_of(url_filter.query(spark, SMALL)) == duck_rows(duck, url_filter.sql())


# --- audio ----------------------------------------------------------------------------------------------------------


def test_audio_round_trip_of_odd_texts(spark, odd, empty):
    got = mpeg_audio.decoded(mpeg_audio.encoded(odd)).collect()
    texts = Counter((i, (t or "").encode()) for i, t in odd_rows())
    assert Counter((r.doc_id, bytes(r.payload[: r.n_bytes])) for r in got) == texts
    for r in got:
        assert len(r.payload) % 576 == 0 and set(r.payload[r.n_bytes :]) <= {255} and len(r.payload) >= 576
        assert r.meta.frames * 576 == len(r.payload) == r.meta.samples and r.meta.crc_bad == 0 and r.meta.crc_checked == r.meta.frames + 1 and len(r.meta.seek_offsets) == r.meta.frames
    assert mpeg_audio.decoded(mpeg_audio.encoded(empty)).count() == 0


def test_audio_query_digests(spark, odd, empty):
    """Every column against hashlib and zlib, and seek offsets against the stored bytes."""
    found = Counter()
    for i, t in odd_rows():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        media = mpeg_audio.store(payload, len(raw))
        found[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()] += 1
    got = mpeg_audio.digested(odd).collect()
    assert Counter(tuple(r)[:7] for r in got) == found
    for r in got:
        assert r.samples == r.payload_bytes and abs(r.duration_s - r.samples / r.sample_rate) < 1e-9 and f"duration={r.samples}/{r.sample_rate}s" in r.feature
        assert len(r.seek_offsets) * 576 == r.payload_bytes and r.seek_offsets[-1] + 648 + 128 == r.media_bytes and set(np.diff(r.seek_offsets)) <= {648}
    assert mpeg_audio.digested(empty).count() == 0


def frame(version, layer, bits, rate, mode=0, crc=False, pad=0, fill=0x55):
    word = 0x7FF << 21 | version << 19 | (4 - layer) << 17 | (not crc) << 16 | bits << 12 | rate << 10 | pad << 9 | mode << 6
    h = mpeg_audio.header(word)
    body = bytearray([fill]) * h.size
    body[:4] = struct.pack(">I", word)
    if crc and layer != 2:
        row = np.array([[body[2], body[3], *body[6 : 6 + h.side]]], np.uint8)
        body[4:6] = struct.pack(">H", int(mpeg_audio.crc16(row)[0]))
    return bytes(body), h


@pytest.mark.parametrize("version", [0, 2, 3])
@pytest.mark.parametrize("layer", [1, 2, 3])
def test_audio_variable_rates_damage_and_tags(version, layer):
    rng = random.Random(version * 10 + layer)
    data, want, bad = b"", [], 0
    lead = mpeg_audio.id3v2({"TITLE": "x" * 50})
    data += lead
    for i in range(60):
        f, h = frame(version, layer, rng.choice([5, 6, 9]), 1, crc=True, pad=rng.randint(0, 1))
        if i == 20:
            data += b"\xff\xfbgarbage" * 5
        if i == 40 and layer != 2:
            f = f[:7] + bytes([f[7] ^ 4]) + f[8:]
            bad += 1
        want.append(len(data))
        data += f
    data += b"TAG" + b"song".ljust(125, b"\0")
    s = mpeg_audio.parse(data)
    assert s.offsets == want and s.samples == 60 * h.samples and s.rate == h.rate and s.skipped == 45 and s.resyncs == 1
    assert (s.crc_checked, s.crc_bad) == ((60, bad) if layer != 2 else (0, 0)) and s.tags["TITLE"] == "x" * 50 and s.tags["id3v1_title"] == "song"


def test_audio_tables():
    f, h = frame(3, 3, 9, 0)
    vbri = bytearray(f)
    vbri[36:] = (b"VBRI" + struct.pack(">HHHII", 1, 0, 75, 9999, 2) + struct.pack(">HHHH", 2, 3, 2, 1) + struct.pack(">HH", 100, 200)).ljust(len(f) - 36, b"\0")
    s = mpeg_audio.parse(bytes(vbri) + f + f)
    assert (s.vbr, s.vbr_frames, s.vbr_bytes, s.toc, s.frames) == ("VBRI", 2, 9999, [300, 600], 2)
    crc = mpeg_audio.crc16(np.frombuffer(b"123456789", np.uint8)[None])
    assert int(crc[0]) == 0xAEE7  # the polynomial 0x8005 from 0xFFFF, most significant bit first
    for junk in (b"", b"\xff", b"\xff\xfb", b"\xff" * 100, bytes(range(256)) * 8, b"ID3\x04\0\0\x7f\x7f\x7f\x7f"):
        assert mpeg_audio.parse(junk).frames == 0


# --- the pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    from .test_text_operators import groups

    docs = C.load(spark, SMALL, "documents")
    scratch, held = C.Scratch(spark, "test-pipeline"), {"in": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = held[name] = scratch.table(stage(spark, docs, SMALL))
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in held.items()}
    assert ids["toxicity"] < ids["in"]
    rows = [(r.doc_id, r.text) for r in held["toxicity"].collect()]
    assert ids["ngram_join"] == {i for i, _, c in groups(rows, 5, 80, 100) if i == c}
    assert ids["suffix_dedup"] == ids["ngram_join"] == ids["mixing"] == ids["packing"]
    assert held["mixing"].columns == held["in"].columns
    packed = held["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).join(held["mixing"].groupBy("doc_id").count(), "doc_id")
    assert packed.where("n <> m * count").count() == 0
