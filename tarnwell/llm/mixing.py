"""Mixing documents to target weights of domains, by soft membership.

A softmax classifier on hashed words (see `linear`), learnt from a labelled table (doc_id, domain), gives each text its
domain posteriors p. The rates r >= floor that minimise the whitened squared distance of the expected token totals
S = sum(w r p), w being a text's share of all tokens, from the targets are found by projected gradient:

    r' <- max(floor, y - p . inverse(M) (S - T)),    y <- r' + b (r' - r),    M = sum(w p p')

with S at y and b growing from 0 towards 1 (the accelerated form). In this metric the gradient's Lipschitz constant is at
most 1, so no step length has to be sought, and with no rate at the floor one step is exact. The only thing that is gathered in a step is S, one number for each domain; a rate is worked out from
the text's own posteriors and the steps so far, so no table of rates is kept. It ends after STEPS steps, or when no
total moves by more than TOLERANCE of all tokens.

A rate is the expected number of copies: its whole part, and one more if a hash of the id falls under the rest. With no
budget given, all totals are raised just so far that no domain has to be thinned out.

Tokens are words between white space. Null and empty texts have none, no influence on the totals, and the rate that
their form's posteriors give. Domains without a target have target 0; targets of domains that no labelled row has are
left out, and the others keep their proportions. With no labelled rows, or no tokens, all rates are 1. A null doc_id is
dealt like any other value. Repeated rows have the same rate and, with the same id, the same number of copies; of
posteriors that tie the first domain in order is named; a document with several domains counts for the last in order.
Long texts are read in pieces that add up. An empty table gives an empty one. Other columns, whatever their names, take
no part, and the stage keeps them. Training uses a bounded sample (PER_DOMAIN labelled documents of each domain, none over
MOST_BYTES); scoring and totals cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import linear as L

PER_DOMAIN, MOST_BYTES, FEATURES = 1500, 1 << 18, 6000
STEPS, TOLERANCE = 40, 1e-4
#: Steps after which the rows' rates so far are written, rather than worked out again.
KEEP = 8
#: The queries' targets: documents of good quality by language, and those of low quality in any.
TARGETS = {"en": 0.38, "de": 0.18, "fr": 0.18, "es": 0.15, "low": 0.11}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[bytes], domain: np.ndarray, weight: np.ndarray) -> tuple[L.Model, list[str]]:
    """The model and its domains in order."""
    names, y = np.unique(domain.astype(str), return_inverse=True) if len(domain) else (np.zeros(0, str), np.zeros(0, int))
    k = max(1, len(names))
    if len(names) < 2:
        return L.Model(np.zeros(0, np.int64), np.zeros((0, k)), np.zeros((L.FORMS, k)), np.zeros(k), np.zeros(L.FORMS), np.ones(L.FORMS), np.zeros(0)), names.tolist()
    chosen = L.choose(texts, y, FEATURES)
    x, form = L.sparse(texts, chosen)
    w = (weight / weight.sum())[:, None]
    hot = np.eye(k)[y]
    out = L.train(x, form, len(chosen), k, lambda z, extra: (w * (softmax(z) - hot), extra), steps=120, rate=0.2, decay=1e-5)
    return L.Model(chosen, out[0], out[1], out[2], out[4], out[5], out[3]), names.tolist()


def trained(docs: DataFrame, labelled: DataFrame) -> tuple[L.Model, list[str]]:
    """The classifier from documents and labelled (doc_id, domain)."""
    C.ready(docs.sparkSession)
    # Labels of documents that are not there, as those that earlier stages took out, don't use up the sample.
    labelled = labelled.join(docs.select("doc_id"), "doc_id", "left_semi")
    return L.fitted(L.labelled_sample(docs, labelled.select("doc_id", F.col("domain").cast("string").alias("domain")), "domain", PER_DOMAIN, MOST_BYTES), fit, ["domain", "weight"])


def posteriors(model: L.Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its tokens and its posteriors."""
    z, n = L.scored_words(model, column)
    return n, softmax(z)


def tabled(docs: DataFrame, model: L.Model) -> DataFrame:
    """doc_id, tokens and posteriors (array<double>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p = posteriors(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["doc_id", "tokens", "p"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(C.lean(run), "doc_id long, tokens long, p array<double>")


Step = tuple[np.ndarray, float]


def folded(steps: list[Step], floor: float, begin: Column | None = None) -> Column:
    """A row's rate r, and the point y of the next gradient, from its posteriors `p` after the steps, from `begin` on."""
    zero = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")) if begin is None else begin
    if not steps:
        return zero
    each = F.array(*(F.struct(F.array(*(F.lit(float(x)) for x in g)).alias("g"), F.lit(float(b)).alias("b")) for g, b in steps))
    move = lambda g: F.aggregate(F.zip_with("p", g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def step(s: Column, x: Column) -> Column:
        new = F.greatest(F.lit(float(floor)), s["y"] - move(x["g"]))
        return F.struct(new.alias("r"), (new + x["b"] * (new - s["r"])).alias("y"))

    return F.aggregate(each, zero, step)


def rate(steps: list[Step], floor: float) -> Column:
    """A row's rate from its posteriors `p`."""
    return folded(steps, floor)["r"]


def rates(p: np.ndarray, steps: list[Step], floor: float) -> np.ndarray:
    """The same for rows of posteriors."""
    r = y = np.ones(len(p))
    for g, b in steps:
        new = np.maximum(floor, y - p @ g)
        r, y = new, new + b * (new - r)
    return r


def solve(table: DataFrame, names: list[str], targets: dict[str, float], *, budget: float | None = None, floor: float = 0.0) -> list[Step]:
    """The steps that lead to the rates; each is one sum over the table. Where rows stand is written every KEEP steps."""
    k = len(names)
    if k < 2:
        return []
    col = lambda i: F.element_at("p", i + 1)
    t = F.col("tokens").cast("double")
    total, *sums = table.agg(F.sum(t), *(F.sum(t * col(i)) for i in range(k)), *(F.sum(t * col(i) * col(j)) for i in range(k) for j in range(i, k))).first()
    if not total:
        return []
    natural = np.array(sums[:k]) / total
    m = np.zeros((k, k))
    for (i, j), x in zip(((i, j) for i in range(k) for j in range(i, k)), sums[k:], strict=True):
        m[i, j] = m[j, i] = x / total
    want = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    if not want.sum():
        return []
    want /= want.sum()
    factor = budget if budget is not None else max(natural[i] / want[i] for i in range(k) if want[i] > 0)
    inverse = np.linalg.pinv(m, rcond=1e-9)
    steps: list[Step] = []
    s, old, pace = natural, natural, 1.0
    scratch, stand, done = C.Scratch(table.sparkSession, "mixing-steps"), None, 0
    table = table.select("tokens", "p")
    for _ in range(STEPS):
        after = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        steps.append((inverse @ (s - want * factor), (pace - 1) / after))
        pace = after
        if len(steps) - done > KEEP:
            new = scratch.table(table.select("tokens", "p", folded(steps[done:-1], floor, stand).alias("stand")))
            if stand is not None:
                scratch.drop(table)
            table, stand, done = new, F.col("stand"), len(steps) - 1
        x = folded(steps[done:], floor, stand)
        found = np.array(table.select("tokens", "p", x.alias("x")).agg(*(F.sum(t * F.col(f"x.{n}") * col(i)) for n in ("r", "y") for i in range(k))).first()) / total
        new, s = found[:k], found[k:]
        moved, old = np.abs(new - old).max(), new
        if moved < TOLERANCE:
            break
    return steps


def chance() -> Column:
    """A number from 0 to 1 that an id always has."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(29), "doc_id"), 11) / F.lit(float(1 << 53))).cast("double")


def rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **limits) -> tuple[DataFrame, L.Model, list[str], list[Step]]:
    """The table of posteriors, the model, its domains, and the steps."""
    spark = C.ready(docs.sparkSession)
    model, names = trained(docs, labelled)
    table = C.Scratch(spark, "mixing").table(tabled(docs, model))
    return table, model, names, solve(table, names, targets, **limits)


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Domains of the labelled documents: `low` for quality 0, else the language."""
    rows = labels.where("quality in (0, 1)").select("doc_id", "quality").join(docs.select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", F.when(F.col("quality") == 0, F.lit("low")).otherwise(F.col("lang")).alias("domain"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: for each document its tokens, most likely domain and its posterior, rate and copies."""
    docs = C.documents(spark, sf_dir, "doc_id", "text", "lang")
    table, _, names, steps = rated(docs, labelled_domains(docs, C.load(spark, sf_dir, "labels")), TARGETS)
    best = F.array_max("p")
    table = table.withColumn("rate", rate(steps, 0.0)).withColumn("domain", F.element_at(F.array(*(F.lit(n) for n in names or [""])), F.array_position("p", best).cast("int")))
    return table.select("doc_id", "tokens", "domain", best.alias("posterior"), "rate", F.floor(F.col("rate") + chance()).cast("long").alias("copies"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each row as many times as its copies say. No rate is under 1, so no document is lost."""
    whole = C.load(spark, sf_dir, "documents")
    _, model, names, steps = rated(docs, labelled_domains(whole, C.load(spark, sf_dir, "labels")), TARGETS, floor=1.0)
    return repeated(docs, model, names, steps, floor=1.0)


def repeated(docs: DataFrame, model: L.Model, names: list[str], steps: list[Step], *, floor: float) -> DataFrame:
    """The rows by their copies. Posteriors are worked out again beside the rows rather than joined to them."""
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p = posteriors(model, batch.column(at))
            copies = np.floor(rates(p, steps, floor) + batch.column(width).to_numpy()).astype(np.int64)
            rows = batch.select(list(range(width)))
            for a in range(0, len(copies), 64):
                yield rows.slice(a, 64).take(pa.array(np.repeat(np.arange(len(copies[a : a + 64])), copies[a : a + 64])))

    return docs.withColumn(C.fresh(docs, "_chance"), chance()).mapInArrow(C.lean(run), docs.schema)
