"""Toxicity by a counterfactually regularised classifier.

A logistic model on hashed words (see `linear`). Training also swaps the identity terms in labelled texts for others of
their kind and penalises the squared change of the score, so that naming a group is in itself no sign of toxicity.

Learnt from a bounded sample (PER_CLASS labelled documents of each label, by hash of their ids; texts over MOST_BYTES
are not learnt from); all texts are scored whole. Null and empty texts have no words and get the score of their form
alone. A null doc_id counts as not held out. With no labels, or one value only, the score is the base rate. Repeated rows
are scored alike; a document with labels that disagree counts as toxic; of rows that share an id the first text in order
is learnt from. Long texts are read in pieces that add up. An empty table gives an empty one. Other columns, whatever
their names, are left out of scores, and stay in the pipeline's stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import linear as L

PER_CLASS, MOST_BYTES = 5000, 1 << 18
FEATURES = 2_000
#: Terms that name groups of people, by kind; terms of a kind are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("black", "white", "asian", "latino"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
BIND = 4.0


def swapped(text: bytes, terms=IDENTITY_TERMS) -> bytes | None:
    """The text with each identity term replaced by the next of its kind; None if there is none."""
    after = {a.encode(): b.encode() for kind in terms for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}
    found = re.compile(rb"(?<![0-9A-Za-z\x80-\xff])(" + b"|".join(sorted(after, key=len, reverse=True)) + rb")(?![0-9A-Za-z\x80-\xff])", re.I)
    new, n = found.subn(lambda m: after.get(m[0].lower(), m[0]), text)
    return new if n else None


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[bytes], y: np.ndarray, weight: np.ndarray, *, terms=IDENTITY_TERMS, bind: float = BIND, most: int = FEATURES) -> L.Model:
    """The model of labelled texts; weight: how many each stands for."""
    if len(set(y.tolist())) < 2:
        rate = float(y.mean()) if len(y) else 0.0
        return L.Model(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((L.FORMS, 1)), np.array([np.log((rate + 1e-3) / (1 - rate + 1e-3))]), np.zeros(L.FORMS), np.ones(L.FORMS), np.zeros(0))
    chosen = L.choose(texts, y, most)
    x, form = L.sparse(texts, chosen)
    other = [(i, s) for i, t in enumerate(texts) if (s := swapped(t, terms)) is not None]
    twin = L.sparse([s for _, s in other], chosen)[0] if other else None
    w = weight / weight.sum()

    def loss(z, extra):
        return (w * (sigmoid(z[:, 0]) - y))[:, None], extra

    out = L.train(x, form, len(chosen), 1, loss, steps=250, rate=0.15, decay=2e-6, twin=twin, bind=bind, pairs=np.array([i for i, _ in other], np.int64))
    return L.Model(chosen, out[0], out[1], out[2], out[4], out[5], out[3])


def trained(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, terms=IDENTITY_TERMS, bind: float = BIND) -> L.Model:
    """The model from documents and labels (doc_id, toxic); bind: the weight of the penalty on swapped `terms`."""
    C.ready(docs.sparkSession)
    sample = L.labelled_sample(docs, labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)"), "toxic", per_class, most_bytes)
    return L.fitted(sample, partial(fit, terms=terms, bind=bind), ["toxic", "weight"])


def score(docs: DataFrame, model: L.Model) -> DataFrame:
    """doc_id and the score of each row's whole text."""
    C.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(L.scored(model, batch.column(1))[:, 0]))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(C.lean(run), "doc_id long, score double")


def held_out() -> "F.Column":
    return F.coalesce(C.crc_mod("doc_id", 5) == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: learnt from labelled rows whose crc32(doc_id) mod 5 is not 0; all documents scored."""
    docs = C.documents(spark, sf_dir, "doc_id", "text")
    model = trained(docs, C.load(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline, first: documents with a score of 0.5 or more go. The score is worked out beside the row itself."""
    model = trained(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "labels").where(~held_out()))
    return kept(docs, model)


def kept(docs: DataFrame, model: L.Model) -> DataFrame:
    """The rows, with all their columns, whose text scores under 0.5."""
    C.ready(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sigmoid(L.scored(model, batch.column(at))[:, 0]) < 0.5))

    return docs.mapInArrow(C.lean(run), docs.schema)
