"""Quality by ordinal regression with cumulative links on graded ratings.

P(grade >= j) is the sigmoid of a text's score less threshold j: one set of weights on hashed words (see `linear`) is
shared by all grades, and the thresholds are kept in order by learning the logarithms of their distances. From the tail
probabilities come the expected grade and the choice of documents: those with P(grade >= `level`) of at least 0.5.

Learnt from a bounded sample (PER_GRADE rated documents of each grade, by hash of their ids; texts over MOST_BYTES are
not learnt from); all texts are scored whole. Null and empty texts have no words and are graded by form alone. Grades
that no rating has take no part. With no ratings the expected grade is 0 and nothing is kept; with a single grade, that.
Repeated rows are graded alike; of ratings that disagree the highest counts; of rows that share an id the first text in
order is learnt from. Long texts are read in pieces that add up. An empty table gives an empty one. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import linear as L
from .toxicity import sigmoid

PER_GRADE, MOST_BYTES, FEATURES = 4000, 1 << 18, 12_000


def cuts(extra: np.ndarray) -> np.ndarray:
    """Ordered thresholds from a first one and logarithms of distances."""
    return np.concatenate((extra[:1], extra[0] + np.cumsum(np.exp(extra[1:])))) if len(extra) else extra


def fit(texts: list[bytes], grade: np.ndarray, weight: np.ndarray, *, most: int = FEATURES, steps: int = 250, decay: float = 2e-6) -> tuple[L.Model, np.ndarray]:
    """The model and the grades that it tells apart, in order."""
    grades, y = np.unique(grade, return_inverse=True) if len(grade) else (np.zeros(0, int), np.zeros(0, int))
    if len(grades) < 2:
        return L.Model(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((L.FORMS, 1)), np.zeros(1), np.zeros(L.FORMS), np.ones(L.FORMS), np.zeros(0)), grades
    chosen = L.choose(texts, y, most)
    x, form = L.sparse(texts, chosen)
    w = weight / weight.sum()

    def loss(z, extra):
        """Gradients of the mean -log P(grade), where P is the difference of neighbouring tails."""
        tail = sigmoid(z - cuts(extra)[None])
        tail = np.concatenate((np.ones((len(z), 1)), tail, np.zeros((len(z), 1))), 1)
        slope = tail * (1 - tail)
        row = np.arange(len(z))
        p = np.maximum(tail[row, y] - tail[row, y + 1], 1e-9)
        up, down = slope[row, y] / p * w, slope[row, y + 1] / p * w  # by the threshold below, and the one above
        by_cut = np.bincount(y, up, len(grades))[1:] - np.bincount(y + 1, down, len(grades) + 1)[1:-1]
        ge = np.empty_like(extra)
        ge[0] = by_cut.sum()
        for j in range(1, len(extra)):
            ge[j] = np.exp(extra[j]) * by_cut[j:].sum()
        return (down - up)[:, None], ge

    out = L.train(x, form, len(chosen), 1, loss, steps=steps, rate=0.15, decay=decay, extra=np.concatenate(([0.0], np.zeros(len(grades) - 2))))
    return L.Model(chosen, out[0], out[1], out[2], out[4], out[5], out[3]), grades


def trained(docs: DataFrame, ratings: DataFrame, *, per_grade: int = PER_GRADE, most_bytes: int = MOST_BYTES) -> tuple[L.Model, np.ndarray]:
    """The model from documents and ratings (doc_id, grade)."""
    C.ready(docs.sparkSession)
    sample = L.labelled_sample(docs, ratings.select("doc_id", F.col("grade").cast("int").alias("grade")), "grade", per_grade, most_bytes)
    return L.fitted(sample, fit, ["grade", "weight"])


def grade_documents(docs: DataFrame, model: L.Model, grades: np.ndarray, *, level: int) -> DataFrame:
    """doc_id, expected_grade, tail_prob = P(grade >= level), kept."""
    C.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cuts(model.extra)
        for batch in batches:
            n = batch.num_rows
            if len(grades) > 1:
                tail = sigmoid(L.scored(model, batch.column(1)) - cut[None])
                expected = grades[0] + tail @ np.diff(grades)
                above = np.searchsorted(grades, level)
                p = np.ones(n) if above == 0 else np.zeros(n) if above == len(grades) else tail[:, above - 1]
            else:
                only = float(grades[0]) if len(grades) else 0.0
                expected, p = np.full(n, only), np.full(n, float(len(grades) > 0 and only >= level))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "expected_grade", "tail_prob", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(C.lean(run), "doc_id long, expected_grade double, tail_prob double, kept boolean")


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of the labels: 0 for quality 0, 1 for quality 1 in a toxic text, 2 for quality 1 in others."""
    return labels.where("quality in (0, 1)").select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).cast("int").alias("grade"))


def held_out() -> Column:
    return F.coalesce(C.crc_mod("doc_id", 5) == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: learnt from rated rows whose crc32(doc_id) mod 5 is not 0; all documents graded."""
    docs = C.documents(spark, sf_dir, "doc_id", "text")
    model, grades = trained(docs, ratings(C.load(spark, sf_dir, "labels")).where(~held_out()))
    return grade_documents(docs, model, grades, level=1).select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_prob", "kept")
