"""The corpus pipeline: each stage works on all that the one before it kept.

Toxic documents go; of each group of near duplicates one stays; repeated passages are cut out of texts; documents are
copied to bring domains to their target weights; what results is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm import common, mixing, ngram_join, packing, suffix_dedup, toxicity

STAGES = [
    ("toxicity", toxicity.toxicity_stage),
    ("ngram_join", ngram_join.near_stage),
    ("suffix_dedup", suffix_dedup.cut_stage),
    ("mixing", mixing.mix_stage),
    ("packing", packing.pack_stage),
]
#: SQL can't express the stages; each is tested against a brute-force version or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = common.load(spark, sf_dir, "documents")
    scratch = common.Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs)
    return docs
