"""Examples of each kind of user function, by Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def scaled(x: pd.Series) -> pd.Series:
    return x * 1.5


@F.pandas_udf(T.DoubleType())
def spread(x: pd.Series) -> float:
    """An aggregate: greatest less least. It shows the form; a group's values are one task's, and max - min of Spark has no such bound."""
    return float(x.max() - x.min())


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("at", T.IntegerType())]))
class Words:
    """A table function: the words of a text with their places."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split()):
            yield w, i


def z_scores(df: DataFrame, by: str, value: str) -> DataFrame:
    """df with z, each value's distance from its group's mean in standard deviations. Groups are summed before the shuffle."""
    stats = df.groupBy(F.col(by).alias("_by")).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return df.join(stats, F.col(by).eqNullSafe(F.col("_by"))).withColumn("z", (F.col(value) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))).drop("_by", "_mean", "_sd")


def smoothed(df: DataFrame, by: str, order: list[str], value: str, weight: float) -> DataFrame:
    """(by, last): each group's exponentially smoothed value after its last row. A group is one task's, so it must be bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({by: pdf[by].iloc[:1], "last": [pdf[value].ewm(alpha=weight, adjust=False).mean().iloc[-1]]})

    return df.select(by, *order, value).groupBy(by).applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, last double")
