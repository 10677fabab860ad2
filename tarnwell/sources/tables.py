"""Reading and writing tables. Readers take explicit schemas where a format has none of its own."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Columns and filters chosen later reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bounds of the Arrow batches that Python gets, set unless the caller has set others: (setting, Spark's default, ours).
_ARROW = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "500"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16m"))


def ready(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, for Python functions that use it, and bounds the Arrow batches that these get."""
    for name, default, ours in _ARROW:
        if spark.conf.get(name, default) in (default, default.removesuffix("b"), "64MB", "64m", ours):
            spark.conf.set(name, ours)
    sc = spark.sparkContext
    if not getattr(sc, "_tarnwell_base_sent", False):
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="tarnwell-"), "tarnwell-base.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(top, "tarnwell")):
                for x in names:
                    if x.endswith(".py"):
                        z.write(os.path.join(folder, x), os.path.relpath(os.path.join(folder, x), top))
        sc.addPyFile(path)
        sc._tarnwell_base_sent = True
    return spark


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Makes tables visible to SQL as temporary views."""
    for name in names or TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def read(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A file source by name: parquet, orc, csv, json, text, xml. No schema is ever guessed for csv or json."""
    if fmt in ("csv", "json", "xml") and schema is None:
        raise ValueError(f"{fmt} needs a schema: guessing one reads all data twice")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: str) -> None:
    """A file sink by name, in folders by the values of partition_by, if any."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def save_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Saves a table whose rows lie in buckets by `keys`, sorted within, and returns it: joins on the keys of tables with as many buckets need no exchange.

    The files are in the shared folder; the table's name goes from the catalog when Python ends. The rows are dealt by the
    keys first, so each bucket is one file.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)

    def drop() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session has ended
            pass

    atexit.register(drop)
    return spark.table(table)


def replace_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Writes rows into folders by the values of partition_by; folders that get rows are replaced whole, all others stay.

    So a run that is repeated, after a failure or with corrected rows, leaves no rows twice.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir; it goes when Python ends.

    With no such setting a local session uses a folder of its own, and any other is an error.
    """
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = os.path.join(tempfile.gettempdir(), "tarnwell-files")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            pass

    atexit.register(clear)
    return path


def read_jdbc(spark: SparkSession, url: str, table: str, *, column: str, lower: int, upper: int, parts: int, **properties: str) -> DataFrame:
    """A database table, read by `parts` tasks that share out the range of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=properties)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "errorifexists", **properties: str) -> None:
    df.write.jdbc(url, table, mode=mode, properties=properties)


#: Spark's own setting that removes an execution's shuffle files at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back: lineage ends there, and any executor can read it again.

    Shuffle files behind it go once it is written; `dropped` removes it when nothing reads it any more.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    old = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables that `written` gave."""
    for t in tables:
        spark = t.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._written_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
