"""Intermediate tables in the folder that driver and executors share.

A multi-pass operator writes what a later pass reads again as Parquet under
``spark.checkpoint.dir`` (on one machine the warehouse where that is unset): lineage ends there, so a lost
executor costs one pass at most, and the shuffle files of the finished pass are released.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of one Arrow batch at most: texts are long, and a batch is held several times on its way to Python and back.
ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ROWS; a setting that is lower stays."""
    have = int(spark.conf.get(_ROWS))
    if have <= 0 or have > ROWS:
        spark.conf.set(_ROWS, ROWS)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine the warehouse will do where it is unset."""
    if (root := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir")


class Stage:
    """Tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        small_batches(spark)
        self.path = f"{shared_folder(spark).rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table that was written."""
        path, before = f"{self.path}/{name}", self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them; a session that has ended is no error."""
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  at exit the JVM may be gone
            pass


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of these has, in any case."""
    used = {c.lower() for c in taken}
    while name in used:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    """How many blocks and buckets to deal rows into: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and k, the text's 128-bit digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("k"))


def blocks(spark: SparkSession) -> int:
    """Blocks are smaller than partitions, as a pass holds several numbers for each of a block's words."""
    return 2 * parts(spark)


def buckets(spark: SparkSession) -> int:
    """Buckets of a tally hold several partitions' worth of keys: blocks x buckets rows pass between them."""
    return (parts(spark) + 1) // 2


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row per distinct text: block, k, m (its smallest doc_id), text.

    Copies are folded before the shuffle, so a text that fills a third of the rows sends one
    row per task.
    """
    reps = keyed(docs).groupBy("k").agg(F.min("doc_id").alias("m"), F.first("text").alias("text"))
    return reps.select(F.pmod(F.xxhash64("k"), F.lit(blocks(docs.sparkSession))).cast("int").alias("block"), "k", "m", "text")
