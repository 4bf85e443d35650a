"""Session settings and folders that the operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where sessions on one machine (tests) keep their tables if no folder is set.
_LOCAL_ROOT = "/tmp/brindle-shared"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch at most.
BATCH_BYTES = 8 << 20
#: Rows of an ORC batch as read and as written: whole texts or their ids are long rows.
ORC_READ_ROWS, ORC_WRITE_ROWS = 256, 128
_BATCH_SETTINGS = {
    _BATCH_SETTING: BATCH_BYTES,
    "spark.sql.orc.columnarReaderBatchSize": ORC_READ_ROWS,
    "spark.sql.orc.columnarWriterBatchSize": ORC_WRITE_ROWS,
}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one process may leave it unset; on a cluster a
    folder of the machine would be another one on every executor, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (root or _LOCAL_ROOT).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut by reliable checkpoint files."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and ORC batches by rows, for the session, unless it says how far itself.

    An Arrow batch is held by the executor's JVM and, two at a time, by its Python worker: by default
    up to 64 MB of texts each.  An ORC batch of lists is one array of eight bytes an entry: by default
    4,096 rows of it.  What operators return doesn't depend on where batches end.
    """
    own = spark.conf.getAll
    for name, most in _BATCH_SETTINGS.items():
        if name not in own:
            spark.conf.set(name, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
