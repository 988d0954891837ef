"""Where the operators of this subpackage cut lineage, and how they read their tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import ensure_checkpoint_dir, materialise, shared_folder, table

__all__ = ["discard", "ensure_checkpoint_dir", "in_batches", "materialise", "shared_folder", "table", "written"]

#: Bytes of the Arrow batches of texts that go to Python, about. Spark counts rows by default, and 10,000 texts are of any size.
BATCH_BYTES = 1 << 21
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, for mapInArrow(): its session bounds the bytes of Arrow batches from now on, unless the user has set a bound."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which takes less room than a checkpoint; it goes when the session's JVM ends."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table whose rows nothing needs any more, also not to recover from a lost executor."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
