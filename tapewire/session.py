"""Session settings the jobs rely on, and lineage cutting on shared storage."""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # pandas writes nanosecond timestamps; they arrive as epoch longs, which
    # functions.parse turns back into timestamps.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
}

#: While it is on, Spark removes the shuffle files of a query when this has ended.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Named where spark.checkpoint.dir was not given when the session started.
SHARED_DIR = "tapewire.shared.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED_DIR, None)
    if not folder:
        raise ValueError(
            "intermediate tables need a folder that the driver and all executors share: start the session with "
            f"spark.checkpoint.dir, or set {SHARED_DIR} on it"
        )
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system it belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass(frozen=True)
class Stored:
    """Rows written to the shared folder, until ``drop`` removes them."""

    rows: DataFrame
    path: str

    def drop(self) -> None:
        remove(self.rows.sparkSession, self.path)


def store(df: DataFrame) -> Stored:
    """Write ``df`` to the shared folder for several readers.

    Cuts the lineage and fixes values that another run might choose differently.
    A written table computes the rows once, where a checkpoint would do so twice,
    and later reads take only the columns they need. The shuffle files that led to
    the rows go with the write, and don't wait for the driver to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def durable(df: DataFrame) -> DataFrame:
    """``store`` for rows that a returned, not yet computed result goes on reading."""
    return store(df).rows
