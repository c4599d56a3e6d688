"""Tables written to the folder that all executors share.

Iterative jobs cut their lineage by writing a Parquet table there and reading it back. The folder is the one the
cluster names in ``spark.checkpoint.dir``; a private one is made only in local mode without that setting (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}

#: Ids up to which a filter by them is broadcast (about 100 MB).
BROADCAST_IDS = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="parlora-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and return a reader of the copy.

    The copy is removed by ``discard``, or else when the application ends. Empty frames come back empty, with the same
    schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parlora/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the copy behind a frame of ``materialize`` that nothing reads any more."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def only(source: DataFrame, ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``source`` without rows whose ``doc_id`` isn't in ``ids(doc_id)``, or ``source`` as it is beyond ``most`` ids.

    It goes before a join with the same ids, which is right without it, so that rows without a partner aren't shuffled.
    """
    if ids.limit(most + 1).count() > most:
        return source
    return source.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
