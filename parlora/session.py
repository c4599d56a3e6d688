"""A session with the settings that results depend on, and what its executors need: sources and a shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()
_FOLDERS: dict[str, str] = {}


def session(app: str = "parlora", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings stay the cluster's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_sources(df: DataFrame) -> DataFrame:
    """``df``, after this package was sent to the executors of its session, once, for Python functions over it."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SENT:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="parlora-src-")) / "parlora_core.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        context.addPyFile(str(path))
        _SENT.add(context.applicationId)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one of ``spark.checkpoint.dir``, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if app not in _FOLDERS:
        _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="parlora-")
    return _FOLDERS[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, until the application ends, and read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/parlora/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
