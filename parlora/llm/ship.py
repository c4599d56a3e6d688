"""What Arrow functions need on the executors: this package's sources, files, and memory that is given back."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

_SENT: set[str] = set()
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the job once in an application (as ``--py-files`` would).

    Texts are long, so Arrow batches of the default 10,000 rows are made smaller; another setting is left alone.
    """
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, "1000")
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="parlora-src-"), "parlora_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)


def send(spark: SparkSession, path: str) -> str:
    """Send a local file of the driver to all executors; the name under which ``received`` finds it there."""
    name = os.path.basename(path)
    if (key := f"{spark.sparkContext.applicationId} {path}") not in _SENT:
        spark.sparkContext.addFile(path)
        _SENT.add(key)
    return name


def received(name: str) -> str:
    """The path of a sent file where this runs."""
    return SparkFiles.get(name)


def give_back() -> None:
    """Return freed memory to the system; workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
