"""What the package needs of a session: its modules on the executors, and tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Tables that this process has written to the shared folder.
_PATHS: list[str] = []


class _Passing(threading.local):
    """For each thread the tables of the ``passing`` blocks it is in."""

    def __init__(self):
        self.blocks: list[list[str]] = []


_PASSING = _Passing()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors through Spark, once for each context, so that workers can import them."""
    sc = spark.sparkContext
    if getattr(sc, "_splitproof_sent", False):
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():
        return
    target = os.path.join(tempfile.mkdtemp(), "splitproof.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._splitproof_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, one of our own (a local session only)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return folder


def scratch(spark: SparkSession, label: str, lasting: bool = False) -> str:
    """A new path in the shared folder; what is written there goes with ``forget``, or, unless it is ``lasting``, at the end of ``passing``."""
    path = f"{shared_folder(spark)}/splitproof/{label}-{uuid.uuid4().hex}"
    (_PATHS if lasting or not _PASSING.blocks else _PASSING.blocks[-1]).append(path)
    return path


def written(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """The frame as a table in the shared folder, read again: lineage ends there, and lost executors cost only the tasks that read it."""
    path = scratch(df.sparkSession, label, lasting)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._splitproof_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def erase(table: DataFrame) -> None:
    """Deletes a table that ``written`` gave, once all that reads it is written itself."""
    path = table._splitproof_path
    for paths in (_PATHS, *_PASSING.blocks):
        if path in paths:
            paths.remove(path)
    _delete(table.sparkSession, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside, but for lasting ones, are deleted at the end: for work whose result is written before that."""
    _PASSING.blocks.append([])
    try:
        yield
    finally:
        for path in _PASSING.blocks.pop():
            _delete(spark, path)


def forget(spark: SparkSession) -> int:
    """Deletes the tables that this process has written, once no frame that reads them is needed any more; gives their number."""
    n = len(_PATHS)
    while _PATHS:
        _delete(spark, _PATHS.pop())
    return n
