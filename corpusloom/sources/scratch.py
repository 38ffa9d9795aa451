"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage by writing a table below
``spark.checkpoint.dir`` and reading it back, so a lost executor costs a
re-run of the tasks since the last table and no more.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[tuple[object, str]] = []
_LOCAL: dict[str, str] = {}  # application -> folder, where the session names none


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of this machine. On a
    cluster each executor would write to a disk of its own, so there it raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
            _FOLDERS.append((spark, _LOCAL[app]))
        root = _LOCAL[app]
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator run, each below its own new folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _FOLDERS.append((spark, self.path))

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and return a DataFrame that reads it."""
        self._n += 1
        path = f"{self.path}/t{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            _delete(self.spark, t._scratch_path)


@atexit.register
def _clean() -> None:
    for spark, path in _FOLDERS:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone, and then its folder is the cluster's to clean
            return
