"""Shared working folders: intermediate tables live where every executor can read them."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session (tests, a single machine) takes a temporary folder; on a
    cluster that folder would be another one on every machine, so this is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root()
    return root.rstrip("/")


@lru_cache(maxsize=1)
def _local_root() -> str:
    """A folder of this process, removed at its end."""
    root = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


class Workspace:
    """Tables written once and reread, so that lineage is cut by storage that outlives executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._marked = False

    def save(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """Write ``df`` and return the written table.

        ``narrow`` tables hold ids, pairs or counts instead of texts or postings: an eighth of the
        session's partitions is enough for them, and as many fewer files are made and opened.
        """
        at = f"{self.path}/{name}"
        if narrow:
            df = df.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        if not self._marked:  # results may read their tables until the session ends; then they go
            path = self._path(self.path)
            self._marked = bool(self._fs(path).deleteOnExit(path))
        return self.spark.read.schema(df.schema).parquet(at)

    def _path(self, at: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            at = self._path(f"{self.path}/{name}")
            self._fs(at).delete(at, True)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of jobs whose frames are gone."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, columns_bytes: int | None = None, limit_bytes: int = 16 << 20) -> bool:
    """Whether a written table stays below the limit: the check before a broadcast.

    Rows of a fixed width of ``columns_bytes`` are counted, up to the limit; without it, where rows
    hold texts, lists or maps, the bytes of all rows are summed.
    """
    if columns_bytes is None:
        size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16).alias("size")).first().size
        return (size or 0) <= limit_bytes
    most = max(1, limit_bytes // max(1, columns_bytes))
    return df.limit(most + 1).count() <= most
