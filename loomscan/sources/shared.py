"""Tables that are kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def keep(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def parts(spark: SparkSession) -> int:
    """Into how many parts rows are dealt whose work tells nothing of their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where there is none, one below the warehouse, or on a single machine a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="loomscan-") if context.master.startswith("local[") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return context.getCheckpointDir()


def size(spark: SparkSession, place: str) -> int:
    """The bytes of a file or folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Grown:
    """A table that grows by parts; a part is added without touching the others.

    Once `most` parts have come together they are written as one, so a row is written
    again about as often as the number of parts has digits.
    """

    def __init__(self, most: int = 12):
        self._levels: list[list[DataFrame]] = [[]]
        self._most = most

    def add(self, part: DataFrame) -> None:
        at = 0
        self._levels[0].append(part)
        while len(self._levels[at]) >= self._most:
            merged = keep(_union(self._levels[at]))
            self._levels[at] = []
            at += 1
            if at == len(self._levels):
                self._levels.append([])
            self._levels[at].append(merged)

    @property
    def empty(self) -> bool:
        return not any(self._levels)

    def table(self) -> DataFrame:
        return _union([p for level in reversed(self._levels) for p in level])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
