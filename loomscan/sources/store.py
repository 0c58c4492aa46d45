"""A catalog of discovery results: Parquet tables by scope, and their replay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.functions import content, paths, url
from loomscan.sources.shared import remove


@dataclass
class Store:
    """Tables below a path, partitioned by scope.

    reads and writes are switched off on their own: without reads everything is
    discovered anew and written; without writes what is there is used and left alone.
    """

    spark: SparkSession
    path: str
    reads: bool = True
    writes: bool = True

    def write(self, table: str, rows: DataFrame, scope: str = "scope") -> None:
        """Replaces the scopes that occur in rows."""
        if self.writes:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(f"{self.path}/{table}")

    def clear(self, table: str, schema: str, scopes: DataFrame, scope: str = "scope") -> None:
        """Removes the partitions of scopes, one column, where the table has any of them."""
        if self.writes and self._there(table):
            held = self.spark.read.schema(schema).parquet(f"{self.path}/{table}").select(F.col(scope).alias("s")).distinct()
            for r in held.join(scopes.select(F.col(scope).alias("s")).distinct(), "s").toLocalIterator():
                name = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r["s"])
                remove(self.spark, f"{self.path}/{table}/{scope}={name}")

    def _there(self, table: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def read(self, table: str, schema: str | None = None) -> DataFrame | None:
        """The table, or None if it isn't there or reads are off; a table that may be empty needs its schema."""
        if not self.reads:
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{table}") if self._there(table) else None


def metadata(js: DataFrame, prepends: DataFrame, publics: DataFrame) -> DataFrame:
    """scope, kind, value: what a later run replays: addresses, prefixes and directories of the own origin, public paths.

    js: scan, url, start; prepends: scan, prefix; publics: scan, path.
    """
    scope = content.scope_name(F.col("scan"))
    urls = js.select(scope.alias("scope"), F.lit("url").alias("kind"), F.col("url").alias("value"))
    own = js.where(url.origin(F.col("url")) == url.origin(F.col("start"))).select(scope.alias("scope"), F.lit("prepend").alias("kind"), url.directory(F.col("url")).alias("value"))
    return urls.unionByName(own).unionByName(prepends.select(scope.alias("scope"), F.lit("prepend").alias("kind"), F.col("prefix").alias("value"))).unionByName(publics.select(scope.alias("scope"), F.lit("public").alias("kind"), F.col("path").alias("value"))).distinct()


def replayable(meta: DataFrame, wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """Scopes that need no discovery, and complete: whether all sources they restored are still stored.

    wanted: scope, path; sources: scope, path.
    """
    known = meta.where("kind = 'url'").select("scope").distinct()
    missing = wanted.join(sources, ["scope", "path"], "left_anti").select("scope", F.lit(True).alias("lost")).distinct()
    return known.join(missing, "scope", "left").select("scope", F.col("lost").isNull().alias("complete"))


def source_file(scope, path):
    """The relative place of a restored file, null where its path isn't safe."""
    safe = paths.safe_path(path)
    return F.when(safe.isNotNull(), F.concat(scope, F.lit("/sources/"), safe))
