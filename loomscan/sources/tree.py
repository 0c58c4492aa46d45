"""Results as a tree of files: <path>/<scope>/{js,source_map,sources,html}/<file>, published by scope.

A write goes through three places, all below the path.  An attempt of a task writes into a
folder of its own; when all its rows are written it moves the files into the job's folder;
when all tasks are done the driver notes which scopes the job has and puts each one's new
folder in the place of the old one.  A task that dies leaves nothing but its own folder,
a job that is given up leaves the old tree as it was, and a driver that dies while it
publishes has left a note, after which `finish` (and the next write) go on.

    tree.register(spark)
    rows.write.format("results").mode("append").save(path)   # scope, slot, path, content

Two rows of one place: the later one to be moved stays; the query's own keys should be
distinct.  A job takes as many moves by the driver as it has scopes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from loomscan.functions import content, paths, url
from loomscan.sources import files

SLOTS = ("js", "source_map", "sources", "html")
SCHEMA = "scope string, slot string, path string, content binary"
#: The folder of a write that isn't done, and its note that all tasks are.
_JOB, _READY = "_job-", "ready.json"


def _safe(path: str | None) -> bool:
    return bool(path) and not path.startswith("/") and all(p not in ("", ".", "..") for p in path.split("/"))


@dataclass
class Placed(WriterCommitMessage):
    scopes: list


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, f"{_JOB}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Placed:
        system, root = files.at(self.path)
        own, new = f"{root}/{self.job}/attempt-{uuid.uuid4().hex}", f"{root}/{self.job}/new"
        made: set[str] = set()
        written: list[str] = []
        for batch in iterator:
            for scope, slot, path, data in zip(*(batch.column(c).to_pylist() for c in ("scope", "slot", "path", "content"))):
                if slot not in SLOTS or not _safe(scope) or "/" in scope or scope.startswith("_") or not _safe(path):
                    raise ValueError(f"no place in the tree: {scope!r}, {slot!r}, {path!r}")
                place = f"{scope}/{slot}/{path}"
                folder = place.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(f"{own}/{folder}", recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{own}/{place}") as out:
                    out.write(data or b"")
                written.append(place)
        for folder in made:
            system.create_dir(f"{new}/{folder}", recursive=True)
        for place in dict.fromkeys(written):
            system.move(f"{own}/{place}", f"{new}/{place}")
        files.remove(system, own)
        return Placed(sorted({p.partition("/")[0] for p in written}))

    def commit(self, messages: list[Placed | None]) -> None:
        system, root = files.at(self.path)
        scopes = sorted({s for m in messages if m for s in m.scopes})
        system.create_dir(f"{root}/{self.job}", recursive=True)
        _give_up(system, root, but=self.job)
        files.write_json(system, f"{root}/{self.job}/{_READY}", scopes)
        _publish(system, root, self.job)

    def abort(self, messages: list[Placed | None]) -> None:
        system, root = files.at(self.path)
        files.remove(system, f"{root}/{self.job}")


def _publish(system: fs.FileSystem, root: str, job: str) -> None:
    """Puts a job's scopes in place; what is in place already isn't in the job's folder any more."""
    for scope in json.loads(files.read(system, f"{root}/{job}/{_READY}")):
        new, now, old = f"{root}/{job}/new/{scope}", f"{root}/{scope}", f"{root}/{job}/old/{scope}"
        if files.exists(system, new):
            if files.exists(system, now):
                system.create_dir(f"{root}/{job}/old", recursive=True)
                system.move(now, old)
            system.move(new, now)
    files.remove(system, f"{root}/{job}")


def _give_up(system: fs.FileSystem, root: str, but: str = "") -> None:
    """Ends what earlier drivers left: jobs with a note are published."""
    for i in files.listed(system, root):
        if i.base_name.startswith(_JOB) and i.base_name != but and files.exists(system, f"{i.path}/{_READY}"):
            _publish(system, root, i.base_name)


def finish(path: str) -> None:
    """Publishes what a driver that died had begun to; a job without a note may still be going on and is left alone."""
    _give_up(*files.at(path))


class Results(DataSource):
    """The sink; what is written is read again with `stored`."""

    @classmethod
    def name(cls) -> str:
        return "results"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Results)


def save(rows: DataFrame, path: str) -> None:
    """Writes scope, slot, path, content (string or binary) as files; each scope that occurs is replaced as a whole."""
    register(rows.sparkSession)
    rows.select("scope", "slot", "path", F.col("content").cast("binary").alias("content")).write.format("results").mode("append").save(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """scope, slot, path and content of every file of the tree."""
    finish(path)
    system, root = files.at(path)
    kind = "scope string, slot string, path string, content binary"
    if not any(i.type == fs.FileType.Directory and not i.base_name.startswith("_") for i in files.listed(system, root)):
        return spark.createDataFrame([], kind)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path.rstrip('/')}/[!_]*").select(F.replace("path", F.lit("%20"), F.lit(" ")).alias("at"), "content")
    inner = F.regexp_replace(F.expr("substring_index(at, ':', -1)"), "^/+", "/")
    cut = F.substring(inner, F.lit(len(root) + 2), F.length(inner))
    part = F.split(cut, "/", 3)
    return found.select(part[0].alias("scope"), part[1].alias("slot"), part[2].alias("path"), "content")


def place(scope: Column, slot: str, path: Column, text: Column) -> list[Column]:
    """A file's columns; its path is null where it isn't safe."""
    return [scope.alias("scope"), F.lit(slot).alias("slot"), paths.safe_path(path).alias("path"), text.cast("binary").alias("content")]


def files_of(result, responses: DataFrame) -> DataFrame:
    """scope, slot, path, content of a ScanResult: its scripts and pages as they were answered, its maps and restored sources.

    A map is kept under its own address' path with a digest of the whole address before
    it, so that maps of other origins don't overwrite each other; a script under its
    host and path; a source under its path, and beside it by a digest of its map where
    two maps have the same path.
    """
    texts = responses.where("status between 200 and 299").select(url.normalize(F.col("url")).alias("url"), "text").dropDuplicates(["url"])
    scope = content.scope_name(F.col("scan"))
    js = result.js.select("scan", "url").distinct().join(texts, "url").select(*place(scope, "js", content.cache_name(F.col("url")), F.col("text")))
    html = result.html.select("scan", "url").distinct().join(texts, "url").select(*place(scope, "html", F.concat(content.flat_name(F.regexp_replace("url", "^[a-z]+://", "")), F.lit(".html")), F.col("text")))
    begun = result.js.select("scan", "start").distinct().withColumn("url", url.normalize(F.col("start"))).join(texts, "url").select(*place(scope, "html", F.lit("web.html"), F.col("text")))
    named = result.maps.where("map_url not like 'data:%'").select("scan", F.col("map_url").alias("url")).distinct().join(texts, "url")
    maps = named.select(*place(scope, "source_map", F.concat(F.substring(F.sha2("url", 256), 1, 12), F.lit("-"), content.map_prefix(F.col("url")), F.lit(".map")), F.col("text")))
    kept = result.sources.withColumn("path", paths.safe_path(F.col("path"))).where("path is not null")
    first = kept.groupBy("scan", "path").agg(F.min(F.struct("js_url", "map_url", "idx")).alias("m"))
    own = F.struct("js_url", "map_url", "idx") == F.col("m")
    beside = F.concat("path", F.lit("."), F.substring(F.sha2(F.concat_ws(" ", "js_url", "map_url", F.col("idx").cast("string")), 256), 1, 8))
    sources = kept.join(first, ["scan", "path"]).select(*place(scope, "sources", F.when(own, F.col("path")).otherwise(beside), F.col("content")))
    every = [js, html, begun, maps, sources]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out.where("path is not null and scope <> ''")
