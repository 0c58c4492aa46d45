"""Captured exchanges as a data source: recorded requests and their responses, read and written by Spark.

A recording is a folder of files with one exchange a line, as JSON.  Its partitions are
byte ranges of these files, so a large file is read by many tasks.  Writing sorts nothing;
it notes for each block of a file its least and greatest address and its methods in a
manifest, which the driver writes once all tasks are done.  Blocks that a filter on url or
method rules out are no partitions at all.  Files without a manifest, from elsewhere, are
read by ranges too, each line by the task whose range it begins in.

    captures.register(spark)
    responses.repartitionByRange("url").write.format("exchanges").mode("append").save(path)
    spark.read.format("exchanges").schema("url string, status int").load(path).where("url like 'https://a.test/%'")

Only the columns of the given schema are taken from the lines.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomscan.sources import files

SCHEMA = "url string, method string, status int, content_type string, text string, final_url string, headers map<string,string>, request string, error string"
#: Bytes of a block, and rows of a batch.
BLOCK, BATCH = 4 << 20, 512
_MANIFEST = "_manifest-"


@dataclass
class Block(InputPartition):
    """Bytes of a file; whole: begins with a line and ends with one."""

    path: str
    start: int
    length: int
    whole: bool


@dataclass
class Written(WriterCommitMessage):
    blocks: list


def _column(f: Filter) -> str | None:
    """The column that a filter is about, if it is one of one column."""
    names = getattr(f, "attribute", ())
    return names[0] if len(names) == 1 else None


def _may_hold(block: dict, f: Filter) -> bool:
    """Whether rows of a block may meet a filter."""
    if _column(f) == "method":
        return not isinstance(f, (EqualTo, EqualNullSafe, In)) or any(v in block["methods"] for v in (f.value if isinstance(f, In) else (f.value,)))
    low, high = block["low"], block["high"]
    if low is None or isinstance(f, (IsNull, IsNotNull)):
        return isinstance(f, IsNull) or low is not None  # without addresses there is nothing to compare
    match f:
        case EqualTo() | EqualNullSafe():
            return f.value is None or low <= f.value <= high
        case In():
            return any(v is not None and low <= v <= high for v in f.value)
        case StringStartsWith():
            return low[: len(f.value)] <= f.value <= high[: len(f.value)]
        case GreaterThan() | GreaterThanOrEqual():
            return high >= f.value
        case LessThan() | LessThanOrEqual():
            return low <= f.value
    return True


class ExchangeReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, block: int):
        self.path, self.schema, self.block, self.filters = path, schema, block, []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Keeps what rules blocks out; every filter is still Spark's to apply, since blocks hold other rows as well."""
        for f in filters:
            if _column(f) in ("url", "method"):
                self.filters.append(f)
            yield f

    def partitions(self) -> list[Block]:
        system, root = files.at(self.path)
        found, noted = [], {}
        there = [i for i in files.listed(system, root) if i.is_file]
        for i in there:
            if i.base_name.startswith(_MANIFEST):
                for b in json.loads(files.read(system, i.path)):
                    noted.setdefault(b["file"], []).append(b)
        # What no manifest names is another's, unless its name says that it is of a writer that wasn't done.
        for i in there:
            if i.base_name in noted:
                found += [Block(i.path, b["start"], b["length"], True) for b in noted[i.base_name] if all(_may_hold(b, f) for f in self.filters)]
            elif not i.base_name.startswith(("_", ".", "part-")) and i.base_name.endswith(".jsonl"):
                found += [Block(i.path, at, min(self.block, i.size - at), False) for at in range(0, i.size, self.block)]
        return found

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        """A block's exchanges; without blocks Spark asks once for nothing."""
        if partition is None:
            return
        system, _ = files.at(self.path)
        schema = to_arrow_schema(self.schema)
        rows: list[dict] = []
        for line in _lines(system, partition):
            given = json.loads(line)
            if "body" in given and "text" not in given:
                given["text"] = base64.b64decode(given["body"]).decode("utf-8", "replace")
            given.setdefault("method", "GET")
            rows.append({f.name: _as(given.get(f.name), f.type) for f in schema})
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _as(value, kind: pa.DataType):
    if value is None or not pa.types.is_map(kind):
        return value
    return [(k, None if v is None else str(v)) for k, v in value.items()]


def _lines(system, block: Block) -> Iterator[bytes]:
    """The lines that begin in a block."""
    with system.open_input_file(block.path) as f:
        size, at = f.size(), block.start
        end = min(block.start + block.length, size)
        if not block.whole and at:  # the line that reaches into the block belongs to the one before
            at -= 1
        f.seek(at)
        rest, first = b"", not block.whole and block.start > 0
        while at < size and (at < end or rest or first):
            piece = f.read(min(1 << 20, size - at))
            begin = at - len(rest)
            at += len(piece)
            *lines, rest = (rest + piece).split(b"\n")
            for line in lines:
                if not first and begin >= end:
                    return
                if not first and line.strip():
                    yield line
                first, begin = False, begin + len(line) + 1
            if begin >= end:
                return
        if rest.strip() and not first:
            yield rest


class ExchangeWriter(DataSourceArrowWriter):
    def __init__(self, path: str, block: int, overwrite: bool):
        self.path, self.block, self.overwrite, self.job = path, block, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file of this attempt, with a row for each of its blocks."""
        system, root = files.at(self.path)
        system.create_dir(root, recursive=True)
        name, blocks = f"part-{self.job}-{uuid.uuid4().hex}.jsonl", []
        out, start, size, urls, methods = None, 0, 0, [], set()

        def close() -> None:
            nonlocal start, size, urls, methods
            if size:
                blocks.append({"file": name, "start": start, "length": size, "low": min(urls, default=None), "high": max(urls, default=None), "methods": sorted(methods)})
            start, size, urls, methods = start + size, 0, [], set()

        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if isinstance(row.get("headers"), list):
                        row["headers"] = dict(row["headers"])
                    given = {k: v for k, v in row.items() if v is not None}
                    given.setdefault("method", "GET")
                    line = json.dumps(given, ensure_ascii=False).encode() + b"\n"
                    out = out or system.open_output_stream(f"{root}/{name}")
                    out.write(line)
                    size += len(line)
                    methods.add(given["method"])
                    if "url" in given:
                        url = given["url"]
                        urls = [min(urls[0], url), max(urls[1], url)] if urls else [url, url]
                    if size >= self.block:
                        close()
            close()
        finally:
            if out:
                out.close()
        return Written(blocks)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest makes the new files part of the recording, all at once."""
        system, root = files.at(self.path)
        system.create_dir(root, recursive=True)
        old = [i.path for i in files.listed(system, root) if i.is_file] if self.overwrite else []
        files.write_json(system, f"{root}/{_MANIFEST}{self.job}.json", [b for m in messages if m for b in m.blocks])
        for path in sorted(old, key=lambda p: _MANIFEST not in p):  # first what makes the old files part of it
            if self.job not in path:
                system.delete_file(path)
        self._tidy(system, root, {b["file"] for m in messages if m for b in m.blocks})

    def abort(self, messages: list[Written | None]) -> None:
        system, root = files.at(self.path)
        self._tidy(system, root, set())

    def _tidy(self, system, root: str, kept: set[str]) -> None:
        """Removes what attempts of this job left that don't count."""
        for i in files.listed(system, root):
            if i.is_file and i.base_name.startswith(f"part-{self.job}-") and i.base_name not in kept:
                system.delete_file(i.path)


class Exchanges(DataSource):
    """Options: path, and block, the bytes of a block or range."""

    @classmethod
    def name(cls) -> str:
        return "exchanges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ExchangeReader:
        return ExchangeReader(self.options["path"], schema, int(self.options.get("block", BLOCK)))

    def writer(self, schema: StructType, overwrite: bool) -> ExchangeWriter:
        return ExchangeWriter(self.options["path"], int(self.options.get("block", BLOCK)), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and has filters handed to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Exchanges)


def record(responses: DataFrame, path: str, mode: str = "append", block: int = BLOCK) -> None:
    """Writes responses (some of SCHEMA's columns) as a recording whose blocks hold neighbouring addresses."""
    register(responses.sparkSession)
    responses.repartitionByRange("url").sortWithinPartitions("url").write.format("exchanges").mode(mode).option("block", block).save(path)


def recorded(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A recording's exchanges, with some of SCHEMA's columns or all: what `discover` and `scan` take as responses."""
    register(spark)
    wanted = [c for c in SCHEMA.split(", ") if columns is None or c.split()[0] in columns]
    return spark.read.format("exchanges").schema(", ".join(wanted)).load(path)
