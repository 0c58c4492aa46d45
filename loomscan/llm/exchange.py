"""Counting hashed keys over the whole corpus, and telling each unit of documents the totals.

A unit is a run of documents that one task has read.  It sends, for each of many hash
buckets, its own distinct keys with their weights, so that a key that occurs everywhere
arrives once a unit; the bucket adds them up and answers every unit with totals in the
order of its keys.  What a unit needs later travels along in a row of its own.  Two
shuffles of a few rows of large binaries do the work of a shuffled join of all
occurrences with a count table that is partitioned by hash.

A key that is everywhere brings its bucket one entry a unit.  Beyond COARSE buckets the
units are therefore dealt into groups: a bucket is first added up within each group,
the groups' sums are added up in finer buckets in the same way, and the totals go back
through the groups.  No task then holds more than a group's units or the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.graph import keep
from loomscan.llm.kernel import U64, pack_sorted, spread, squeeze, unpack_sorted

SCHEMA = "unit long, bucket long, size long, keys binary, weights binary"
_ARROW = pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("weights", pa.binary())])


#: Buckets that the units of one group send to.
COARSE = 8192


@dataclass(frozen=True)
class Plan:
    """buckets: how many a unit sends rows to; groups: how many the units are dealt into; fine: buckets for the groups' sums."""

    buckets: int
    groups: int
    fine: int


def estimated(df: DataFrame) -> int:
    """Spark's estimate of a table's bytes; 0 where it has none, for which it says an exabyte or more."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def plan_for(df: DataFrame, bytes_each: int = 4 << 20) -> Plan:
    """How to deal the keys, from Spark's estimate of the input; the result doesn't depend on it."""
    size = estimated(df)
    fine = min(size, 1 << 50) // bytes_each
    if fine > COARSE:
        return Plan(COARSE, -(-fine // COARSE), fine)
    n = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), fine)
    return Plan(n, 1, n)


def rows(unit: int, keys: np.ndarray, weights: np.ndarray, buckets: int, own: bytes | None = None) -> pa.RecordBatch:
    """A unit's rows: its sorted distinct keys by bucket, and what it keeps for itself, if anything."""
    at = ((keys >> U64(32)) * U64(buckets)) >> U64(32)  # ascending with the key
    ids, first = np.unique(at, return_index=True)
    ends = np.append(first[1:], len(keys))
    out = {"unit": [unit], "bucket": [-1 - unit], "size": [0], "keys": [own], "weights": [b""]} if own is not None else {c: [] for c in _ARROW.names}
    for b, i, j in zip(ids.tolist(), first.tolist(), ends.tolist()):
        out["unit"].append(unit)
        out["bucket"].append(b)
        out["size"].append(j - i)
        out["keys"].append(pack_sorted(keys[i:j]))
        out["weights"].append(squeeze(weights[i:j].astype(np.int64)))
    return pa.RecordBatch.from_pydict(out, schema=_ARROW)


def _summed(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Each row's size, the distinct keys of all rows, where each row's keys are among them, and their sums."""
    sizes = table.column("size").to_pylist()
    every = np.concatenate([unpack_sorted(k, n) for k, n in zip(table.column("keys").to_pylist(), sizes)])
    weights = np.concatenate([spread(w, np.int64, n) for w, n in zip(table.column("weights").to_pylist(), sizes)])
    distinct, inverse = np.unique(every, return_inverse=True)
    return sizes, distinct, inverse, np.bincount(inverse, weights, len(distinct)).astype(np.int64)


def _answers(table: pa.Table, sizes: list[int], totals: np.ndarray) -> pa.Table:
    """The table's rows with totals, one row's after another's, for their keys."""
    ends = np.cumsum(sizes).tolist()
    told = [squeeze(totals[e - n : e]) for e, n in zip(ends, sizes)]
    return pa.table({"unit": table.column("unit"), "bucket": table.column("bucket"), "size": table.column("size"), "keys": pa.array([b""] * len(sizes), pa.binary()), "weights": pa.array(told, pa.binary())}, schema=_ARROW)


def _total(table: pa.Table) -> pa.Table:
    """Answers all units of one bucket; a unit's own row passes unchanged."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    sizes, _, inverse, total = _summed(table)
    return _answers(table, sizes, total[inverse])


def _merged(fine: int):
    """A group's sums of one bucket, sent on as a unit of their own."""

    def each(table: pa.Table) -> pa.Table:
        _, keys, _, total = _summed(table)
        return pa.Table.from_batches([rows(table.column("part")[0].as_py(), keys, total, fine)])

    return each


def _joined(buckets: list[int], sizes: list[int], weights: list[bytes]) -> np.ndarray:
    """Totals in the order of the keys, which is that of their buckets."""
    parts = [spread(w, np.int64, n) for _, n, w in sorted(zip(buckets, sizes, weights), key=lambda x: x[0])]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _retold(sent: pa.Table, told: pa.Table) -> pa.Table:
    """Answers the units of a group and bucket with what the group was told."""
    sizes, _, inverse, _ = _summed(sent)
    return _answers(sent, sizes, _joined(*(told.column(c).to_pylist() for c in ("bucket", "size", "weights")))[inverse])


def totals(units: DataFrame, plan: Plan) -> DataFrame:
    """Rows as made by rows(), with every bucket's keys replaced by their totals."""
    if plan.groups == 1:
        return units.groupBy("bucket").applyInArrow(_total, SCHEMA)
    units = keep(units)
    part = F.pmod(F.xxhash64("unit"), F.lit(plan.groups)) * plan.buckets + F.col("bucket")
    sent = units.where("bucket >= 0").withColumn("part", part)
    sums = sent.groupBy("part").applyInArrow(_merged(plan.fine), SCHEMA)
    told = sums.groupBy("bucket").applyInArrow(_total, SCHEMA).withColumnRenamed("unit", "part")
    return sent.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_retold, SCHEMA).unionByName(units.where("bucket < 0"))


def answered(units: DataFrame, plan: Plan, finish: Callable[[bytes, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls finish(own, totals) once a unit, with totals in the order of the unit's sorted keys."""

    def each(table: pa.Table) -> pa.Table:
        own, parts = b"", ([], [], [])
        for b, n, k, w in zip(*(table.column(c).to_pylist() for c in ("bucket", "size", "keys", "weights"))):
            if b < 0:
                own = k
            else:
                for to, x in zip(parts, (b, n, w)):
                    to.append(x)
        return pa.Table.from_batches(list(finish(own, _joined(*parts))))

    return totals(units, plan).groupBy("unit").applyInArrow(each, schema)
