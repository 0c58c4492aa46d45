"""Stupid-backoff language-model scores.

Documents are read in units.  The n-grams of every unit are exploded to rows (h, unit,
n): a hash, and how often the unit has it, so an n-gram that is everywhere is one row a
unit.  Partitioned by hash, their counts over the whole corpus are a sum of n for each h
(the count table), which every row of that h is joined with.  Rows whose n-gram occurs
only once in the corpus say nothing more; the others go back to their unit, whose words
find their counts there, and scores are summed per document.

S(w | context) is c(context w) / c(context) where the n-gram occurs at least min_count
times, else backoff times S with the context shortened by its first word; a single word
has c(w) / (words in the corpus).  Each word's logarithm is rounded to a millionth
before it is added, so sums don't depend on the order of addition.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscan.llm import exchange
from loomscan.llm.kernel import ALNUM, U64, Words, column, ngrams, pack_sorted, slices, spread, squeeze, unpack_sorted, utf8

#: The key under which the number of words in the corpus is counted.
TOTAL = U64(0)
#: Bytes of text in a unit.
UNIT_BYTES = 16 << 20
#: Rows of n-grams in a batch, and counted rows that are brought together on their way back.
BATCH_ROWS = 1 << 16
ANSWER_ROWS = 1 << 20
#: How hard texts are compressed that travel to their answers.
TEXT_LEVEL = 7


def _grams(hashes: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order the keys of the n-grams within texts."""
    seq = SimpleNamespace(hashes=hashes, counts=counts, first=np.concatenate([[0], np.cumsum(counts)]))
    return [ngrams(seq, n)[0] for n in range(1, order + 1)]


def _units(batches: Iterator[pa.RecordBatch], text: str, key: str) -> Iterator[tuple[int, list[tuple[pa.Array, pa.Array]]]]:
    """The number of each unit of a task, which follows from its place, and its runs of ids and texts."""
    unit, size, held = TaskContext.get().partitionId() << 32, 0, []
    for batch in batches:
        for part in slices(batch, text):
            held.append((column(part, key), column(part, text)))
            size += utf8(held[-1][1])[0].size
            if size >= UNIT_BYTES:
                yield unit, held
                unit, size, held = unit + 1, 0, []
    if held:
        yield unit, held


def _words(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Words per document, and the hashes of all words."""
    found = [Words(t, ALNUM) for t in texts]
    return np.concatenate([w.counts for w in found]), np.concatenate([w.hashes for w in found])


def _explode(text: str, key: str, order: int):
    """Rows (h, unit, n) of every unit's n-grams, and of its number of words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, held in _units(batches, text, key):
            counts, hashes = _words([t for _, t in held])
            keys, n = np.unique(np.concatenate([*_grams(hashes, counts, order), np.full(len(hashes), TOTAL)]), return_counts=True)
            for at in range(0, len(keys), BATCH_ROWS):
                part = keys[at : at + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(np.full(len(part), unit)), pa.array(n[at : at + BATCH_ROWS].astype(np.int32))], names=["h", "unit", "n"])

    return each


def _documents(text: str, key: str):
    """One row (unit, own) for each unit: its ids and texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, held in _units(batches, text, key):
            runs = []
            for ids, texts in held:
                raw, offsets = utf8(texts)
                runs.append((ids, squeeze(np.diff(offsets)), len(raw), pa.Codec("zstd", compression_level=TEXT_LEVEL).compress(raw.tobytes(), asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([pickle.dumps(runs)], pa.binary())], names=["unit", "own"])

    return each


def _texts(sizes: bytes, rows: int, length: int, raw: bytes) -> pa.Array:
    offsets = np.append(0, np.cumsum(spread(sizes, np.int64, rows)))
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(spread(raw, np.uint8, length).tobytes()))


_TOLD = "unit long, size long, keys binary, totals binary"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted rows (unit, h, total) on their way back: what a task has for one unit together, a bounded number of rows at a time."""
    held, rows = [], 0

    def packed() -> pa.RecordBatch:
        unit, h, total = (np.concatenate([x[k] for x in held]) for k in range(3))
        order = np.lexsort((h.view(U64), unit))
        unit, h, total = unit[order], h[order].view(U64), total[order]
        units, first = np.unique(unit, return_index=True)
        ends = np.append(first[1:], len(unit)).tolist()
        out = [(int(u), z - a, _pack(h[a:z]), _pack(total[a:z].astype(U64), ordered=False)) for u, a, z in zip(units, first.tolist(), ends)]
        return pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(("unit", "size", "keys", "totals"))}, schema=pa.schema([("unit", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("totals", pa.binary())]))

    for batch in batches:
        held.append([column(batch, c).to_numpy() for c in ("unit", "h", "total")])
        rows += batch.num_rows
        if rows >= ANSWER_ROWS:
            yield packed()
            held, rows = [], 0
    if rows:
        yield packed()


def _pack(x: np.ndarray, ordered: bool = True) -> bytes:
    """Compressed where there are enough of them for that to help."""
    return x.tobytes() if len(x) < 64 else pack_sorted(x) if ordered else squeeze(x)


def _unpack(data: bytes, size: int, ordered: bool = True) -> np.ndarray:
    return np.frombuffer(data, U64) if size < 64 else unpack_sorted(data, size) if ordered else spread(data, U64, size)


def _score(key: str, order: int, backoff: float, min_count: int):
    """The documents of one unit, scored by the counts of its n-grams; what has no count here occurs once."""

    def each(own: pa.Table, met: pa.Table) -> pa.Table:
        runs = pickle.loads(own.column("own")[0].as_py())
        ids = pa.concat_arrays([r[0] for r in runs])
        counts, hashes = _words([_texts(sizes, len(i), length, raw) for i, sizes, length, raw in runs])
        parts = list(zip(*(met.column(c).to_pylist() for c in ("size", "keys", "totals"))))
        told = np.concatenate([np.zeros(0, U64), *(_unpack(k, n) for n, k, _ in parts)])
        total = np.concatenate([np.zeros(0, U64), *(_unpack(t, n, ordered=False) for n, _, t in parts)]).astype(np.int64)
        by = np.argsort(told)
        told, total = told[by], total[by]

        def count(keys: np.ndarray) -> np.ndarray:
            if not len(told):
                return np.ones(len(keys), np.int64)
            i = np.minimum(np.searchsorted(told, keys), len(told) - 1)
            return np.where(told[i] == keys, total[i], 1)

        n = len(hashes)
        first = np.cumsum(counts) - counts
        place = np.arange(n) - np.repeat(first, counts)
        corpus = int(count(np.array([TOTAL]))[0])
        micro, seen = np.zeros(n), np.zeros(n, np.int64)
        before: np.ndarray | None = None
        for k, gram in enumerate(_grams(hashes, counts, order), 1):
            c = np.zeros(n, np.int64)  # of the k-gram that ends at each word
            c[np.flatnonzero(place >= k - 1)] = count(gram)
            if k == 1:
                value = np.log(c / max(corpus, 1)) if n else micro
                least = np.minimum(place, order - 1)
                micro = value + least * np.log(backoff)
            else:
                known = np.flatnonzero((place >= k - 1) & (c >= min_count))
                micro[known] = np.log(c[known] / before[known - 1]) + (least[known] - k + 1) * np.log(backoff)
                seen[known] = k - 1
            before = c
        backed = np.cumsum(np.concatenate([[0], seen < np.minimum(place, order - 1)]))
        summed = np.cumsum(np.concatenate([[0], np.rint(micro * 1e6).astype(np.int64)]))
        ends = first + counts
        return pa.Table.from_arrays([ids, pa.array(counts.astype(np.int64)), pa.array(backed[ends] - backed[first]), pa.array(summed[ends] - summed[first])], names=[key, "n_words", "n_backoff", "micro"])

    return each


def _parts(docs: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Partitions of the n-grams: the session's, or more where Spark's estimate of the input asks for them."""
    size = exchange.estimated(docs)
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // bytes_each, 100_000))


def stupid_backoff(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = 2, backoff: float = 0.4, min_count: int = 2) -> DataFrame:
    """key, n_words, n_backoff, micro, score: each document's log score under the corpus' counts.

    n_backoff: words for which a shorter context had to do; micro: the sum of the words'
    natural logarithms in millionths; score: micro a word, in nats, null without words.
    Null and empty texts have no words and a null score.  Repeated rows and keys are
    scored one by one, and each counts in the corpus; a null key is passed on.  The
    input has to be a table or otherwise be read in the same order if read again.
    """
    if order < 1 or not 0 < backoff <= 1 or min_count < 1:
        raise ValueError("order and min_count are at least 1, backoff is above 0 and at most 1")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text)
    grams = rows.mapInArrow(_explode(text, key, order), "h long, unit long, n int").repartition(_parts(docs), "h")
    counted = grams.withColumn("total", F.sum("n").over(W.partitionBy("h"))).where("total > 1").select("unit", "h", "total").mapInArrow(_answers, _TOLD)
    own = rows.mapInArrow(_documents(text, key), "unit long, own binary")
    out = own.groupBy("unit").cogroup(counted.groupBy("unit")).applyInArrow(_score(key, order, backoff, min_count), f"`{key}` {kind}, n_words long, n_backoff long, micro long")
    return out.withColumn("score", F.when(F.col("n_words") > 0, F.col("micro") / F.lit(1e6) / F.col("n_words")))
