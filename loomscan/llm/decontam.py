"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of a benchmark item's words is a pattern.  A table says, for the block of
words under the cursor, how far the search may jump; where it may not, the block's hash
selects the bucket of windows that end in it, and their words are compared one by one.  Texts are
cut into lanes that advance side by side, so that a step is one vector operation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomscan.llm.graph import keep as kept
from loomscan.llm.kernel import ALNUM, U64, Words, column, combine, slices

#: Words of a lane; lanes overlap by a window less one word.
LANE = 1024


class Patterns:
    """The shift table and suffix buckets for windows of one length.

    starts, owners: where a window begins among the corpus' words, and whose it is.  Equal
    windows are one, by a 64-bit hash; all tables are a few numbers a word of the corpus.
    """

    def __init__(self, length: int, corpus: Words, starts: np.ndarray, owners: np.ndarray):
        self.length, self.block, self.corpus = length, min(3, length), corpus
        m, b = self.length, self.block
        keys = combine(corpus.hashes, m)[starts]
        order = np.lexsort((owners, keys))
        keys, starts, owners = keys[order], starts[order], owners[order]
        other = np.append(True, keys[1:] != keys[:-1])
        told = other | np.append(True, owners[1:] != owners[:-1])
        self.windows = starts[other]
        self.owners, self.own = owners[told], np.append(np.flatnonzero(other[told]), told.sum())
        # How far the search may jump for each block of words: the least over its places in windows.
        blocks = combine(corpus.hashes, b)
        shift = np.full(len(blocks), m, np.int64)
        for q in range(m - b + 1):
            at = self.windows + q
            shift[at] = np.minimum(shift[at], m - b - q)
        at = np.flatnonzero(shift < m)
        keys, shift = blocks[at], shift[at]
        order = np.lexsort((shift, keys))
        keys, shift = keys[order], shift[order]
        first = np.append(True, keys[1:] != keys[:-1])
        self.keys, self.shift = keys[first], shift[first]
        # Suffix buckets: the windows in the order of their last block's hash, and where each bucket begins.
        suffix = blocks[self.windows + m - b]
        self.order = np.argsort(suffix, kind="stable")
        self.suffix, self.begin = np.unique(suffix[self.order], return_index=True)
        self.end = np.append(self.begin[1:], len(self.windows))

    @staticmethod
    def _blocks(rows: np.ndarray) -> np.ndarray:
        """One hash for each row of word hashes."""
        n = rows.shape[1]
        return combine(np.append(rows.ravel(), U64(0)), n)[::n][: len(rows)] if len(rows) else np.zeros(0, U64)

    def items(self, window: int) -> np.ndarray:
        """Whose a window is."""
        return self.owners[self.own[window] : self.own[window + 1]]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of every window that occurs within a text."""
        m, b, h = self.length, self.block, words.hashes
        lanes = [np.arange(a, z - m + 1, LANE) for a, z in zip(words.first[:-1].tolist(), words.first[1:].tolist()) if z - a >= m]
        if not lanes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.concatenate(lanes)
        last = np.repeat(words.first[1:], words.counts)[begin]
        at, end = begin + m - 1, np.minimum(begin + LANE + m - 1, last)  # the window's last word; one past the lane
        jump, found = m - b + 1, []
        while len(at):
            block = self._blocks(h[at[:, None] + np.arange(1 - b, 1)])
            i = np.minimum(np.searchsorted(self.keys, block), len(self.keys) - 1)
            shift = np.where(self.keys[i] == block, self.shift[i], jump)
            if len(stop := at[shift == 0]):
                found.append(stop)
            at = at + np.maximum(shift, 1)
            more = at < end
            at, end = at[more], end[more]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.concatenate(found) - m + 1
        # Every window of the bucket that the last block selects is compared, word by word.
        i = np.searchsorted(self.suffix, self._blocks(h[start[:, None] + np.arange(m - b, m)]))
        size = self.end[i] - self.begin[i]
        place = np.repeat(start, size)
        number = self.order[np.repeat(self.begin[i] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        for k in range(m):  # hashes first, one word after another
            same = h[place + k] == self.corpus.hashes[self.windows[number] + k]
            place, number = place[same], number[same]
        same = np.fromiter((words.phrase(s, m) == self.corpus.phrase(w, m) for s, w in zip(place.tolist(), self.windows[number].tolist())), bool, len(place))
        return place[same], number[same]


class Block:
    """Some items of a benchmark: it travels as texts, and a worker compiles their windows once."""

    def __init__(self, items: list[tuple[object, str]], length: int):
        self.names = sorted({str(k) for k, _ in items})
        self.texts, self.keys, self.length = [t for _, t in items], [str(k) for k, _ in items], length

    @cached_property
    def patterns(self) -> list[Patterns]:
        """One set for each window length."""
        corpus = Words(pa.array(self.texts, pa.large_string()), ALNUM)
        number = {n: i for i, n in enumerate(self.names)}
        owner = np.array([number[k] for k in self.keys], np.int64)
        lengths, out = np.minimum(corpus.counts, self.length), []
        for m in np.unique(lengths[lengths > 0]).tolist():
            mine = np.flatnonzero(lengths == m)
            n = corpus.counts[mine] - m + 1
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append(Patterns(m, corpus, np.repeat(corpus.first[mine], n) + place, np.repeat(owner[mine], n)))
        return out


_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _mark(text: str, keep: list[str], shared, hits_only: bool = False):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for part in slices(batch, text):
                words = Words(column(part, text), ALNUM)
                doc = words.doc()
                cover = np.zeros(len(doc) + 1, np.int64)
                items: list[set[int]] = [set() for _ in range(part.num_rows)]
                for p in block.patterns:
                    start, number = p.find(words)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + p.length, -1)
                    for d, k in set(zip(doc[start].tolist(), number.tolist())):
                        items[d].update(p.items(k).tolist())
                hit = np.cumsum(cover)[:-1] > 0
                edge = hit & ~np.append(False, hit[:-1] & (doc[1:] == doc[:-1]))[: len(hit)] if len(hit) else hit
                stop = hit & ~np.append(hit[1:] & (doc[1:] == doc[:-1]), False)[: len(hit)] if len(hit) else hit
                a, z = np.flatnonzero(edge), np.flatnonzero(stop)
                spans = [[] for _ in range(part.num_rows)]
                for s, e, d in zip(a.tolist(), z.tolist(), doc[a].tolist()):
                    f = int(words.first[d])
                    spans[d].append({"start": s - f, "end": e + 1 - f})
                out = pa.RecordBatch.from_arrays(
                    [
                        *(column(part, c) for c in keep),
                        pa.array(words.counts.astype(np.int64)),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([[block.names[i] for i in sorted(x)] for x in items], pa.list_(pa.string())),
                    ],
                    names=[*keep, "n_words", "spans", "items"],
                )
                yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else out

    return each


RUNS = T.StructType([T.StructField("start", T.ArrayType(T.LongType())), T.StructField("end", T.ArrayType(T.LongType()))])


@F.pandas_udf(RUNS)
def _runs(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Maximal runs of what intervals of several blocks cover."""
    out = []
    for a, z in zip(starts, ends):
        order = np.argsort(a, kind="stable")
        a, z = np.asarray(a, np.int64)[order], np.maximum.accumulate(np.asarray(z, np.int64)[order])
        first = np.append(True, a[1:] > z[:-1])[: len(a)]
        out.append((a[first].tolist(), z[np.append(first[1:], True)[: len(a)]].tolist()))
    return pd.DataFrame(out, columns=["start", "end"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """keep's columns, n_words, spans and items for every document.

    spans: maximal runs [start, end) of words, from 0, that lie in occurrences of
    windows; items: the ids, as sorted strings, of items with an occurring window.
    The benchmark is read in blocks of at most block_bytes of text (a longer item is a
    block of its own), each a broadcast of bounded size.  A worker holds one block at a
    time: with more than one, documents are numbered and kept in the shared folder,
    every block is a branch that gives the documents it hits, and these meet by number.
    Null and empty texts have no words, items without words or without id have no
    windows, and an empty benchmark hits nothing.  Repeated rows are judged one by one.
    Kept columns of these names give way to the results.
    """
    keep = tuple(c for c in keep if c not in ("n_words", "spans", "items"))
    blocks, pending, size = [], [], 0
    share = lambda items: docs.sparkSession.sparkContext.broadcast(Block(items, window))
    for row in benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").toLocalIterator():
        if pending and size + len(row.t.encode()) > block_bytes:
            blocks.append(share(pending))
            pending, size = [], 0
        pending.append((row.i, row.t))
        size += len(row.t.encode())
    blocks.append(share(pending))

    def scan(df: DataFrame, columns: list[str], text: str, block, hits_only: bool = False) -> DataFrame:
        schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns), _FOUND])
        return df.mapInArrow(_mark(text, columns, block, hits_only), schema)

    if len(blocks) == 1:
        columns = [*keep, *([text] if text not in keep else [])]
        return scan(docs.select(*columns), columns, text, blocks[0]).select(*keep, "n_words", "spans", "items")
    given = {f"k{i}": c for i, c in enumerate(keep)}
    rows = kept(docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"), *(F.col(c).alias(k) for k, c in given.items())))
    out = scan(rows, ["row", *given], "text", blocks[0])
    more = [scan(rows.select("row", "text"), ["row"], "text", b, hits_only=True) for b in blocks[1:]]
    met = reduce(DataFrame.unionByName, more).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
    out = out.join(met, "row", "left").withColumn("every", F.concat("spans", F.coalesce("more_spans", F.array())))
    runs = F.arrays_zip(F.col("runs.start").alias("start"), F.col("runs.end").alias("end"))
    names = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array()))))
    out = out.withColumn("runs", _runs(F.col("every.start"), F.col("every.end")))
    return out.select(*(F.col(k).alias(c) for k, c in given.items()), "n_words", runs.alias("spans"), names.alias("items"))


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit (words in spans) and contaminated: at least a twentieth of the words is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
