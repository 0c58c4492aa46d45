"""Exact n-gram Jaccard join: groups of documents whose shingle sets overlap enough.

Document by n-gram incidence is a sparse matrix, blocked by n-gram hash.  Its product
with its own transpose would count every pair's common n-grams; size-derived bounds keep
all but a few entries from being formed:

1. Two linked sets of sizes n and m have at least o(n) = ceil(threshold * n) n-grams in
   common.  With a fixed order of the n-grams (by hash) and l(n) = max(1, n // 10), the
   first n - o(n) + l(n) n-grams of either hold at least l(o(n)) common ones.  Columns
   are counted over all documents; a document with fewer prefix columns that anyone
   else has than this bound is linked with nothing.  This drops most documents.
2. What is left is one row for each distinct set (its class).  Now all its columns are
   counted among these rows: fewer than o(n) that anyone else has, and it is linked with
   nothing.  Of f such columns it keeps the f - o(n) + 1 rarest; a linked row keeps one
   of them too.
3. The product is formed for entries that those columns propose: rows of a column with
   the column's first row, which for most columns of a group of copies is the same, and where a column then still spans several components, rows
   of different components with one another.  Entries within a component can't change
   the result and are never formed.
4. The incidence is cut into blocks of columns.  An entry's overlap is accumulated block
   by block; after each, the entry is dropped unless what it has and what is left of the
   smaller rest could still make up the least overlap of its sizes.  Most entries that
   aren't links are gone after the first block, so the other blocks of their rows never
   travel.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm import exchange
from loomscan.llm.graph import components, keep
from loomscan.llm.kernel import SOLID, U64, Words, column, mix, pack_sorted, shingle_sets, slices, spread, squeeze, unpack_sorted

#: Bytes of text, or n-grams, in a unit.
UNIT_BYTES = 8 << 20
UNIT_GRAMS = 1 << 20
#: Where blocks of columns begin after the first, by the first bits of their hash: a quarter, and the others.
BLOCK_BITS = 2
BLOCKS = [1]
#: Rows of a column that one task multiplies with all others of it.
PART_ROWS = 4096


def overlap(n, percent: int):
    """The least number of n-grams that a set of n shares with any linked set."""
    return -(-percent * n // 100)


def slack(n):
    return np.maximum(1, n // 10)


def _digests(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16 bytes for each set, equal for equal sets; its size is part of it."""
    out = np.zeros((len(sizes), 2), U64)
    full = sizes > 0
    begin = (np.cumsum(sizes) - sizes)[full]
    if len(begin):
        out[full, 0] = np.add.reduceat(mix(grams + U64(1)), begin)
        out[full, 1] = np.add.reduceat(mix(grams ^ U64(0x5851F42D4C957F2D)), begin)
    out[:, 0] += mix(sizes.astype(U64))
    return out


def _prefixes(grams: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hashes of each sorted set, and how many."""
    take = np.where(sizes > 0, np.minimum(sizes, sizes - overlap(sizes, percent) + slack(sizes)), 0)
    total = int(take.sum())
    begin = np.cumsum(sizes) - sizes
    return grams[np.arange(total) - np.repeat(np.cumsum(take) - take - begin, take)], take


def _unit(held: list[tuple], unit: int, buckets: int) -> pa.RecordBatch:
    ids = pa.concat_arrays([h[0] for h in held])
    sizes, digests, prefix, take = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
    keys, where, weights = np.unique(prefix, return_inverse=True, return_counts=True)
    own = pickle.dumps((ids, sizes, digests, take, squeeze(where.astype(np.int32)), len(prefix)))
    return exchange.rows(unit, keys, weights, buckets, own)


def _send(text: str, key: str, n: int, percent: int, buckets: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, size, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for part in slices(batch, text):
                words = Words(column(part, text), SOLID)
                grams, sizes = shingle_sets(words, n)
                held.append((column(part, key), sizes, _digests(grams, sizes), *_prefixes(grams, sizes, percent)))
                size += len(words.raw)
                if size >= UNIT_BYTES:
                    yield _unit(held, unit, buckets)
                    unit, size, held = unit + 1, 0, []
        if held:
            yield _unit(held, unit, buckets)

    return each


def _filter(key: str, percent: int):
    def finish(own: bytes, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, sizes, digests, take, where, length = pickle.loads(own)
        shared = totals[spread(where, np.int32, length)] > 1
        ends = np.cumsum(take)
        upto = np.cumsum(np.append(0, shared))
        have = upto[ends] - upto[ends - take]
        alive = (have > 0) & (have >= slack(overlap(sizes, percent)))
        cls = [d.tobytes() if a else None for d, a in zip(digests, alive.tolist())]
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(cls, pa.binary())], names=[key, "n", "cls"])

    return finish


def node_type(kind: str) -> str:
    """A class: the least key of its rows, whose type is kind, and the digest of its set."""
    return f"struct<rep:{kind},digest:binary>"


def sets_schema(node: str) -> str:
    return f"cls {node}, n long, sizes array<long>, parts array<binary>"


def _cut(grams: np.ndarray) -> list[np.ndarray]:
    """A sorted set's columns by block."""
    ends = np.searchsorted(grams >> U64(64 - BLOCK_BITS), np.array(BLOCKS, U64)).tolist()
    return [grams[a:b] for a, b in zip([0, *ends], [*ends, len(grams)])]


def _whole(parts: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([unpack_sorted(p, n) for p, n in zip(parts, sizes)])


def _send_sets(buckets: int):
    """Units of whole sets, from rows of sets_schema."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = column(batch, "n").to_numpy()
            packed = list(zip(column(batch, "parts").to_pylist(), column(batch, "sizes").to_pylist()))
            at = 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), UNIT_GRAMS)) + at)
                grams = np.concatenate([_whole(*p) for p in packed[at:to]])
                keys, weights = np.unique(grams, return_counts=True)
                yield exchange.rows(unit, keys, weights, buckets, pickle.dumps((column(batch, "cls")[at:to], sizes[at:to], packed[at:to])))
                unit, at = unit + 1, to

    return each


def _rarest(percent: int):
    def finish(own: bytes, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, sizes, packed = pickle.loads(own)
        sets = [_whole(*p) for p in packed]
        every = np.concatenate(sets)
        count = totals[np.searchsorted(np.unique(every), every)]
        rows, columns, have, at = [], [], [], 0
        for i, grams in enumerate(sets):
            df = count[at : at + len(grams)]
            at += len(grams)
            shared, least = np.flatnonzero(df > 1), int(overlap(len(grams), percent))
            if len(shared) >= least > 0:
                best = shared[np.lexsort((grams[shared], df[shared]))[: len(shared) - least + 1]]
                rows.append(i)
                columns.append(grams[best].view(np.int64))
                have.append(len(shared))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(sizes[rows]), pa.array(have, pa.int64()), pa.array([c.tolist() for c in columns], pa.list_(pa.int64()))], names=["cls", "n", "f", "cols"])

    return finish


def _sets(text: str, n: int):
    """Rows of sets_schema for the texts whose own digest is that of cls."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                grams, sizes = shingle_sets(Words(column(part, text), SOLID), n)
                cls = column(part, "cls")
                own = np.flatnonzero([d.tobytes() == c for d, c in zip(_digests(grams, sizes), cls.field("digest").to_pylist())])
                ends = np.cumsum(sizes)
                blocks = [_cut(grams[e - s : e]) for e, s in zip(ends[own].tolist(), sizes[own].tolist())]
                lengths, packed = [[len(b) for b in x] for x in blocks], [[pack_sorted(b) for b in x] for x in blocks]
                yield pa.RecordBatch.from_arrays([cls.take(pa.array(own)), pa.array(sizes[own].astype(np.int64)), pa.array(lengths, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.binary()))], names=["cls", "n", "sizes", "parts"])

    return each


def _accumulate(percent: int):
    """Adds to each entry what its rows have in common in one block, and drops entries that can't be links any more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, U64))
        for batch in batches:
            both = []
            for sa, pa_, sb, pb in zip(*(column(batch, c).to_pylist() for c in ("size_a", "part_a", "size_b", "part_b"))):
                if pa_ != last[0]:
                    last = (pa_, unpack_sorted(pa_, sa))
                a, b = last[1], unpack_sorted(pb, sb)
                both.append(int((a[np.minimum(np.searchsorted(a, b), sa - 1)] == b).sum()) if sa else 0)
            n, m, rest, left, had, size_a, size_b = (column(batch, c).to_numpy() for c in ("n", "m", "rest", "left", "both", "size_a", "size_b"))
            rest, left, both = rest - size_a, left - size_b, had + np.array(both, np.int64)
            most = both + np.minimum(rest, left)
            keep_ = np.flatnonzero(100 * most >= percent * (n + m - most))
            yield pa.RecordBatch.from_arrays([column(batch, "a").take(pa.array(keep_)), column(batch, "b").take(pa.array(keep_)), *(pa.array(x[keep_]) for x in (n, m, rest, left, both))], names=["a", "b", "n", "m", "rest", "left", "both"])

    return each


def overlaps(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The entries (a, b, n, m) of the product that are links, with their overlap in both."""
    node = sets.schema["cls"].dataType.simpleString()
    schema = f"a {node}, b {node}, n long, m long, rest long, left long, both long"
    out = entries.select("a", "b", "n", "m", F.col("n").alias("rest"), F.col("m").alias("left"), F.lit(0).cast("long").alias("both"))
    for k in range(len(BLOCKS) + 1):
        of = lambda side: sets.select(F.col("cls").alias(side), F.col("sizes")[k].alias(f"size_{side}"), F.col("parts")[k].alias(f"part_{side}"))  # noqa: B023, E731
        out = out.join(of("b"), "b").join(of("a"), "a").mapInArrow(_accumulate(percent), schema)
    return out


def jaccard_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles and component for every document.

    A document's set: its distinct shingles of n words (A-Z lower-cased, split at ASCII
    white space); with fewer words, the whole sequence as one; null, empty and blank
    texts have an empty set and link with nothing.  Two documents link when 100 times
    the size of the intersection is at least percent times that of the union.
    component: the least key reachable by links.  Rows with a null key are returned with
    a null component and link nothing.  Every row counts for itself: repeated rows are
    copies of one another, and different texts under one key are different documents,
    each with its own component.  The input has to be a table or otherwise be read in
    the same order if read again.
    """
    if not 0 < percent <= 100 or n < 1:
        raise ValueError("percent is from 1 to 100, n at least 1")
    kind = docs.schema[key].dataType.simpleString()
    plan = exchange.plan_for(docs)
    units = docs.select(key, text).mapInArrow(_send(text, key, n, percent, plan.buckets), exchange.SCHEMA)
    every = keep(exchange.answered(units, plan, _filter(key, percent), f"`{key}` {kind}, n long, cls binary").withColumnRenamed(key, "id"))

    # One row for each distinct set that has enough company, from the text of its least key that has it.
    alive = every.where("cls is not null and id is not null").withColumnRenamed("cls", "digest")
    node = node_type(kind)
    classes = keep(alive.groupBy("digest").agg(F.min("id").alias("rep")))
    texts = docs.select(F.col(key).alias("rep"), text)
    sets = keep(texts.join(classes, "rep").select(F.struct("rep", "digest").alias("cls"), text).mapInArrow(_sets(text, n), sets_schema(node)).dropDuplicates(["cls"]))
    rarest = exchange.answered(sets.mapInArrow(_send_sets(plan.buckets), exchange.SCHEMA), plan, _rarest(percent), f"cls {node}, n long, f long, cols array<long>")
    # rem: how many of the row's columns are no rarer than this one.
    columns = keep(rarest.select("cls", "n", "f", F.posexplode("cols").alias("at", "h")).select("cls", "n", "h", (F.col("f") - F.col("at")).alias("rem")))

    def linked(entries: DataFrame) -> DataFrame:
        return keep(overlaps(entries, sets, percent).select("a", "b"))

    # If this is an entry's rarest common column, it has no more in common than what is left of either row.
    close = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & ((100 + percent) * F.least("rem", "left") >= percent * (F.col("n") + F.col("m")))
    first = columns.groupBy("h").agg(F.min(F.struct("cls", "n", "rem")).alias("x")).select("h", F.col("x.cls").alias("a"), F.col("x.n").alias("m"), F.col("x.rem").alias("left"))
    star = columns.join(first, "h").where((F.col("cls") > F.col("a")) & close).select("a", F.col("cls").alias("b"), F.col("m").alias("n"), F.col("n").alias("m")).distinct()
    links = linked(star)
    member = components(links)
    placed = columns.join(member.withColumnRenamed("node", "cls"), "cls", "left").select("h", "cls", "n", "rem", F.coalesce("component", "cls").alias("comp"))
    # A column of many rows is multiplied in parts: its rows are dealt, and each part meets all of them.
    open_ = placed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).where("x <> y").select("h", "parts")
    placed = keep(placed.join(open_, "h"))
    one = placed.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    other = placed.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("cls").alias("b"), F.col("n").alias("m"), F.col("rem").alias("left"), F.col("comp").alias("comp_b"))
    cross = one.join(other, ["h", "part"]).where((F.col("cls") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & close).select(F.col("cls").alias("a"), "b", "n", "m").distinct()
    links = links.unionByName(linked(cross.join(star.select("a", "b"), ["a", "b"], "left_anti")))
    member = components(links)

    # Classes are in the order of their least keys, so the least class of a component has its least key.
    named = classes.select(F.struct("rep", "digest").alias("node"), "digest").join(member, "node", "left").select("digest", F.coalesce("component", "node")["rep"].alias("component"))
    grouped = alive.select("id", "n", "digest").join(named, "digest").select("id", "n", "component")
    single = every.where("cls is null or id is null").select("id", "n", F.col("id").alias("component"))
    return grouped.unionByName(single).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component")
