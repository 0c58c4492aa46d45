"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Normalised vectors at cosine c lie sqrt(2 - 2c) apart.  Each table cuts `hashes` random
projections into steps of `width`; vectors that fall into the same cells share a bucket.
At cosine 0.95 one hash agrees with probability 0.87, sixteen with 0.115, and one of 24
tables with 0.95; closer vectors more often.  Bucket members are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.graph import components, keep
from loomscan.llm.kernel import column, mix


def _projections(dim: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


def signatures(unit: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """For each normalised vector a 64-bit bucket number in every table."""
    a, b = _projections(unit.shape[1], tables, hashes, width, seed)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, hashes)
    out = np.full((len(unit), tables), np.uint64(unit.shape[1]))
    for k in range(hashes):
        out = mix(out ^ mix(cells[:, :, k] + np.uint64(k + 1)))
    return out.view(np.int64)


def _read(key: str, vector: str):
    """Vectors as bytes of doubles; null where they can't be compared."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, cls = [], []
            for v in column(batch, vector).to_pylist():
                ok = v is not None and len(v) > 0 and None not in v
                x = np.array(v if ok else [], np.float64)
                if ok and np.isfinite(x).all() and x.any():
                    raw.append(x.tobytes())
                    cls.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                else:
                    raw.append(None)
                    cls.append(None)
            yield pa.RecordBatch.from_arrays([column(batch, key), pa.array(cls, pa.binary()), pa.array(raw, pa.binary())], names=["id", "cls", "vec"])

    return each


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(tables: int, hashes: int, width: float, seed: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = column(batch, "vec").to_pylist()
            by: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                by.setdefault(len(v), []).append(i)
            for rows in by.values():
                for at in range(0, len(rows), 2000):
                    some = rows[at : at + 2000]
                    sig = signatures(_unit([vecs[i] for i in some]), tables, hashes, width, seed)
                    ids = column(batch, "id").take(pa.array(np.repeat(some, tables)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(tables, dtype=np.int32), len(some))), pa.array(sig.ravel())], names=["id", "tab", "bucket"])

    return each


def _links(unit: np.ndarray, sig: np.ndarray, tab: int, left: int, cross: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) at a cosine of at least `least` that share this table's bucket and no earlier one's.

    cross: only pairs between the first `left` rows and the others.
    """
    heads, tails = [], []
    begin = left if cross else 0
    for a in range(0, left if cross else len(unit), 256):
        z = min(a + 256, left) if cross else a + 256
        i, j = np.nonzero(unit[a:z] @ unit[begin:].T >= least)
        i, j = i + a, j + begin
        ok = i < j
        i, j = i[ok], j[ok]
        new = sig[i, tab] == sig[j, tab]
        for t in range(tab):
            new &= sig[i, t] != sig[j, t]
        heads.append(i[new])
        tails.append(j[new])
    return np.concatenate(heads), np.concatenate(tails)


def _reach(rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the row of least rank that pairs (i, j) lead to."""
    at, label = np.argsort(rank), rank.copy()
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[at][low]
        if (low == label).all():
            return at[label]
        label = low


def _compare(least: float, tables: int, hashes: int, width: float, seed: int):
    """Links within blocks of buckets, or between two, that no earlier table has found; several to a call."""

    def each(table: pa.Table) -> pa.Table:
        vecs = table.column("vec").to_pylist()
        size = np.array([len(v) for v in vecs])
        tab, bucket, bi, bj, blk, copies = (column(table, c).to_numpy() for c in ("tab", "bucket", "bi", "bj", "blk", "copies"))
        order = np.lexsort((blk, bj, bi, bucket, tab, size))
        vecs, ids = [vecs[k] for k in order], column(table, "id").take(pa.array(order))
        tab, bucket, bi, bj, blk, copies, size = (x[order] for x in (tab, bucket, bi, bj, blk, copies, size))
        edge = np.flatnonzero((np.diff(tab) != 0) | (np.diff(bucket) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0) | (np.diff(size) != 0)) + 1
        begins, ends = np.append(0, edge), np.append(edge, len(vecs))
        rank = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable"))
        links, label = np.zeros(len(vecs), np.int64), np.arange(len(vecs))
        for d in np.unique(size).tolist():
            a, z = np.searchsorted(size, [d, d + 1])
            unit = _unit(vecs[a:z])
            sig = signatures(unit, tables, hashes, width, seed)
            for f, e in zip(begins.tolist(), ends.tolist()):
                if not a <= f < z or e - f < 2:
                    continue
                u, g = unit[f - a : e - a], sig[f - a : e - a]
                left = int((blk[f:e] == bi[f]).sum())
                i, j = _links(u, g, int(tab[f]), left, bi[f] != bj[f], least)
                if len(i):
                    np.add.at(links[f:e], i, copies[f:e][j])
                    np.add.at(links[f:e], j, copies[f:e][i])
                    label[f:e] = f + _reach(np.argsort(np.argsort(rank[f:e])), i, j)
        return pa.table({"id": ids, "links": pa.array(links), "root": ids.take(pa.array(label))})

    return each


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, tables: int = 24, hashes: int = 16, width: float = 2.0, seed: int = 7, block: int = 2048) -> DataFrame:
    """key, n_links and component for every vector.

    n_links: other vectors at a cosine of at least `least` that share a bucket in some
    table; component: the least key reachable by such links.  Equal vectors are compared
    once and count for each copy; larger buckets are compared block by block, whole.
    Vectors that are null, empty or zero, or hold null or non-finite components, link
    with nothing, and so do rows with a null key; vectors of different lengths don't
    link.  Repeated rows are copies.
    """
    kind = vectors.schema[key].dataType.simpleString()
    every = keep(vectors.select(key, vector).mapInArrow(_read(key, vector), f"id {kind}, cls binary, vec binary"))
    usable = "cls is not null and id is not null"
    classes = keep(every.where(usable).groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("vec").alias("vec")))
    hashed = classes.select("id", "vec").mapInArrow(_hash(tables, hashes, width, seed), f"id {kind}, tab int, bucket long")
    sizes = keep(hashed.groupBy("tab", "bucket").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = sizes.agg(F.sum(F.col("n") * blocks)).first()[0] or 0
    # Small buckets share calls, about 4,096 rows each; a large bucket's block pairs are calls of their own size.
    call = F.pmod(F.xxhash64("tab", "bucket", "bi", "bj"), F.lit(max(1, rows // 4096)))
    placed = hashed.join(sizes, ["tab", "bucket"]).withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("blk", j).alias("bi"), F.greatest("blk", j).alias("bj")))
    spread = placed.select("id", "tab", "bucket", "blk", F.explode(pairs).alias("p")).select("id", "tab", "bucket", "blk", "p.*")
    found = spread.join(classes.select("id", "vec", "copies"), "id").groupBy(call.alias("call")).applyInArrow(_compare(least, tables, hashes, width, seed), f"id {kind}, links long, root {kind}")
    found = keep(found.groupBy("id", "root").agg(F.sum("links").alias("links")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    named = classes.select("cls", "copies", "id").join(counts, "id", "left").join(member, "id", "left")
    named = named.select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    grouped = every.where(usable).select("id", "cls").join(named, "cls").select("id", "n_links", "component")
    single = every.where(f"not ({usable})").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return grouped.unionByName(single).select(F.col("id").alias(key), "n_links", "component")
