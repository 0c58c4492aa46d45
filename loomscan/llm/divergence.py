"""Source divergence audit: how far the sources of a language differ in their use of its terms.

Terms are numbered by sorted arrays: tasks count their documents' terms, the counts are
added up, and each language's frequent terms become sorted arrays of `chunk` terms by
range.  A count finds its term's place in its chunk's array by binary search; a chunk is
a dense table of counts, sources by terms, and numbers within it are in the order of the
terms' UTF-8.  All arithmetic is in integers.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscan.llm.graph import keep
from loomscan.llm.kernel import column, slices

#: Letters of terms with A-Z lower-cased; all other ASCII parts terms.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
#: Entries that a task counts before it hands them on.
HELD = 400_000
UNIT = 1_000_000_000


def share(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), by long division so that nothing overflows below 9 * 10^15."""
    whole = np.int64(total + 2 * terms)
    rest, out = count.astype(np.int64) + 2, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1."""
    gap = (p - q).view(np.int64)
    return ((gap * gap).astype(np.uint64) // (p + q).astype(np.uint64)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)
    within: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        """Sorted arrays of each group's terms with their counts."""
        columns: list[list] = [[], [], [], [], []]
        for group, terms in counts.items():
            order = sorted(terms)
            for values, more in zip(columns, ([group[0]] * len(order), [group[1]] * len(order), order, map(terms.__getitem__, order), map(within[group].__getitem__, order))):
                values.extend(more)
        counts.clear()
        within.clear()
        lang, source, term, n, docs = columns
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for part in slices(batch, "text"):
            for lang, source, text in zip(column(part, "lang").to_pylist(), column(part, "source").to_pylist(), column(part, "text").cast(pa.large_binary())):
                words = text.as_py().translate(_FOLD).split()
                counts[lang, source].update(words)
                within[lang, source].update(set(words))
            if sum(map(len, counts.values())) > HELD:
                yield out()
    yield out()


def _arrays(chunk: int):
    """Sorted rows of (lang, term) as arrays of at most `chunk` terms of one language."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms, totals = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([terms[0]]), pa.array([terms], pa.list_(pa.string())), pa.array([totals], pa.list_(pa.int64()))], names=["lang", "first", "terms", "totals"])

        for batch in batches:
            for now, term, n in zip(*(column(batch, c).to_pylist() for c in ("lang", "term", "n"))):
                if terms and (now != lang or len(terms) == chunk):
                    yield out()
                    terms, totals = [], []
                lang = now
                terms.append(term)
                totals.append(n)
        if terms:
            yield out()

    return each


def _place(firsts: dict[str, list[bytes]]):
    """Adds the number of the chunk whose range a term falls in; terms of languages that keep none are gone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none: list[bytes] = []
            where = [bisect_right(firsts.get(lang, none), term.as_py()) - 1 for lang, term in zip(column(batch, "lang").to_pylist(), column(batch, "term").cast(pa.binary()))]
            placed = pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int32())], names=[*batch.schema.names, "chunk"])
            yield placed.filter(pa.compute.greater_equal(placed.column("chunk"), 0))

    return each


def _dense(counts: pd.DataFrame, sources: list[str], terms: np.ndarray) -> np.ndarray:
    """Counts of a chunk, sources by terms."""
    given = counts["term"].str.encode("utf-8").to_numpy(object)
    ids = np.minimum(np.searchsorted(terms, given), len(terms) - 1)
    same = terms[ids] == given
    row = {s: i for i, s in enumerate(sources)}
    group = counts["source"].map(row).to_numpy(np.int64)
    # bincount adds in doubles, exact below 2^53.
    flat = np.bincount(group[same] * len(terms) + ids[same], weights=counts["n"].to_numpy(np.float64)[same], minlength=len(sources) * len(terms))
    return flat.astype(np.int64).reshape(len(sources), len(terms))


def _audit(ranks: int):
    """A chunk's part of all pairs' values, and each source's best terms in it."""

    def each(key, arrays: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(arrays):
            return pd.DataFrame(columns=["lang", "source", "part", "item", "value"])
        chunk = arrays.iloc[0]
        terms = np.empty(len(chunk["terms"]), object)
        terms[:] = [t.encode() for t in chunk["terms"]]
        sources, totals, kept = list(chunk["sources"]), [int(n) for n in chunk["n"]], int(chunk["kept"])
        dense = _dense(counts, sources, terms)
        p = [share(row, n, kept) for row, n in zip(dense, totals)]
        q = share(np.asarray(chunk["totals"], np.int64), int(chunk["total"]), kept)
        out: list[tuple] = []
        for i, source in enumerate(sources):
            out += [(source, "pair", other, int(divergence(p[i], p[j]).sum())) for j, other in enumerate(sources[:i])]
            at = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            value = divergence(p[i][at], q[at])
            best = np.lexsort((at, -value))[:ranks]
            out += [(source, "term", terms[at[k]].decode(), int(value[k])) for k in best]
        frame = pd.DataFrame(out, columns=["source", "part", "item", "value"])
        return frame.assign(lang=key[0])[["lang", "source", "part", "item", "value"]]

    return each


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)


def audit_sources(docs: DataFrame, least: int = 10, ranks: int = 10, chunk: int = 1024) -> DataFrame:
    """lang, source, part, item, value and rank: see the module; rows of documents with lang, source and text.

    Each language keeps the terms that occur in `least` of its documents.  A group (of a
    language and a source) and a language give a kept term with count c the share
    p = 1 + floor(10^9 * (c + 2) / (N + 2 * V)), N the sum of c over the V kept terms;
    two shares are floor((p - q)^2 / (p + q)) apart.  Part `pair` adds that up over all
    kept terms for each other source of the language; part `term` has, for a group's own
    terms of which it has a greater share than its language, the `ranks` greatest.
    Ranks are by value from the greatest, then by item in UTF-8 order.

    Null texts, langs and sources are empty strings; groups without terms take part in
    pairs; a language that keeps no term has pairs of value 0; repeated rows count as
    often as they occur; an empty table gives no rows; other columns aren't read.

    Memory of a task: HELD counts, or sources times `chunk` counts.  To the driver come
    the first terms of all chunks, one in `chunk` kept terms.  A language's sources are
    held in one array; their pairs are what is returned.
    """
    given = docs.select(_text("lang"), _text("source"), _text("text"))
    parts = given.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    sums = keep(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = keep(sums.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term", "n"))
    arrays = keep(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_arrays(chunk), "lang string, first string, terms array<string>, totals array<long>"))
    firsts: dict[str, list[bytes]] = defaultdict(list)
    for r in arrays.select("lang", "first").collect():
        firsts[r["lang"]].append(r["first"].encode())
    firsts = {lang: sorted(f) for lang, f in firsts.items()}

    placed = sums.select("lang", "source", "term", "n").mapInArrow(_place(firsts), "lang string, source string, term string, n long, chunk int")
    starts = arrays.select("lang", "first", "terms", "totals").mapInArrow(_place_arrays(firsts), "lang string, terms array<string>, totals array<long>, chunk int")
    # What every chunk of a language has to know: its sources with the sums of their kept terms.
    sizes = arrays.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"), F.sum(F.aggregate("totals", F.lit(0).cast("long"), lambda a, b: a + b)).alias("total"))
    groups = keep(given.select("lang", "source").distinct())
    known = sums.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    about = groups.join(known, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("s"))
    about = about.join(sizes, "lang").select("lang", F.col("s.source").alias("sources"), F.col("s.n").alias("n"), "kept", "total")
    found = starts.join(about, "lang").groupBy("lang", "chunk").cogroup(placed.groupBy("lang", "chunk")).applyInPandas(_audit(ranks), "lang string, source string, part string, item string, value long")
    found = keep(found)

    apart = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = apart.unionByName(apart.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.join(other, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def _place_arrays(firsts: dict[str, list[bytes]]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [bisect_right(firsts[lang], first.encode()) - 1 for lang, first in zip(column(batch, "lang").to_pylist(), column(batch, "first").to_pylist())]
            yield pa.RecordBatch.from_arrays([column(batch, "lang"), column(batch, "terms"), column(batch, "totals"), pa.array(where, pa.int32())], names=["lang", "terms", "totals", "chunk"])

    return each
