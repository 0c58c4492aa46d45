"""Best-fit packing of tokenised documents into sequences, with certified bin counts.

Pieces are dealt at random into groups of bounded size; each group is packed by
best-fit decreasing and its number of bins compared with the best lower bound of several
families of dual-feasible functions.  A group that meets its bound can't be improved.
Groups with a gap give up all bins that aren't full, others only their emptiest one; what
they gave up is exchanged, dealt anew into as many groups of bounded size as it takes and
packed again, until it was one group or a round gains less than a thousandth of its bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.graph import keep
from loomscan.llm.kernel import column

# Fixed value: how this kind of vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBE = "It's the 1st of May, isn't it?  We'LL see…\n\n  naïve café — Straße 北京 🙂\t\tfoo_bar(x)=42;\r\n   end " + "ab" * 60
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """The ids that a byte-level BPE tokenizer file gives.

    The merging itself is left to the quicker of two public libraries where it provably
    has the same vocabulary and gives the same ids for a probe; texts that spell a
    special token, and all texts where that fails, go through the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.quick = None
        try:
            import tiktoken

            held = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in held]
            spelled = {chr(b): b for b in held} | {chr(256 + i): b for i, b in enumerate(rest)}
            ranks = {bytes(spelled[c] for c in t): i for t, i in self.exact.get_vocab(with_added_tokens=False).items() if t not in self.special}
            quick = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            if quick.encode_ordinary(_PROBE) == self.exact.encode(_PROBE, add_special_tokens=False).ids:
                self.quick = quick
        except Exception:  # another kind of tokenizer
            self.quick = None

    def ids(self, text: str) -> np.ndarray:
        if self.quick is not None and not any(s in text for s in self.special):
            try:
                return self.quick.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
            except BaseException as e:  # the regex engine gives up on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def _encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: full pieces, the first one takes what is left."""
    first = n - (max(1, -(-n // capacity)) - 1) * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(text: str, key: str, path: str | None, capacity: int, end: int, with_ids: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts, size = column(batch, text), 0
            out: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}

            def done() -> pa.RecordBatch:
                arrays = [column(batch, key).take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(out["ids"], pa.list_(pa.int32()))], [*names, "ids"]
                for x in out.values():
                    x.clear()
                return pa.RecordBatch.from_arrays(arrays, names=names)

            for i in range(len(texts)):
                t = texts[i].as_py()
                ids = np.append(encoder.ids(t) if t else np.zeros(0, np.uint32), np.uint32(end)).astype("<u4", copy=False)
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[s : s + n]
                    for c, x in (("row", i), ("piece", k), ("start", s), ("length", n), ("ids_crc32", zlib.crc32(part))):
                        out[c].append(x)
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
                size += len(ids)
                if size > 4 << 20:
                    yield done()
                    size = 0
            yield done()

    return each


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds that dual-feasible functions give for the number of bins."""
    count = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int(count @ x) // capacity)
    for k in range(1, capacity // 2 + 1):  # more than capacity - k counts as a bin, less than k as nothing
        f = np.where(x > capacity - k, capacity, np.where(x < k, 0, x))
        best = max(best, -(-int(count @ f) // capacity))
    for k in range(1, 65):  # steps of 1 / k, full where (k + 1) x / capacity isn't whole
        whole = ((k + 1) * x) % capacity == 0
        f = np.where(whole, x * k, ((k + 1) * x // capacity) * capacity)  # times k
        best = max(best, -(-int(count @ f) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's bin and offset; the fullest bin that still has room takes the next piece."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, opened = 0, 0  # bit r of some: a bin with r free is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := some >> n:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                some ^= 1 << free
        else:
            free, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - free
        if left := free - n:
            room[left].append(b)
            some |= 1 << left
    return bins, offsets


def _pack(capacity: int, round_: int):
    def each(table: pa.Table) -> pa.Table:
        lengths = column(table, "length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used = np.bincount(bins, lengths).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        given = (used < capacity) if len(used) > bound else (np.arange(len(used)) == np.argmin(used)) & (used < capacity)
        sequence = (np.int64(round_) << np.int64(56)) + (table.column("deal")[0].as_py() << 24) + bins
        table = table.drop_columns(["deal", "sequence_id", "offset", "given", "bins", "bound"])
        for name, x in (("sequence_id", sequence), ("offset", offsets), ("given", given[bins]), ("bins", np.full(len(bins), len(used))), ("bound", np.full(len(bins), bound))):
            table = table.append_column(name, pa.array(x))
        return table

    return each


def best_fit_pack(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = 1024, tokenizer: str | None = None, end: int = 2, with_ids: bool = False, group_rows: int = 50_000) -> DataFrame:
    """key, piece, start, length, ids_crc32, [ids,] sequence_id, offset, bins, bound.

    A document's ids, then the id end, are one piece, or if longer than capacity, full
    pieces of which the first may be shorter.  Pieces fill sequences without gaps, from
    offset 0.  bins and bound: the number of sequences of the group in which the piece
    was packed, and its certified least.  Null and empty texts are the id end alone;
    repeated rows are packed each for itself; an empty table gives no rows.
    tokenizer: the path of a tokenizers file, that of the public vocabulary if None.
    group_rows: pieces that a group holds, give or take the chance of the deal.
    """
    kind = docs.schema[key].dataType.simpleString()
    base = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = keep(docs.select(key, text).mapInArrow(_pieces(text, key, tokenizer, capacity, end, with_ids), base))
    schema = base + ", sequence_id long, offset long, given boolean, bins long, bound long"
    pool = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "given": F.lit(True), "bins": F.lit(0).cast("long"), "bound": F.lit(0).cast("long")})
    parts: list[DataFrame] = []
    before, round_ = None, 0
    while True:
        groups = max(1, -(-pool.count() // group_rows))
        dealt = pool.withColumn("deal", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups)))
        packed = keep(dealt.groupBy("deal").applyInArrow(_pack(capacity, round_), schema))
        after = packed.where("offset = 0").count()
        if before is not None and after >= before:  # the bins as they were are no worse
            parts.append(pool)
            break
        if groups == 1 or (before is not None and 1000 * (before - after) < before):
            parts.append(packed)
            break
        parts.append(packed.where("not given"))
        pool = packed.where("given")
        before = pool.where("offset = 0").count()
        round_ += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("given")
