"""Periodic runs of words: stretches that repeat a smallest period, found for each text in linear time.

After Kolpakov and Kucherov: a suffix automaton gives the factors of a text, each the
longest stretch that begins earlier as well; Main's algorithm finds the runs that touch
the border between two factors; runs inside a factor are those of its earlier occurrence.
All words of a run with exponent x occur in it floor(x) times at least, so a text is cut
first at words that are too few in their stretch, over and over, and what is left of
ordinary prose is little.  Texts are worked on one by one, without shuffle.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomscan.llm.kernel import column, slices

#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """A text's words as numbers, and the words that they stand for."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids, at = array("i"), 0
    while at < len(text):
        to = at + PIECE
        while to < len(text) and text[to] not in _SPACE:
            to += 1
        ids.extend(map(number.__getitem__, text[at:to].split()))
        at = to
    return np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32), list(number)


def stretches(ids: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int]]:
    """The longest stretches of `least` words or more in which every word occurs `times` times or more."""
    if len(ids) < least:
        return
    at = np.flatnonzero(np.bincount(ids)[ids] >= times)
    segment = np.zeros(len(at), np.int64)
    before = np.array([len(ids)])  # words of each segment as it was
    while len(at):
        new = np.append(True, (np.diff(at) > 1) | (np.diff(segment) > 0))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        whole = (size == before[segment[first]]) & (size >= least)
        for a, n in zip(at[first[whole]].tolist(), size[whole].tolist()):
            yield a, a + n
        go_on = np.repeat((size >= least) & ~whole, size)
        number = np.repeat(np.cumsum((size >= least) & ~whole) - 1, size)
        before = size[(size >= least) & ~whole]
        at, segment = at[go_on], number[go_on]
        if len(at):
            _, which, count = np.unique(segment * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
            good = count[which] >= times
            at, segment = at[good], segment[good]


def factors(x: list[int]) -> Iterator[tuple[int, int, int]]:
    """(begin, end, begin of the earlier occurrence or -1) of the factors of x, by its suffix automaton.

    A state has one letter and its target in arrays; further ones are in a dictionary,
    which in a text with runs few states need.
    """
    n = len(x)
    letter, to, link, length, ends = (array("i", [v]) * (2 * n + 1) for v in (-1, -1, -1, 0, -1))
    more: dict[int, dict[int, int]] = {}
    last, states = 0, 1
    for i, c in enumerate(x):
        cur, states = states, states + 1
        length[cur], ends[cur] = i + 1, i
        p = last
        while p >= 0:
            if letter[p] == c:
                q = to[p]
                break
            if letter[p] < 0:
                letter[p], to[p] = c, cur
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: cur}
                elif c in others:
                    q = others[c]
                    break
                else:
                    others[c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        elif length[p] + 1 == length[q]:
            link[cur] = q
        else:
            twin, states = states, states + 1
            length[twin], link[twin], ends[twin], letter[twin], to[twin] = length[p] + 1, link[q], ends[q], letter[q], to[q]
            if q in more:
                more[twin] = dict(more[q])
            while p >= 0:
                if letter[p] == c:
                    if to[p] != q:
                        break
                    to[p] = twin
                else:
                    others = more.get(p)
                    if others is None or others.get(c) != q:
                        break
                    others[c] = twin
                p = link[p]
            link[q] = link[cur] = twin
        last = cur
    i = 0
    while i < n:
        state, j = 0, i
        while j < n:
            c = x[j]
            at = to[state] if letter[state] == c else more[state][c]
            if ends[at] >= j:
                break
            state, j = at, j + 1
        yield i, max(j, i + 1), ends[state] - (j - i) + 1 if j > i else -1
        i = max(j, i + 1)


def _own(s: list[int], count: int) -> list[int]:
    """For each place below count, how far s agrees with what begins there."""
    n, z, left, right = len(s), [0] * max(count, 1), 0, 0
    z[0] = n
    for i in range(1, count):
        if i < right and z[i - left] < right - i:
            z[i] = z[i - left]
        else:
            k = max(i, right)
            while k < n and s[k] == s[k - i]:
                k += 1
            z[i], left, right = k - i, i, k
    return z


def _against(s: list[int], z: list[int], v: list[int], count: int) -> list[int]:
    """For each place of v below count, how far s (with its own z) agrees with what begins there."""
    n, most, out, left, right = len(v), len(s), [0] * count, 0, 0
    for i in range(count):
        if i < right and z[i - left] < right - i:
            out[i] = z[i - left]
        else:
            k = max(i, right)
            while k < n and k - i < most and v[k] == s[k - i]:
                k += 1
            out[i], left, right = k - i, i, k
    return out


def touching(x: list[int], low: int, border: int, high: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Main's algorithm: (start, end, period) of the runs within x[low:high] that reach the border.

    A period's run has all of that period on one side of the border at least.  How far
    letters agree with those a period before or after, to both sides, is read from four
    arrays.
    """
    most = (high - low) // times
    if not most:
        return
    u, t = x[border:high], x[low:border]
    back = t[::-1]
    right, left = min(len(u), most), min(len(t), most)
    zu, zt = _own(u, min(len(u), most + 1)), _own(back, min(len(back), most + 1))
    n = len(x)

    def run(start: int, end: int, p: int) -> bool:
        return end - start >= max(least, times * p) and (start == 0 or x[start - 1] != x[start - 1 + p]) and (end == n or x[end] != x[end - p])

    if left:
        ahead = _against(u, zu, t[len(t) - left :] + u, left)
        for p in range(1, left + 1):
            start, end = border - p - (zt[p] if p < len(t) else 0), border + ahead[left - p]
            if run(start, end, p):
                yield start, end, p
    if right:
        behind = _against(back, zt, u[right - 1 :: -1] + back if right else back, right)
        for p in range(1, right + 1):
            start, end = border - behind[right - p], border + p + (zu[p] if p < len(u) else 0)
            if run(start, end, p):
                yield start, end, p


def runs(x: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """All (start, end, period) of x, in order: smallest period, `least` letters and `times` periods at least."""
    known: list[tuple[int, int]] = []
    period: dict[tuple[int, int], int] = {}

    def border(low: int, at: int, high: int) -> None:
        for start, end, p in touching(x, max(low, 0), at, high, least, times):
            if (start, end) not in period:
                insort(known, (start, end))
            period[start, end] = min(p, period.get((start, end), p))

    before = 0
    for begin, end, earlier in factors(x):
        # A run that ends in this factor begins less than so far before it.
        border(begin - 2 * before - (end - begin), begin, end)
        k = bisect_left(known, (earlier + 1, 0))
        while earlier >= 0 and k < len(known) and known[k][0] < earlier + end - begin:
            a, b = known[k]
            if b < earlier + end - begin:
                copy = (a + begin - earlier, b + begin - earlier)
                if copy not in period:
                    insort(known, copy)
                    period[copy] = period[a, b]
            k += 1
        before = end - begin
    border(len(x) - 2 * before, len(x), len(x))
    return [(a, b, period[a, b]) for a, b in known]


def text_runs(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs by start, then period."""
    found = []
    for a, b in stretches(ids, least, times):
        _, letters = np.unique(ids[a:b], return_inverse=True)
        found += [(a + s, e - s, p) for s, e, p in runs(letters.tolist(), least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(ids: np.ndarray, words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by single spaces."""
    change = np.zeros(len(ids) + 1, np.int64)
    for start, length, p in found:
        change[start + p] += 1
        change[start + length] -= 1
    kept = ids if not found else ids[np.cumsum(change[:-1]) == 0]
    return b" ".join(map(words.__getitem__, kept.tolist()))


def _scan(key: str, text: str, least: int, times: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                sizes, found, rest = [], [], []
                for value in column(part, text).cast(pa.large_binary()):
                    ids, words = numbered(value.as_py() or b"")
                    sizes.append(len(ids))
                    own = text_runs(ids, least, times)
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    rest.append(collapsed(ids, words, own))
                yield pa.RecordBatch.from_arrays([column(part, key), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(rest, pa.binary()).cast(pa.string())], names=[key, "n_words", "runs", "collapsed"])

    return each


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """key, n_words, runs array<struct<start, length, period>> and collapsed for every row.

    A run is a stretch of words with a smallest period, `least` words and `times` periods
    long at least, that no neighbouring word extends; words are what ASCII white space
    parts, numbered from 0.  collapsed: the text without the words that a run repeats
    after its first period, words joined by single spaces.  Null and empty texts have no
    words, no runs and an empty collapsed text; null keys are passed on and repeated rows
    are scanned one by one; other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(key, text).mapInArrow(_scan(key, text, least, times), schema)
