"""URL filters: rules for hosts and paths, and a ratio of character language models.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs,
give each URL a log-likelihood per character; where no rule decides, the difference of
the two decides against a calibrated threshold.  The models learn from all distinct
URLs that the rules decide: Spark counts which character follows which context, and the
counts stand in tables of a fixed number of places, so models don't grow with the input.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.sources import shared

# Fixed values: (verdict, host and path prefix).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + F.lit(3))
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + F.lit(3))
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    A rule's host fits itself and all its subdomains; its path fits the start of a path.
    """
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest stands outermost
        at = rule.index("/")
        h, p = rule[:at], rule[at:]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(v)).otherwise(verdict)
    return which, verdict


@dataclass
class Markov:
    """A character model that blends all orders up to `order`, each weighed by how many kinds of successor its context has."""

    order: int = 5
    after: dict[str, Counter] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict)
    alphabet: int = 256

    def add(self, url: str) -> None:
        s = "\x02" * self.order + url + "\x03"
        for i in range(self.order, len(s)):
            for k in range(self.order + 1):
                self.after.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def _log_probability(self, gram: str) -> float:
        """The logarithm of the last character's probability after the others, from the shortest context up."""
        c, p = gram[-1], 1 / self.alphabet
        for k in range(self.order + 1):
            if not (seen := self.after.get(gram[self.order - k : -1])):
                break  # a longer context holds this one, so it wasn't seen either
            kinds = len(seen)
            p = (seen[c] + kinds * p) / (seen.total() + kinds)
        return math.log(p)

    def mean_log(self, url: str) -> float:
        """The log-likelihood of the URL and its end, per character."""
        s, total = "\x02" * self.order + url + "\x03", 0.0
        for i in range(self.order, len(s)):
            gram = s[i - self.order : i + 1]
            if (x := self.known.get(gram)) is None:
                x = self._log_probability(gram)
                if len(self.known) < 200_000:  # a memo, not a limit on what is scored
                    self.known[gram] = x
            total += x
        return total / (len(s) - self.order)


#: Places of a model's tables; contexts that meet in one share their counts.
PLACES = 1 << 19
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
    h = (h ^ (chars + np.uint64(1))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _SPREAD


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(45)).astype(np.int64)  # 19 bits


def _slices(urls: Iterable[str], chars: int = 1 << 19) -> Iterator[list[str]]:
    """Lists of URLs of about so many characters, or of one."""
    out, n = [], 0
    for u in urls:
        out.append(u)
        n += len(u) + 1
        if n >= chars:
            yield out
            out, n = [], 0
    if out:
        yield out


def _contexts(urls: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Where each URL begins, the characters and each one's end mark, and hashes of what precedes them, by order."""
    padded = [np.frombuffer(("\x02" * order + u + "\x03").encode("utf-32-le", "surrogatepass"), "<u4") for u in urls]
    sizes = np.array([len(x) - order for x in padded])
    text = np.concatenate(padded).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(order * np.arange(1, len(urls) + 1), sizes)
    hashes = [np.full(len(at), 1, np.uint64)]
    for k in range(1, order + 1):
        hashes.append(_mixed(hashes[-1], text[at - k]))
    return starts, text[at], hashes


@dataclass
class Table:
    """Markov with its counts in fixed tables: of a context and its successor, of a context, and its kinds of successor."""

    order: int = 5
    seen: np.ndarray = field(default_factory=lambda: np.zeros(PLACES, np.int64))
    total: np.ndarray = field(default_factory=lambda: np.zeros(PLACES, np.int64))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(PLACES, np.int64))
    alphabet: int = 256

    def __getstate__(self) -> dict:
        """Packed, since most places of a small table are empty and broadcasts lie on every disk."""
        return self.__dict__ | {k: zlib.compress(getattr(self, k).tobytes(), 1) for k in ("seen", "total", "kinds")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {k: np.frombuffer(zlib.decompress(state[k]), np.int64) for k in ("seen", "total", "kinds")})

    def mean_logs(self, urls: list[str]) -> np.ndarray:
        """The log-likelihood of each URL and its end, per character."""
        starts, chars, hashes = _contexts(urls, self.order)
        p, known = np.full(len(chars), 1 / self.alphabet), np.ones(len(chars), bool)
        for h in hashes:
            at = _place(h)
            total, kinds = self.total[at], self.kinds[at]
            known &= total > 0  # a longer context holds this one, so it wasn't seen either
            n = np.minimum(self.seen[_place(_mixed(h, chars))], total)
            p = np.where(known, (n + kinds * p) / np.maximum(total + kinds, 1), p)
        return np.add.reduceat(np.log(p), starts) / np.diff(np.append(starts, len(chars)))


@dataclass
class UrlModel:
    accepted: Table
    rejected: Table
    threshold: float = 0.0

    def ratios(self, urls: Iterable[str]) -> list[float]:
        return [x for part in _slices(urls) for x in (self.accepted.mean_logs(part) - self.rejected.mean_logs(part)).tolist()]

    def ratio(self, url: str) -> float:
        return self.ratios([url])[0]


def calibrated(good: list[float], bad: list[float]) -> float:
    """The threshold that divides good from bad ratios with the least sum of the shares on the wrong side."""
    return _divided(Counter(good), Counter(bad))


def _divided(good: dict[float, int], bad: dict[float, int]) -> float:
    """calibrated, of ratios with their numbers."""
    if not good or not bad:
        return 0.0
    places = sorted({*good, *bad, 0.0})
    middles = [0.0, *((a + b) / 2 for a, b in zip(places, places[1:])), places[0] - 1, places[-1] + 1]

    def below(found: dict[float, int]):
        keys = sorted(found)
        sums = [0, *accumulate(found[k] for k in keys)]
        return lambda t: sums[bisect_left(keys, t)] / sums[-1]

    lost, kept = below(good), below(bad)
    return min(middles, key=lambda t: (lost(t) + 1 - kept(t), abs(t)))


def _counted(order: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for good, rows in batch.groupby("good"):
                for part in _slices(rows["u"]):
                    _, chars, hashes = _contexts(part, order)
                    pairs = np.stack([np.concatenate(hashes).view(np.int64), np.tile(chars, order + 1).astype(np.int64)])
                    (h, c), n = np.unique(pairs, axis=1, return_counts=True)
                    yield pd.DataFrame({"good": good, "h": h, "c": c.astype(np.int32), "n": n, "pair": _place(_mixed(h.view(np.uint64), c.astype(np.uint64)))})

    return count


def train(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES, order: int = 5) -> UrlModel:
    """Fits both models on all distinct URLs with a verdict; a fifth of them, by hash, calibrates the threshold.

    The threshold is the one at which the shares of accepted URLs that fail and of
    rejected ones that pass, both of those held back, add up to least; of equal ones,
    the one nearest to 0, where the likelier model decides.  It is 0 where no URL of a
    kind was held back.  Ratios are counted by thousandths.  To the driver come tables
    of at most PLACES rows a model, and as many rows as there are thousandths.
    """
    model = UrlModel(Table(order), Table(order))
    _, verdict = rule_for(host_of(F.col(url)), path_of(F.col(url)), rules)
    # Addresses are few bytes each, so they are dealt out in a number of parts that is told.
    n = shared.parts(pages.sparkSession)
    decided = pages.select(F.col(url).alias("u"), (verdict == "allow").alias("good")).where("good is not null").repartition(n, "u").distinct()
    back = F.expr("pmod(xxhash64(u), 5) = 4")
    counts = decided.where(~back).mapInPandas(_counted(order), "good boolean, h long, c int, n long, pair long").groupBy("good", "h", "c", "pair").agg(F.sum("n").alias("n"))
    places = counts.select("good", "n", F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.shiftrightunsigned("h", 45).alias("at")), F.struct(F.lit(False).alias("whole"), F.col("pair").alias("at")))).alias("x"))
    for (good, whole), rows in places.groupBy("good", "x.whole", "x.at").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas().groupby(["good", "whole"]):
        table, at = model.accepted if good else model.rejected, rows["at"].to_numpy()
        if whole:
            table.total[at], table.kinds[at] = rows["n"], rows["kinds"]
        else:
            table.seen[at] = rows["n"]
    sent = pages.sparkSession.sparkContext.broadcast(model)
    ratio = _ratio(sent)
    held: dict[bool, dict[float, int]] = {True: {}, False: {}}
    for r in decided.where(back).groupBy("good", F.round(ratio("u"), 3).alias("ratio")).count().collect():
        held[r["good"]][r["ratio"]] = r["count"]
    sent.unpersist()
    model.threshold = _divided(held[True], held[False])
    return model


def _ratio(sent):
    @F.pandas_udf("double")
    def ratio(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        for batch in urls:
            some = batch.dropna().unique().tolist()
            yield batch.map(dict(zip(some, model.ratios(some)))).astype("float64")

    return ratio


def judge_urls(pages: DataFrame, model: UrlModel, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """keep's columns, host, path, rule, ratio and verdict for every row.

    Host: after the first ://, up to /, ? or #, A-Z lower-cased; path: from there up to
    ? or #; both empty where the URL is null or has no ://.  verdict: the longest
    fitting rule's, else allow if the ratio reaches the model's threshold, else block; a
    null URL, which has no ratio, is blocked.  Repeated rows are judged one by one.
    Kept columns of these names give way to the results.
    """
    keep = tuple(c for c in keep if c not in ("host", "path", "rule", "ratio", "verdict"))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = rule_for(host, path, rules)
    ratio = _ratio(pages.sparkSession.sparkContext.broadcast(model))
    ruled = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("ruled"), F.when(rule.isNull(), F.col(url)).alias("open"))
    scored = ruled.withColumn("ratio", ratio("open"))
    own = F.when(F.coalesce(F.col("ratio") >= model.threshold, F.lit(False)), F.lit("allow")).otherwise(F.lit("block"))
    return scored.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "host", "path", "rule", "ratio", F.coalesce("ruled", own).alias("verdict"))
