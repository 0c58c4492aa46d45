"""Toxicity scores by weak supervision.

Voters are lexicons (a fixed one, and words and word beginnings that labelled training
rows with the label have and others hardly, in bands by how sure that is) and patterns.
Lexicons are cross-fitted: what they say of a row comes from the rows of other folds, at
every size of the table.  A generative label model, fitted by expectation-maximisation
from the voters alone, estimates each one's accuracy and how far pairs of them agree
beyond what the label explains; correlated voters share their weight.  Its posterior
labels train a linear classifier over what each lexicon holds of a text, and the
training labels set its scale.  Fitting uses at most `rows` labelled documents, chosen
by hash; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.graph import keep
from loomscan.llm.kernel import _BASE, _BYTE, _LOWER, ALNUM, U64, Words, column, mix, slices

# Words that insult in English.
SEED = "idiot moron stupid dumb loser pathetic worthless trash garbage scum disgusting clown fool hate ugly vile imbecile".split()
#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)
PATTERNS = ("shouting", "exclaiming")


def _features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word index, hash) of every whole word and word beginning."""
    out = [(np.arange(len(words.hashes)), words.hashes)]
    size = words.end - words.start
    for n in PREFIXES:
        at = np.flatnonzero(size >= n)
        h = np.zeros(len(at), U64)
        for k in range(n):
            power = U64(pow(int(_BASE), k + 1, 1 << 64))
            h += _BYTE[_LOWER[words.raw[words.start[at] + k]]] * power
        out.append((at, mix(h ^ U64(n << 56))))
    return out


def _shape(words: Words) -> np.ndarray:
    """A row of pattern values for each text, from 0 to 1."""
    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.append(0, np.cumsum(mask))
        return c[words.offsets[1:]] - c[words.offsets[:-1]]

    upper = per_text((words.raw >= 65) & (words.raw <= 90))
    lower = per_text((words.raw >= 97) & (words.raw <= 122))
    marks = per_text(words.raw == 33)
    many = words.counts >= 5
    return np.stack([many & (upper > lower), many & (10 * marks > words.counts)], axis=1).astype(np.float64)


#: Lexicons: the fixed one, then whole words and word beginnings by the lower bound of their log odds.
LEAST_ODDS = (2.0, 3.0, 4.0)
LEXICONS = 1 + 2 * len(LEAST_ODDS)


@dataclass
class Model:
    """keys: sorted feature hashes; lexicon: the lexicon of each; weight: of each lexicon, by log(1 + distinct features)."""

    keys: np.ndarray
    lexicon: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(LEXICONS))
    shape: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS)))
    bias: float = -3.0
    voters: list[dict] = field(default_factory=list)

    def hits(self, words: Words) -> np.ndarray:
        """How many distinct features of each lexicon each text has."""
        doc, found = words.doc(), []
        for at, h in _features(words):
            if len(h) and len(self.keys):
                i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[i] == h
                found.append(doc[at[hit]] * len(self.keys) + i[hit])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        n = max(1, len(self.keys))
        out = np.bincount(pairs // n * LEXICONS + self.lexicon[pairs % n] if len(pairs) else pairs, minlength=len(words.counts) * LEXICONS)
        return out.reshape(-1, LEXICONS).astype(np.float64)

    def score(self, words: Words) -> np.ndarray:
        z = self.bias + np.log1p(self.hits(words)) @ self.weight + _shape(words) @ self.shape
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class LabelModel:
    """p(label), and p(vote | label) of voters that say -1, 0 or 1, by expectation-maximisation.

    first: a first guess at the labels; prior: the share of rows with the label, if it
    is known.  Each step counts rows by the squares of their odds, which keeps sure ones
    sure.  A vote for the label can't speak against it, nor a vote against it, or
    silence, for it.
    """

    def __init__(self, votes: np.ndarray, first: np.ndarray, prior: float | None = None, rounds: int = 20):
        self.one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
        self.known = prior
        p = first.astype(np.float64)
        for _ in range(rounds):
            self._fit(votes, p)
            new = self.posterior(votes)
            new = new**2 / (new**2 + (1 - new) ** 2)
            if np.abs(new - p).max() < 1e-4:
                break
            p = new

    def _fit(self, votes: np.ndarray, p: np.ndarray) -> None:
        self.prior = np.clip(p.mean() if self.known is None else self.known, 1e-4, 1 - 1e-4)
        table = []
        for q in (1 - p, p):
            t = np.einsum("i,ijv->jv", q, self.one_hot) + 0.5
            table.append(t / t.sum(axis=1, keepdims=True))
        self.table = np.stack(table)  # label, voter, vote
        mean = np.einsum("ljv,v->lj", self.table, np.array([-1.0, 0.0, 1.0]))
        rest = votes - (np.outer(1 - p, mean[0]) + np.outer(p, mean[1]))  # what the label leaves unexplained
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        self.correlation = (rest.T @ rest) / len(votes) / np.outer(scale, scale)
        strong = np.clip(self.correlation - np.eye(len(mean[0])), 0, 1)
        self.share = 1 / (1 + np.where(strong > 0.1, strong, 0).sum(axis=1))
        self.accuracy = (self.prior * self.table[1, :, 2] + (1 - self.prior) * self.table[0, :, 0]) / (self.prior * (self.table[1, :, 2] + self.table[1, :, 0]) + (1 - self.prior) * (self.table[0, :, 2] + self.table[0, :, 0]))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.table[1] / self.table[0]) * self.share[:, None]
        ratio = np.stack([np.minimum(ratio[:, 0], 0), np.minimum(ratio[:, 1], 0), np.maximum(ratio[:, 2], 0)], axis=1)
        z = np.log(self.prior / (1 - self.prior)) + np.einsum("ijv,jv->i", self.one_hot, ratio)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
    """Weights of a linear classifier, by Newton's method; the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-4:
            break
    return w


def _send_features(text: str):
    """(hash, kind, fold, n1, n0): how many labelled and other rows of a batch have each feature."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words = Words(column(part, text), ALNUM)
                doc, toxic, fold = words.doc(), column(part, "toxic").to_numpy(zero_copy_only=False).astype(np.int64), column(part, "fold").to_numpy(zero_copy_only=False).astype(np.int64)
                for kind, (at, h) in enumerate(_features(words)):
                    order = np.lexsort((h, doc[at]))
                    d, h = doc[at][order], h[order]
                    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
                    d, h = d[new], h[new]
                    for f in np.unique(fold[d]).tolist():
                        mine = fold[d] == f
                        keys, inverse = np.unique(h[mine], return_inverse=True)
                        n1, n0 = (np.bincount(inverse, w, len(keys)).astype(np.int64) for w in (toxic[d[mine]], 1 - toxic[d[mine]]))
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(np.full(len(keys), f, np.int32)), pa.array(n1), pa.array(n0)], names=["h", "kind", "fold", "n1", "n0"])

    return each


def _lexicons(h: np.ndarray, kind: np.ndarray, n1: np.ndarray, n0: np.ndarray, rows1: int, rows0: int) -> Model:
    """The lexicons that counts of features among rows with the label and others give."""
    odds = np.log((n1 + 0.5) / (rows1 + 1)) - np.log((n0 + 0.5) / (rows0 + 1))
    least = odds - 1.64 * np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    kept = (n1 >= max(3, rows1 // 400)) & (least >= LEAST_ODDS[0])
    band = np.searchsorted(LEAST_ODDS, least[kept], side="right") - 1
    learnt = dict(zip(h[kept].tolist(), (1 + band + len(LEAST_ODDS) * (kind[kept] > 0)).tolist()))
    learnt |= {w: 0 for w in Words(pa.array([" ".join(SEED)], pa.large_string()), ALNUM).hashes.tolist()}
    keys = np.array(sorted(learnt), U64)
    return Model(keys, np.array([learnt[k] for k in keys.tolist()]))


#: What a hit of each lexicon counts in sums over lexicons.
WORTH = np.array([3.0, *(x + 0.5 for x in LEAST_ODDS), *(x + 0.5 for x in LEAST_ODDS)])


def evidence(hits: np.ndarray) -> np.ndarray:
    """What each lexicon voter goes by: the hits of every lexicon, and sums over words, word beginnings and all."""
    words, beginnings = hits[:, : 1 + len(LEAST_ODDS)] @ WORTH[: 1 + len(LEAST_ODDS)], hits[:, 1 + len(LEAST_ODDS) :] @ WORTH[1 + len(LEAST_ODDS) :]
    return np.column_stack([hits, words, beginnings, words + beginnings])


def rule(x: np.ndarray, toxic: np.ndarray, precision: float = 0.98) -> float:
    """The least evidence from which on at least the share `precision` of labelled rows have the label; infinite if there is none."""
    order = np.argsort(-x, kind="stable")
    right, n = np.cumsum(toxic[order]), np.arange(1, len(x) + 1)
    last = np.append(x[order][1:] != x[order][:-1], True)
    ok = np.flatnonzero(last & (x[order] > 0) & (right >= precision * n) & (right >= 3))
    return float(x[order][ok[-1]]) if len(ok) else np.inf


def fit(hits: np.ndarray, shape: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float, LabelModel]:
    """Weights of the lexicons and patterns, the bias, and the label model behind them.

    The training labels say from how much evidence on each lexicon votes, how frequent
    the label is, and what the classifier's scale is; they don't vote.  The label model
    begins with the rows of which some lexicon is sure, and its posterior is what the
    classifier learns.
    """
    x = evidence(hits)
    sure = np.where(x >= np.array([rule(c, toxic) for c in x.T]), 1, 0)
    none = np.where(hits.sum(axis=1) == 0, -1, 0)
    said = np.column_stack([sure, np.where(shape > 0, 1, 0), none])
    model = LabelModel(said, (sure > 0).any(axis=1), float(toxic.mean()))
    x = np.hstack([np.log1p(hits), shape])
    w = _logistic(x, model.posterior(said), penalty=1.0)
    z = x @ w[:-1] + w[-1]
    scale = _logistic(z[:, None], toxic.astype(np.float64), penalty=0.01)
    slope = max(float(scale[0]), 0.1)
    return w[:-1] * slope, float(w[-1] * slope + scale[1]), model


def _hits_of(text: str, models: list[Model]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words, fold = Words(column(part, text), ALNUM), column(part, "fold").to_numpy(zero_copy_only=False)
                every = np.stack([m.hits(words) for m in models])[fold, np.arange(part.num_rows)]
                rows = np.hstack([every, _shape(words)])
                yield pa.RecordBatch.from_arrays([column(part, "toxic").cast(pa.int32()), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    return each


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = 20_000, folds: int = 5) -> Model:
    """Fits the model on labelled rows whose crc32(key as text) mod 5 isn't 0.

    At most `rows` labelled keys, those with the least hashes, are used; keys with
    labels that contradict one another or are null are left out, and of rows with one
    key the least text counts.  A feature counts from three labelled rows on, or one in
    400 of them; what the driver and the tasks hold is bounded by the words of `rows`
    documents.  Without any toxic or any clean row the fixed lexicon alone scores.
    """
    spark = docs.sparkSession
    none = np.zeros(0, np.int64)
    fixed = _lexicons(none.view(U64), none, none, none, 0, 0)
    fixed.weight[0] = 4.5 / np.log(2)
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (F.crc32(F.col(key).cast("string")) % 5 != 0))
    usable = usable.groupBy(F.col(key).alias("id")).agg(F.min(label).alias("toxic"), F.max(label).alias("other")).where("toxic = other")
    chosen = [(r.id, int(r.toxic)) for r in usable.orderBy(F.xxhash64("id"), "id").limit(rows).collect()]
    if len({t for _, t in chosen}) < 2:
        return fixed
    kind = docs.schema[key].dataType
    few = F.broadcast(spark.createDataFrame(chosen, f"id {labels.schema[key].dataType.simpleString()}, toxic int"))  # at most `rows` rows
    joined = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias(text)).join(few.withColumn("id", F.col("id").cast(kind)), "id")
    joined = keep(joined.groupBy("id", "toxic").agg(F.min(text).alias(text)).withColumn("fold", F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("id").cast("string"))), F.lit(folds)).cast("int")))

    total = {r.fold: (r.n1, r.n) for r in joined.groupBy("fold").agg(F.sum("toxic").alias("n1"), F.count("*").alias("n")).collect()}
    n1 = np.array([total.get(f, (0, 0))[0] for f in range(folds)])
    n0 = np.array([total.get(f, (0, 0))[1] for f in range(folds)]) - n1
    if not n1.sum() or not n0.sum():
        return fixed
    in_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for c in ("n1", "n0") for f in range(folds)]
    counted = joined.select("toxic", "fold", text).mapInArrow(_send_features(text), "h long, kind int, fold int, n1 long, n0 long").groupBy("h", "kind").agg(*in_fold)
    every = " + ".join(f"n1_{f}" for f in range(folds))
    seen = counted.where(f"{every} >= 3").toPandas()  # bounded by the words of `rows` documents
    h, kinds = seen["h"].to_numpy(np.int64).view(U64), seen["kind"].to_numpy()
    c1, c0 = (np.stack([seen[f"{c}_{f}"].to_numpy(np.int64) for f in range(folds)]) for c in ("n1", "n0"))
    apart = [_lexicons(h, kinds, c1.sum(axis=0) - c1[f], c0.sum(axis=0) - c0[f], int(n1.sum() - n1[f]), int(n0.sum() - n0[f])) for f in range(folds)]

    held = joined.select("toxic", "fold", text).mapInArrow(_hits_of(text, apart), "toxic int, x array<double>").toPandas()  # at most `rows` rows of numbers
    x = np.array(held["x"].tolist())
    weights, bias, labelled = fit(x[:, :LEXICONS], x[:, LEXICONS:], held["toxic"].to_numpy())
    model = _lexicons(h, kinds, c1.sum(axis=0), c0.sum(axis=0), int(n1.sum()), int(n0.sum()))
    model.weight, model.shape, model.bias = weights[:LEXICONS], weights[LEXICONS:], bias
    model.voters = [{"accuracy": float(a), "share": float(s)} for a, s in zip(labelled.accuracy, labelled.share)]
    return model


def _score(text: str, keep_: list[str], shared):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                score = shared.value.score(Words(column(part, text), ALNUM))
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in keep_), pa.array(score)], names=[*keep_, "toxicity"])

    return each


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and toxicity, from 0 to 1, for every row.

    Null and empty texts get the score of a text without features.  Rows are scored one
    by one, so repeated rows get equal scores and ties can't matter.  The score depends
    on the text alone.  It takes the place of a kept column named toxicity.
    """
    keep = tuple(c for c in keep if c != "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [*dict.fromkeys([*keep, text])]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    out = docs.select(*columns).mapInArrow(_score(text, columns, shared), ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "toxicity double"]))
    return out.select(*keep, "toxicity")
