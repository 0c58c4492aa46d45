"""License scans: a set-similarity join of a document's text blocks with license templates.

A block is a line of a document.  It matches a template if it holds at least the
threshold's share of the template's distinct words.  Words are ordered by their
frequency over the blocks of the whole corpus, rarest first; of a template with t words
of which o are needed, a matching block has one of the first t - o + 1.  Blocks with
such a word and at least o words are followed through the template's order and given up
as soon as the words left can't make up o.

Wrapped texts don't keep to lines: on request passages are looked for as well, stretches
of any lines in which a window of the template's length over the threshold holds o of
its words.  The same three filters hold for windows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.kernel import ALNUM, U64, Words, column, slices

# Phrases whose words have to stand side by side, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Sentences that declare a license, and its label.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "released under the BSD License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "dedicated to the public domain under the CC0 1.0 Universal waiver"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without written permission"),
]


def _hashes(text: str) -> np.ndarray:
    return Words(pa.array([text], pa.large_string()), ALNUM).hashes


class Templates:
    """Templates as word numbers in the order of the words' frequency."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float, counts: dict[int, int] | None = None):
        sets = [set(_hashes(t).tolist()) for _, t in templates]
        counts = counts or {}
        words = sorted(set().union(*sets), key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(words)}
        self.labels = [label for label, _ in templates]
        self.orders = [sorted(rank[w] for w in s) for s in sets]
        self.needed = [max(1, math.ceil(threshold * len(o) - 1e-9)) for o in self.orders]
        #: words of a window: the whole template, and as much else as the threshold leaves
        self.window = [math.ceil(len(_hashes(t)) / max(threshold, 0.1) - 1e-9) for _, t in templates]
        keys = np.array(words, U64)
        self.sorted = np.sort(keys)
        self.rank = np.argsort(keys)
        #: word number -> templates that have it in their prefix
        self.prefix: dict[int, list[int]] = {}
        for t, (order, o) in enumerate(zip(self.orders, self.needed)):
            for w in order[: len(order) - o + 1]:
                self.prefix.setdefault(w, []).append(t)
        self.rare = np.zeros(len(words), bool)
        self.rare[list(self.prefix)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 for words of no template."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[i] == hashes, self.rank[i], -1)

    def containment(self, block: set[int], t: int) -> float:
        """The share of template t in the block, 0 if below the threshold."""
        order, o, have = self.orders[t], self.needed[t], 0
        for i, w in enumerate(order):
            have += w in block
            if have + len(order) - i - 1 < o:
                return 0.0
        return have / len(order)


def blocks(words: Words) -> np.ndarray:
    """The number of the block of each word."""
    ends = np.flatnonzero(words.raw == 10)
    lines = np.searchsorted(ends, words.start)
    doc = words.doc()
    new = np.append(True, (lines[1:] != lines[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
    return np.cumsum(new) - 1


def passages(number: np.ndarray, doc: np.ndarray, templates: Templates) -> Iterator[tuple[int, int, int, float]]:
    """First word, end, template and share of every stretch where windows hold enough of a template.

    A window that ends at a template word holds all template words of any window that
    has this one last, so windows that end there are all that need a look.
    """
    known = np.flatnonzero(number >= 0)
    for t, (order, o) in enumerate(zip(templates.orders, templates.needed)):
        if not order:
            continue
        member, prefix = np.zeros(len(templates.rare), bool), np.zeros(len(templates.rare), bool)
        member[order], prefix[order[: len(order) - o + 1]] = True, True
        at = known[member[number[known]]]
        low = np.searchsorted(at, np.maximum(at - templates.window[t] + 1, np.searchsorted(doc, doc[at])))
        rare = np.concatenate([[0], np.cumsum(prefix[number[at]])])
        here = np.arange(len(at))
        span: tuple[int, int, float] | None = None
        for j in np.flatnonzero((here - low + 1 >= o) & (rare[here + 1] > rare[low])).tolist():
            held = number[at[low[j] : j + 1]].tolist()
            if not (share := templates.containment(set(held), t)):
                continue
            # Words that come again later in the window don't begin it.
            k = next(i for i, w in enumerate(held) if w not in held[i + 1 :])
            begin, end = int(at[low[j] + k]), int(at[j]) + 1
            if span and begin < span[1]:
                span = (min(begin, span[0]), end, max(share, span[2]))
                continue
            if span:
                yield span[0], span[1], t, span[2]
            span = (begin, end, share)
        if span:
            yield span[0], span[1], t, span[2]


def _frequencies(text: str, templates: list[tuple[str, str]]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, 1.0)
        total = np.zeros(len(known.sorted), np.int64)
        for batch in batches:
            for part in slices(batch, text):
                words = Words(column(part, text), ALNUM)
                n = known.numbers(words.hashes)
                at = np.flatnonzero(n >= 0)
                pairs = np.unique(blocks(words)[at] * len(total) + n[at])
                total += np.bincount(pairs % len(total), minlength=len(total)) if len(total) else 0
        byte = known.sorted[np.argsort(known.rank)]
        yield pa.RecordBatch.from_arrays([pa.array(byte.view(np.int64)), pa.array(total)], names=["w", "n"])

    return each


def _scan(text: str, key: str, phrases: dict[str, str], templates: Templates, wrapped: bool):
    lists = [(_hashes(p), p.encode(), label) for p, label in phrases.items()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words = Words(column(part, text), ALNUM)
                doc, rows = words.doc(), part.num_rows
                places = [[] for _ in range(rows)]
                found: list[list[dict]] = [[] for _ in range(rows)]
                for h, spelled, label in lists:
                    n = len(h)
                    at = np.flatnonzero(words.hashes[: max(0, len(doc) - n + 1)] == h[0])
                    for k in range(1, n):
                        at = at[words.hashes[at + k] == h[k]]
                    for i in at[doc[at] == doc[at + n - 1]].tolist():
                        if words.phrase(i, n) == spelled:
                            d = int(doc[i])
                            places[d].append({"word": i - int(words.first[d]), "label": label})
                number, block = templates.numbers(words.hashes), blocks(words)
                rare = np.flatnonzero((number >= 0) & templates.rare[number]) if len(templates.rare) else number[:0]
                whole: set[tuple[int, int]] = set()
                candidates = {(b, t) for b, w in zip(block[rare].tolist(), number[rare].tolist()) for t in templates.prefix[w]}
                if candidates:
                    last = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block))
                    known: dict[int, set[int]] = {}
                    for b, t in sorted(candidates):
                        begin, end = int(last[b - 1]) if b else 0, int(last[b])
                        if end - begin < templates.needed[t]:
                            continue
                        if b not in known:
                            known = {b: set(number[begin:end].tolist())}
                        if share := templates.containment(known[b], t):
                            d = int(doc[begin])
                            whole.add((b, t))
                            found[d].append({"word": begin - int(words.first[d]), "words": end - begin, "label": templates.labels[t], "containment": share})
                for begin, end, t, share in passages(number, doc, templates) if wrapped else ():
                    # Within one line, or around a line that was found for itself, it is no find of its own.
                    if not any((b, t) in whole for b in range(int(block[begin]), int(block[end - 1]) + 1)):
                        d = int(doc[begin])
                        found[d].append({"word": begin - int(words.first[d]), "words": end - begin, "label": templates.labels[t], "containment": share})
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, key),
                        pa.array(words.counts.astype(np.int64)),
                        pa.array([sorted(p, key=lambda x: (x["word"], x["label"])) for p in places], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                        pa.array(found, pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))),
                    ],
                    names=[key, "n_words", "phrases", "blocks"],
                )

    return each


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, wrapped: bool = False) -> DataFrame:
    """key, n_words, phrases and blocks for every document.

    phrases: every place (word, from 0) of a phrase, and its label; blocks: every line
    that holds at least threshold of a template's distinct words, with its first word,
    its words, the label and the share.  wrapped: also every passage over line breaks that
    holds that much of a template within the template's number of words over threshold
    (at least 0.1), unless one of its lines is such a block itself.  Frequencies are counted over all documents
    first; they order the template words and don't change what is found.  Null and empty
    texts have no words; repeated rows are scanned one by one, null keys passed on.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    # One row for each word of a template and task, added up: bounded by the templates.
    counted = docs.select(text).mapInArrow(_frequencies(text, templates), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    counts = {int(np.int64(r.w).view(U64)): r.n for r in counted}
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, phrases array<struct<word:long,label:string>>, blocks array<struct<word:long,words:long,label:string,containment:double>>"
    return docs.select(key, text).mapInArrow(_scan(text, key, phrases, Templates(templates, threshold, counts), wrapped), schema)
