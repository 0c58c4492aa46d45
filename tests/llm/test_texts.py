"""Operators on texts against brute-force versions, and on messy and empty tables."""

import math
from collections import Counter

import pytest

from loomscan.llm import decontam, exchange, jaccard, licenses, lm

from .helpers import ALNUM, MESSY, SOLID, documents, prose, words


def shingles(text):
    w = words(text, SOLID)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets, root = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies():
    texts, k = [], 0
    for base in range(12):
        w = prose(base, 60 + 25 * base).split()
        for copy in range(9):
            v = list(w)
            for j in range(copy // 2):
                v[(copy * 17 + j * 23) % len(v)] = f"edit{copy}x{j}"
            texts.append((k, " ".join(v)))
            k += 1
    common = prose(99, 30)
    texts += [(k + i, common + " " + prose(200 + i, 20 + i)) for i in range(25)]
    return texts + [(k + 100 + i, t) for i, t in enumerate(["one two", "ONE  two", "one", "", "a b c d e", "a b c d e f"])]


def test_jaccard_finds_what_brute_force_finds(spark):
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard.jaccard_groups(documents(spark, texts).repartition(3)).collect()}
    assert got == components(texts)


def test_jaccard_chain_is_one_component(spark):
    # Each text is linked with its neighbours only, and their common texts are frequent.
    w = prose(5, 200, 100000).split()
    texts = [(i, " ".join(w[: 3 * i] + [f"x{i}y{j}" for j in range(0)] + w[3 * i :][: 150])) for i in range(8)]
    got = {r.doc_id: r.component for r in jaccard.jaccard_groups(documents(spark, texts)).collect()}
    assert got == {k: v[1] for k, v in components(texts).items()}


def test_jaccard_tells_texts_under_one_id_apart(spark):
    a, b = prose(11, 80, 10**6).split(), prose(12, 80, 10**6).split()
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, near(a)), (3, near(b)), (9, "alone with this id"), (9, "alone with this id")]
    got = Counter((r.doc_id, r.n_shingles, r.component) for r in jaccard.jaccard_groups(documents(spark, rows)).collect())
    n = 76
    assert got == Counter({(5, n, 2): 1, (5, n, 3): 1, (2, n, 2): 1, (3, n, 3): 1, (9, 1, 9): 2})


def test_jaccard_passage_that_thousands_share(spark, monkeypatch):
    # A passage of 40 words in all texts, which else have nothing in common but for some near copies.
    common, texts = prose(1, 40, 10**6), []
    for i in range(1500):
        w = prose(10_000 + i, 60 + i % 40, 10**7).split()
        texts.append((i, common + " " + " ".join(w)))
        if i % 50 == 0:
            texts.append((10_000 + i, common + " " + " ".join([*w[:-1], "other"])))
    monkeypatch.setattr(jaccard, "PART_ROWS", 100)
    got = {r.doc_id: r.component for r in jaccard.jaccard_groups(documents(spark, texts).repartition(4)).collect()}
    assert got == {i: (i - 10_000 if i >= 10_000 else i) for i, _ in texts}


def test_jaccard_column_in_many_components_is_multiplied_in_parts(spark, monkeypatch):
    # Pairs of near copies that all share three quarters of their words: candidates of one another, but no links.
    common, texts = prose(3, 150, 10**6).split(), []
    for i in range(40):
        own = prose(500 + i, 60, 10**7).split()
        texts += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common + own[:-1] + [f"end{i}"]))]
    monkeypatch.setattr(jaccard, "PART_ROWS", 8)
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard.jaccard_groups(documents(spark, texts)).collect()}
    assert got == components(texts)


def test_overlaps_are_accumulated_over_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2))
    sets = {bytes([i]): np.sort(np.unique(np.concatenate([base[i * 7 : 360 + i], rng.integers(0, 2**63, 40, dtype=np.uint64)]))) for i in range(6)}
    rows = [((int(k[0]), bytearray(k)), len(v), [len(b) for b in jaccard._cut(v)], [bytearray(jaccard.pack_sorted(b)) for b in jaccard._cut(v)]) for k, v in sets.items()]
    table = spark.createDataFrame(rows, jaccard.sets_schema(jaccard.node_type("bigint")))
    pairs = [(a, b) for a in sets for b in sets if a < b]
    entries = spark.createDataFrame([((a[0], bytearray(a)), (b[0], bytearray(b)), len(sets[a]), len(sets[b])) for a, b in pairs], "a struct<rep:bigint,digest:binary>, b struct<rep:bigint,digest:binary>, n long, m long")
    got = {(bytes(r.a.digest), bytes(r.b.digest)): r.both for r in jaccard.overlaps(entries, table, 80).collect()}
    both = {p: len(np.intersect1d(sets[p[0]], sets[p[1]])) for p in pairs}
    assert got == {p: n for p, n in both.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)} and 0 < len(got) < len(pairs)


def test_jaccard_group_of_many_copies_with_edits(spark):
    w = prose(7, 150, 100000).split()
    texts = []
    for i in range(60):
        v = list(w)
        for j in range(i % 6):
            v[(7 * i + 31 * j) % 150] = f"e{(i * j) % 9}"
        texts.append((i, " ".join(v)))
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard.jaccard_groups(documents(spark, texts)).collect()}
    assert got == components(texts)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(spark, order):
    texts = [(i, prose(i, 30, 12)) for i in range(20)] + [(50, ""), (51, "alone")]
    counts = [Counter() for _ in range(order + 1)]
    for _, t in texts:
        w = words(t)
        for n in range(1, order + 1):
            counts[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(counts[1].values())

    def log(context, w):
        if not context:
            return math.log(counts[1][(w,)] / total)
        c = counts[len(context) + 1][(*context, w)]
        return math.log(c / counts[len(context)][tuple(context)]) if c >= 2 else math.log(0.4) + log(context[1:], w)

    for r in lm.stupid_backoff(documents(spark, texts), order=order).collect():
        w = words(dict(texts)[r.doc_id])
        expected = sum(round(1e6 * log(w[max(0, i - order + 1) : i], w[i])) for i in range(len(w)))
        assert r.n_words == len(w) and abs(r.micro - expected) <= 1
        assert (r.score is None) == (not w)


def test_backoff_doesnt_depend_on_how_texts_are_read(spark, monkeypatch):
    docs = documents(spark, [(i % 7, prose(i, 50, 30)) for i in range(60)] + [(None, prose(3, 20, 30)), (1, None)])
    once = sorted(lm.stupid_backoff(docs.coalesce(1), order=3).collect(), key=str)
    monkeypatch.setattr(lm, "UNIT_BYTES", 100)
    monkeypatch.setattr(lm, "BATCH_ROWS", 7)
    assert sorted(lm.stupid_backoff(docs.repartition(5), order=3).collect(), key=str) == once
    assert lm.stupid_backoff(docs.limit(0)).count() == 0


@pytest.mark.parametrize("plan", [exchange.Plan(64, 1, 64), exchange.Plan(5, 4, 64)])
def test_dealing_by_groups_of_units_changes_nothing(spark, monkeypatch, plan):
    texts = near_copies()
    docs = documents(spark, texts).repartition(7)
    monkeypatch.setattr(exchange, "plan_for", lambda df: plan)
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard.jaccard_groups(docs).collect()}
    assert got == components(texts)
    assert jaccard.jaccard_groups(docs.limit(0)).count() == 0


def test_plan_follows_the_size_of_the_input(spark):
    class Sized:
        sparkSession = spark

        def __init__(self, size):
            self.size = size

        @property
        def _jdf(self):
            return self

        queryExecution = optimizedPlan = stats = lambda self: self

        def sizeInBytes(self):
            return self.size

    assert exchange.plan_for(Sized(0)) == exchange.Plan(64, 1, 64)
    assert exchange.plan_for(Sized(32 << 30)) == exchange.Plan(8192, 1, 8192)
    assert exchange.plan_for(Sized(100 << 40)) == exchange.Plan(8192, 3200, 100 << 18)


def hits(text, items, window=13):
    w, found, ids = words(text), set(), set()
    for key, item in items:
        v = words(item)
        m = min(window, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            for k in range(len(w) - m + 1):
                if w[k : k + m] == v[i : i + m]:
                    found.update(range(k, k + m))
                    ids.add(str(key))
    return len(w), len(found), sorted(ids)


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_decontamination(spark, block):
    items = [(i, prose(1000 + i, 14 + i)) for i in range(12)] + [(20, "Solo"), (21, "two words"), (22, None), (23, ""), (24, prose(1000, 20))]
    texts = [(i, prose(i, 300) + (" " + items[i % 12][1] + " " + prose(i + 7, 40) if i % 3 else "")) for i in range(20)]
    texts += [(40, "solo SOLO, two words two"), (41, " ".join(words(items[3][1])[:12])), (42, prose(3, 5000) + " " + items[5][1]), *[m for m in MESSY if m[0] is not None and m[0] != 8]]
    texts = [(100 + i, t) for i, (_, t) in enumerate(texts)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for r in decontam.judged(decontam.decontaminate(documents(spark, texts), benchmark, block_bytes=block)).collect():
        n, hit, ids = hits(dict(texts)[r.doc_id], items)
        assert (r.n_words, r.n_hit, list(r["items"])) == (n, hit, ids)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_blocks_of_a_benchmark_are_branches(spark):
    # A worker holds one block: no pass over the documents feeds another one.
    benchmark = spark.createDataFrame([(i, prose(500 + i, 20)) for i in range(30)], "item_id long, text string")
    out = decontam.decontaminate(documents(spark, [(1, prose(501, 20) + " " + prose(7, 30) + " " + prose(502, 20))]), benchmark, block_bytes=1)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    passes = [i for i, line in enumerate(plan) if "MapInArrow" in line]
    assert len(passes) == 30
    for i in passes:
        below = next((k for k in range(i + 1, len(plan)) if depth[k] <= depth[i]), len(plan))
        assert not any("MapInArrow" in line for line in plan[i + 1 : below])
    (row,) = out.collect()
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(0, 20), (50, 70)] and list(row["items"]) == ["1", "2"]


def test_windows_over_several_blocks_make_one_run(spark):
    words_ = prose(77, 40).split()
    items = [(i, " ".join(words_[a : a + 14])) for i, a in enumerate((0, 5, 14, 26))]
    got = decontam.decontaminate(documents(spark, [(1, " ".join(words_)), (1, " ".join(words_)), (None, None)]), spark.createDataFrame(items, "item_id long, text string"), keep=("text", "doc_id"), block_bytes=1).collect()
    assert sorted((r.doc_id or 0, r.n_words, [(s["start"], s["end"]) for s in r["spans"]]) for r in got) == [(0, 0, []), (1, 40, [(0, 40)]), (1, 40, [(0, 40)])]


def test_decontamination_of_windows_that_share_their_end(spark):
    # Many windows end in the same words, so one bucket holds them all; only one of them occurs.
    end = "the very same last words here now".split()
    items = [(i, " ".join([*prose(900 + i, 13 - len(end), 10**6).split(), *end])) for i in range(50)]
    texts = [(1, prose(1, 100) + " " + items[17][1] + " " + prose(2, 100)), (2, prose(3, 100) + " " + " ".join(end)), (3, " ".join(w for _, t in items for w in t.split()))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in decontam.judged(decontam.decontaminate(docs, benchmark, keep=("doc_id", "items", "n_words"))).collect()}
    for i, t in texts:
        assert (got[i].n_words, got[i].n_hit, list(got[i]["items"])) == hits(t, items)


def test_licenses(spark):
    texts = ["Released under the MIT License.", "text\nLicensed under the APACHE license, version 2.0\nmore", "released under  the mit -- license", "under the mit\nlicense", "This work is licensed under the GNU General Public License, version 3.", "no license here", "cc by nc cc by nc", None, ""]
    rows = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        places = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert [(p.word, p.label) for p in rows[i].phrases] == places and rows[i].n_words == len(w)
        expected = set()
        for line in (t or "").split("\n"):
            have = set(words(line))
            expected |= {label for label, x in licenses.TEMPLATES if 5 * len(have & set(words(x))) >= 4 * len(set(words(x)))}
        assert {b.label for b in rows[i].blocks} == expected


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
APACHE = """# Licensed under the Apache License,
# Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 */"""


def test_wrapped_licenses(spark):
    sentence = "released under the BSD License"
    broken = [sentence.replace(" ", "\n", k) for k in range(1, 5)]
    texts = [MIT, APACHE, GPL, *broken, prose(1, 900) + "\n" + MIT + "\n" + prose(2, 900), "released under\n" + prose(3, 40) + "\nthe BSD License", sentence + "\n" + prose(4, 30) + "\n" + broken[0], "released under the", "BSD License", None, "", prose(5, 50)]
    rows = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts).coalesce(1), wrapped=True).collect()}
    lines = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, expected = words(t), {b.label for b in lines[i].blocks}
        for label, x in licenses.TEMPLATES:
            v, size = set(words(x)), math.ceil(len(words(x)) / 0.8 - 1e-9)
            if any(5 * len(v & set(w[k : k + size])) >= 4 * len(v) for k in range(len(w))):
                expected.add(label)
        assert {b.label for b in rows[i].blocks} == expected
        assert set(lines[i].blocks) <= set(rows[i].blocks)
        for b in rows[i].blocks:
            assert b.containment >= 0.8 and set(w[b.word : b.word + b.words]) & {y for label, x in licenses.TEMPLATES if label == b.label for y in words(x)}
    assert [{b.label for b in rows[i].blocks} for i in (0, 1, 2, 3, 7)] == [{"mit"}, {"apache-2"}, {"gpl"}, {"bsd", "mit"}, {"mit"}]  # the BSD sentence has four of the five words of MIT's, on one line as well
    assert len(rows[1].blocks) == 2 and lines[0].blocks == lines[1].blocks == []
    assert rows[8].blocks == [] and len(rows[9].blocks) == 4 and all(not rows[i].blocks for i in (10, 11, 12, 13, 14))


@pytest.mark.parametrize("rows", [MESSY, []])
def test_messy_and_empty(spark, rows):
    docs = documents(spark, rows)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.jaccard_groups(docs).count() == len(rows)
    assert lm.stupid_backoff(docs).count() == len(rows)
    assert decontam.judged(decontam.decontaminate(docs, benchmark)).where("not contaminated").count() == len(rows)
    assert licenses.scan_licenses(docs).count() == len(rows)
    if rows:
        got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard.jaccard_groups(docs).collect()}
        assert got[None] == (3, None) and got[5] == (1, 4) and got[1] == (0, 1) and got[8] == (3, 8)
        n = {r.doc_id: r.n_words for r in lm.stupid_backoff(docs).collect()}
        assert n[6] == len(ALNUM.findall(dict(rows)[6])) and n[1] == 0
