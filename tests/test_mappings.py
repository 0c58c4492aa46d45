"""Mappings as tables against a reader that goes through them one by one."""

import random

from pyspark.sql import functions as F

from loomscan.functions import scanners
from loomscan.operators import mappings


def texts(seed, n):
    r = random.Random(seed)
    return [None, "", ";;", "AAAA", ",AAAA,", "A,AA,AAAA", "AAA,AAAA;AAAA", "gggggggggC", "ggggggggC,ggggggD", "AAAAAgg", "AAAAA!", "!", "g"] + ["".join(r.choice("AACCDEFabz09gh+/,,,;!" if i % 3 else "AACCDEFDg,,,;") for _ in range(r.randrange(120))) for i in range(n)]


def table(spark, given, minified=None):
    return spark.createDataFrame([(i, m, minified[i] if minified else None) for i, m in enumerate(given)], "id int, mappings string, minified string").repartition(3)


def test_segments_are_those_of_a_reader(spark, monkeypatch):
    monkeypatch.setattr(mappings, "BLOCK", 3)
    given = texts(1, 400)
    got = {}
    for r in mappings.segments(table(spark, given), "id").orderBy("id", "gen_line", "place").collect():
        got.setdefault(r.id, []).append((r.gen_line, r.gen_col, r.src, r.src_line, r.src_col, r.name))
    for i, m in enumerate(given):
        assert got.get(i, []) == scanners.mappings(m or ""), m


def test_numbers_are_those_of_a_reader(spark):
    given = [m for m in texts(2, 600) if m and "," not in m and ";" not in m] + ["A", "C", "D", "gB", "gC", "2H", "//////D", "+/////B"]
    got = table(spark, given).select("id", mappings.decoded(F.col("mappings")).alias("d")).collect()
    for r in got:
        first = scanners.vlq(given[r.id])
        assert (r.d["values"][0] if r.d["values"] else None) == (first[0] if first else None), given[r.id]


def test_rebuilt_sources_are_those_of_a_reader(spark):
    r = random.Random(3)
    scripts = ["\n".join("".join(r.choice("abcä🙂 ") for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 5))) for _ in range(413)]
    given = texts(4, 400)
    got = {(x.id, x.src): x.content for x in mappings.rebuilt(table(spark, given, scripts), "id").collect()}
    expected = {}
    for i, m in enumerate(given):
        for src, rows in scanners.by_source([g for g in scanners.mappings(m or "")]).items():
            if any(0 <= g[0] < len(scripts[i].split("\n")) for g in rows):
                expected[i, src] = scanners.rebuilt([(g[0], max(g[1], 0), *g[2:]) for g in rows], scripts[i].split("\n"))
    assert got == expected


def test_mappings_have_no_python_in_their_plan(spark):
    plan = mappings.rebuilt(table(spark, ["AAAA"], ["x"]), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_segments_are_told_from_broken_ones_without_reading_them(spark):
    given = [s for m in texts(5, 300) if m for s in m.replace(";", ",").split(",") if s] + ["A\nAA", "AAAAA\n", "A\n", "AAAA\n", "fghA", "ABCDEF", "gggggggA"]
    rows = table(spark, given).select(F.col("mappings").rlike(mappings._GOOD).alias("good"), mappings.decoded(F.col("mappings"))["good"].alias("read"))
    assert rows.where("good <> read").count() == 0
    plan = mappings.segments(table(spark, given), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 2  # once for the sums, once for the mappings
