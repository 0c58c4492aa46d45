"""Whole scans, their replay, redirects, failed starts, flight payloads, marks, and the command line."""

import pytest
from pyspark.sql import functions as F

from loomscan.__main__ import main
from loomscan.functions.registered import register
from loomscan.operators import sourcemaps
from loomscan.operators.discover import discover
from loomscan.operators.extract import Registry
from loomscan.plans import report
from loomscan.scan import scan
from loomscan.sources.bodies import Bodies
from loomscan.sources.shared import Grown
from loomscan.sources.store import Store

MAP = '{"version":3,"sources":["src/a.ts","src/b.ts"],"sourcesContent":["A",null],"mappings":"AAAA"}'
BARE = '{"version":3,"sources":["src/c.ts"],"mappings":"AAAA"}'
SITE = [
    ("https://s.test", 200, "text/html", '<script src="a.js"></script><script src="b.js"></script><script src="c.js"></script>'),
    ("https://s.test/a.js", 200, "text/javascript", "x\n//# sourceMappingURL=m/a.map"), ("https://s.test/m/a.map", 200, "application/json", MAP),
    ("https://s.test/b.js", 200, "text/javascript", "bbb"), ("https://s.test/b.js.map", 200, "application/json", BARE),
    ("https://s.test/c.js", 200, "text/javascript", "c"), ("https://s.test/c.js.map", 200, "text/html", MAP),
]
FEW = Registry().only("HTMLScriptPlugin", "SourceMapPlugin", "DynamicImportPlugin")


def table(spark, rows, *more):
    return spark.createDataFrame(rows, ", ".join(["url string, status int, content_type string, text string", *more]))


def starts(spark, *urls):
    return spark.createDataFrame([(u, u) for u in urls], "scan string, start string")


def replayed(result):
    return sorted(r.scan for r in result.replayed.collect())


def test_scan_and_replay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    asked, responses = starts(spark, "https://s.test"), table(spark, SITE)
    result = scan(asked, responses, FEW, store=store)
    js = {r.url: r for r in result.js.collect()}
    assert {u: r.map_url for u, r in js.items()} == {"https://s.test/a.js": "https://s.test/m/a.map", "https://s.test/b.js": "https://s.test/b.js.map", "https://s.test/c.js": None}
    assert [js[u].n_sources for u in sorted(js)] == [1, 1, 0]
    files = {(r.path, r.mode): r.content for r in result.sources.collect()}
    assert files[("src/a.ts", "sourcesContent")] == "A" and files[("src/c.ts", "mappings")].endswith("bbb")
    assert result.summary().first().asDict() == {"scan": "https://s.test", "js_count": 3, "map_count": 2, "source_count": 2, "sources_omitted": 0}
    assert replayed(result) == []
    again = scan(asked, responses.limit(0), FEW, store=store)
    assert replayed(again) == ["https://s.test"]
    assert sorted(again.js.drop("seq").collect()) == sorted(result.js.drop("seq").select(again.js.drop("seq").columns).collect())
    # One more start: it alone is discovered.
    both = scan(starts(spark, "https://s.test", "https://t.test"), table(spark, [("https://t.test", 200, "text/html", '<script src="/t.js"></script>'), ("https://t.test/t.js", 200, "text/javascript", "t")]), FEW, store=store)
    assert {r.url for r in both.js.collect()} == set(js) | {"https://t.test/t.js"} and replayed(both) == ["https://s.test"]
    # What the store may not read is discovered anew; what it may not write is not kept.
    blind = scan(asked, responses, FEW, store=Store(spark, str(tmp_path / "store"), reads=False))
    assert replayed(blind) == [] and blind.js.count() == 3
    scan(starts(spark, "https://u.test"), table(spark, [("https://u.test", 200, "text/html", '<script src="/u.js"></script>'), ("https://u.test/u.js", 200, "text/javascript", "u")]), FEW, store=Store(spark, str(tmp_path / "store"), writes=False))
    assert store.read("js").where("scan = 'https://u.test'").isEmpty()


def test_chain_of_imports_is_walked_to_its_end(spark):
    n = 4
    rows = [("https://s.test", 200, "text/html", '<script src="/0.js"></script>')] + [(f"https://s.test/{i}.js", 200, "text/javascript", f'import("/{i + 1}.js")') for i in range(n)]
    few = Registry().only("HTMLScriptPlugin", "DynamicImportPlugin")
    assert discover(starts(spark, "https://s.test"), table(spark, rows), few).js_entries.count() == n
    with pytest.raises(RuntimeError, match="left after 3 rounds"):
        discover(starts(spark, "https://s.test"), table(spark, rows), few, max_rounds=3)


def test_grown_tables_keep_all_parts(spark):
    grown = Grown(most=3)
    for i in range(17):
        grown.add(spark.range(i, i + 1))
    assert sorted(r.id for r in grown.table().collect()) == list(range(17))
    assert sum(len(level) for level in grown._levels) <= 6


def test_redirects_and_failures(spark):
    rows = [("https://old.test/x", 200, "text/html", '<script src="a.js"></script><script src="/moved.js"></script>', "https://new.test/app/p.html"), ("https://new.test/app/a.js", 200, "text/javascript", 'import("http://localhost:3000/l.js")', None), ("https://new.test/moved.js", 200, "text/javascript", 'import("/final.js")', "https://new.test/final.js"), ("https://new.test/l.js", 200, "text/javascript", "l", None), ("https://new.test/final.js", 200, "text/javascript", "f", None), ("https://bad.test", 500, "text/html", "e", None)]
    out = discover(starts(spark, "https://old.test/x", "https://bad.test", "https://none.test"), table(spark, rows, "final_url string"), FEW)
    assert sorted(r.url for r in out.js_entries.collect()) == [f"https://new.test/{p}" for p in ("app/a.js", "final.js", "l.js")]
    assert {(r.start, r.status) for r in out.failed.collect()} == {("https://bad.test", 500), ("https://none.test", None)}


def test_flight_payloads_and_marks(spark):
    rows = [
        ("https://n.test", 200, "text/html", "<script>__NEXT_DATA__</script>", ""), ("https://n.test", 200, "text/x-component", '1:I[1,["1","/_next/static/chunks/f.js"]]', "RSC"), ("https://n.test/_next/static/chunks/f.js", 200, "text/javascript", "f", ""),
        ("https://m.test", 200, "text/html", '<script src="/run.js"></script><script src="/use.js"></script>', ""), ("https://m.test/run.js", 200, "text/javascript", 'webpackJsonp;import("/late.js");x+".abc123def.1612345678901.js"', ""),
        ("https://m.test/late.js", 200, "text/javascript", 'webpackJsonp;r.e("chunk-2d0b2b28")', ""), ("https://m.test/chunk-2d0b2b28.abc123def.1612345678901.js", 200, "text/javascript", "c", ""),
    ]
    out = discover(starts(spark, "https://n.test", "https://m.test"), table(spark, rows, "request string"), Registry().only("HTMLScriptPlugin", "DynamicImportPlugin", "NextJSPlugin", "WebpackPlugin"))
    assert {r.url for r in out.js_entries.collect()} == {"https://n.test/_next/static/chunks/f.js", "https://m.test/run.js", "https://m.test/late.js", "https://m.test/chunk-2d0b2b28.abc123def.1612345678901.js"}


def test_counts_of_kept_sources(spark):
    files = spark.createDataFrame([(k, i) for k, n in (("a", 3), ("b", 4), ("c", 2)) for i in range(n)], "k string, idx int").repartition(3)
    got = {r.k: (r.total, r.kept, r.omitted) for r in sourcemaps.counted(files, "k", 5).collect()}
    assert got == {"a": (3, 3, 0), "b": (4, 2, 2), "c": (2, 0, 2)}
    assert sourcemaps.counted(files.limit(0), "k").count() == 0


def test_command_line(spark, tmp_path, capsys):
    table(spark, SITE).write.parquet(str(tmp_path / "r"))
    common = ["--responses", str(tmp_path / "r"), "--only", "HTMLScriptPlugin", "--only", "SourceMapPlugin"]
    assert main([*common, "--url", "https://s.test", "--store", str(tmp_path / "s")], spark) == 0
    said = capsys.readouterr().out.split("\n")
    assert said[0] == "https://s.test/a.js" and "Source maps: 2 (found)" in said and f"Sources dir: {tmp_path}/s/sources" in said
    assert main([*common, "--url", "https://s.test", "--url", "https://gone.test", "--format", "markdown"], spark) == 1
    out = capsys.readouterr()
    assert "- **Restored sources**: 2 files (restored)" in out.out and "- cache disabled" in out.out and "https://gone.test: no response" in out.err
    assert main(["--list"]) == 0 and "EmpPlugin" in capsys.readouterr().out


def test_registered_functions(spark):
    names = register(spark)
    assert "loom_chunks" in names
    assert spark.sql("SELECT loom_inline_scripts('<script>a</script>') AS x").first().x == ["a"]
    assert [r.address for r in spark.sql("""SELECT * FROM loom_chunks('"s/"+e+"."+{1:"abc123"}[e]+".js"', '')""").collect()] == ["s/1.abc123.js"]


def test_reports_have_all_sections(spark):
    js = spark.createDataFrame([("s", "u", None, "P", True, 1)], "scan string, url string, from_url string, plugin string, is_inline boolean, seq long")
    lines = list(report.markdown(js, js.select("scan", "url", "from_url", "plugin"), 1, 0, "/st"))
    assert [x for x in lines if x.startswith("## ")] == ["## Summary", "## JS URLs", "## JS Provenance", "## Cache Directories", "## HTML Entries"]
    assert "- **sourceMap**: /st/maps" in lines and "| u | P | — | yes |" in lines
    assert list(report.text_summary(1, 0, 0))[1:] == ["--- Summary ---", "JS files: 1", "Source maps: 0 (not found)", "Restored sources: 0 (not restored)"]
    assert report.json_report(js.withColumn("n_sources", F.lit(2))).first().report.startswith('[{"seq":1')


def test_scans_without_scripts_are_replayed_and_stale_rows_go(spark, tmp_path):
    store, asked = Store(spark, str(tmp_path / "s")), starts(spark, "https://s.test", "https://empty.test", "https://gone.test")
    empty = [("https://empty.test", 200, "text/html", "<p>nothing</p>")]
    first = scan(asked, table(spark, SITE + empty), FEW, store=store)
    assert first.js.count() == 3 and {(r.start, r.status) for r in first.failed.collect()} == {("https://gone.test", None)}
    again = scan(asked, table(spark, []), FEW, store=store)
    assert replayed(again) == ["https://empty.test", "https://s.test"]  # what didn't answer is asked again
    assert "InSet" not in again.js._jdf.queryExecution().optimizedPlan().toString() and "https://s.test" not in again.js._jdf.queryExecution().analyzed().toString()
    # Now the site has none of its maps any more, and then no script.
    unread = Store(spark, str(tmp_path / "s"), reads=False)
    scan(starts(spark, "https://s.test"), table(spark, SITE[:1] + SITE[3:4]), FEW, store=unread)
    later = scan(starts(spark, "https://s.test"), table(spark, []), FEW, store=store)
    assert later.js.count() == 1 and later.sources.count() == later.maps.count() == 0
    scan(starts(spark, "https://s.test"), table(spark, [("https://s.test", 200, "text/html", "")]), FEW, store=unread)
    assert scan(starts(spark, "https://s.test"), table(spark, []), FEW, store=store).js.count() == 0


def test_known_bodies_go_before_responses(spark, tmp_path):
    known = Bodies(spark, str(tmp_path / "b"))
    first = scan(starts(spark, "https://s.test"), table(spark, SITE), FEW, known=known)
    held = known.answers()
    assert {(r.slot, r.url) for r in held.collect()} == {("html", "https://s.test"), ("js", "https://s.test/a.js"), ("js", "https://s.test/b.js"), ("js", "https://s.test/c.js")}
    # The maps are all that is still answered, and one script that says something else now.
    later = scan(starts(spark, "https://s.test"), table(spark, [SITE[2], SITE[4], ("https://s.test/a.js", 200, "text/html", "<p>gone</p>")]), FEW, known=known)
    key = lambda r: (r.url, r.map_url, r.n_sources)
    assert sorted(map(key, later.js.collect()), key=str) == sorted(map(key, first.js.collect()), key=str)
    # Another scan of the same addresses has none of it.
    other = starts(spark, "https://s.test").withColumn("scan", F.lit("other"))
    assert scan(other, table(spark, [SITE[0]]), FEW, known=known).js.count() == 0
