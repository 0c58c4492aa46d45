"""Extractors, the discovery loop, source maps, store and streaming."""

import pytest
from pyspark.sql import functions as F

from loomscan.operators import sourcemaps
from loomscan.operators.discover import discover
from loomscan.operators.extract import BUILTIN, Registry, extract
from loomscan.plans import report
from loomscan.sources.store import Store
from loomscan.streaming import extract_arriving

FEW = Registry().only("HTMLScriptPlugin", "DynamicImportPlugin", "URLPatternPlugin", "HTMLPivotPlugin", "WebpackPlugin")
SITE = {
    "": ("text/html", '<script src="/a.js"></script><a href="/p.html">p</a><script>var l="/app/chunk.js"; import("./inner.js")</script>'),
    "/p.html": ("text/html", '<script src="/b.js"></script><a href="https://other.test/x">o</a>'),
    "/a.js": ("text/javascript", 'import("./deep/c.js"); __webpack_require__; f=e=>"/deep/"+e+"-"+{10:"ce0cc4f"}[e]+".js"; import("http://127.0.0.1:5000/local.js"); import("/gone.js"); import("/soft.js")'),
    "/b.js": ("text/javascript", "x"), "/deep/c.js": ("text/javascript", 'import("/a.js")'), "/deep/10-ce0cc4f.js": ("text/javascript", "y"), "/local.js": ("text/javascript", ""), "/soft.js": ("text/html", "<html>no</html>"),
    "/inner.js": ("text/html", ""), "/app/chunk.js": ("text/javascript", "z"),
}


def responses(spark, site=SITE):
    return spark.createDataFrame([(f"https://s.test{p}", 200, c, t) for p, (c, t) in site.items()], "url string, status int, content_type string, text string")


def starts(spark, url="https://s.test", scan="one"):
    return spark.createDataFrame([(scan, url)], "scan string, start string")


@pytest.fixture(scope="module")
def result(spark):
    return discover(starts(spark), responses(spark), FEW)


def test_closed_site(result):
    js = {r.url.removeprefix("https://s.test"): r for r in result.js_entries.collect()}
    assert set(js) == {"/a.js", "/b.js", "/deep/c.js", "/deep/10-ce0cc4f.js", "/local.js", "/inner.js", "/app/chunk.js"}
    assert js["/a.js"].plugin == "HTMLScriptPlugin" and js["/a.js"].from_url == "https://s.test"
    assert js["/inner.js"].is_inline and not js["/b.js"].is_inline
    assert {r.url for r in result.html_entries.collect()} == {"https://s.test/p.html"}


def test_order_of_input_makes_no_difference(spark, result):
    again = discover(starts(spark), responses(spark).repartition(3).orderBy(F.desc("url")), FEW)
    assert sorted(again.js_entries.collect()) == sorted(result.js_entries.collect())


def test_page_budget_counts_distinct_pages(spark):
    pages = {"": ("text/html", "".join(f'<a href="/q{i}.html">' for i in range(9)) + '<a href="/q1.html">')} | {f"/q{i}.html": ("text/html", f'<script src="/s{i}.js"></script>') for i in range(9)} | {f"/s{i}.js": ("text/javascript", "x") for i in range(9)}
    few = Registry().only("HTMLScriptPlugin", "HTMLPivotPlugin")
    out = discover(starts(spark), responses(spark, pages), few, budget=4)
    assert {r.url[-7:] for r in out.html_entries.collect()} == {f"q{i}.html" for i in range(4)} and out.js_entries.count() == 4


def test_reports(result):
    text = report.text_report(result.js_entries).first().report.split("\n")
    assert len(text) == 7 and text[0] == "https://s.test/a.js"
    assert '"plugin":"HTMLScriptPlugin"' in report.json_report(result.js_entries).first().report
    lines = list(report.markdown(result.js_entries, result.html_entries))
    assert "- **JS files**: 7" in lines and "## HTML Entries" in lines


def test_registry():
    assert len(BUILTIN) == 26 and list(BUILTIN)[0] == "HTMLScriptPlugin" and list(BUILTIN)[-1] == "UniversalURLPlugin"
    assert Registry().without("EmpPlugin", "Unknown").names == [n for n in BUILTIN if n != "EmpPlugin"]
    with pytest.raises(KeyError):
        Registry().only("Unknown")
    own = lambda d: None
    assert Registry().add("EmpPlugin", own).names == list(BUILTIN)


WEBPACK = [
    ('__webpack_require__;"js/"+e+"-"+{10:"ce0cc4f",b:"aa11bb2"}[e]+".js"', {"js/10-ce0cc4f.js", "js/b-aa11bb2.js"}),
    ('webpackChunk;"s/"+(({1:"one"})[e]||e)+"."+({1:"abcdef1",2:"abcdef2",3:"abcdef3"})[e]+".js"', {"s/one.abcdef1.js", "s/2.abcdef2.js", "s/3.abcdef3.js"}),
    ('webpackChunk;"s/"+{1:"name"}[c]+"."+{1:"abc123"}[c]+".js"', {"s/name.abc123.js"}),
    ('webpackChunk;"s/"+({1:"name"}[e]||e)+"."+{1:"abc123",2:"def456"}[e]+".js"', {"s/name.abc123.js", "s/2.def456.js"}),
    ('webpackChunk;({1:"name"}[e]||e)+"."+{1:"abc123"}[e]+".async.js"', {"name.abc123.async.js"}),
    ('webpackChunk;(7===e?"seven":e)+"-"+{7:"abc123",8:"def456"}[e]+".js"', {"seven-abc123.js", "8-def456.js"}),
    ('webpackChunk;a.u=e=>"p/"+e+"-"; m={1:"abc1234"}', {"p/1-abc1234.js"}),
    ('webpackChunk;x.p+"static/js/"+1;m={"chunk-2d0b2b28":"6267aaf1"}', {"static/js/chunk-2d0b2b28.6267aaf1.js"}),
    ('webpackJsonp;a+".abc123def.1612345678901.js";b.e("chunk-2d0b2b28")', {"https://w.test/d/chunk-2d0b2b28.abc123def.1612345678901.js", "chunk-2d0b2b28.js"}),
]


@pytest.mark.parametrize("text,expected", WEBPACK, ids=range(len(WEBPACK)))
def test_runtime_shapes(spark, text, expected):
    docs = spark.createDataFrame([("https://w.test/d/r.js", "js", text)], "url string, kind string, text string")
    assert {r.value for r in extract(docs, Registry().only("WebpackPlugin")).where("type = 'probe'").collect()} == expected


def test_restored_files(spark):
    maps = spark.createDataFrame([(1, '{"sources":["webpack:///./a.js","b.js",5],"sourcesContent":["A",null],"mappings":"AAAA,CCAA"}', "xyz"), (2, "<html>", "q")], "id int, text string, min string")
    got = {(r.path, r.mode, r.content.split("\n")[-1]) for r in sourcemaps.restore(maps, ("id",), minified="min").collect()}
    assert got == {("a.js", "sourcesContent", "A"), ("b.js", "mappings", " */" if False else "xyz")}


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "scope string, n int")
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("t") is None
    store.write("t", rows)
    store.write("t", rows.where("scope = 'a'").withColumn("n", F.lit(9)))
    assert sorted((r.scope, r.n) for r in store.read("t").collect()) == [("a", 9), ("b", 2)]
    assert Store(spark, str(tmp_path / "s"), reads=False).read("t") is None
    Store(spark, str(tmp_path / "s"), writes=False).write("u", rows)
    assert store.read("u") is None


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([("https://a.test/x.js", "js", 'import("./y.js")')], "url string, kind string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    extract_arriving(stream, str(tmp_path / "out"), str(tmp_path / "cp"), Registry().only("DynamicImportPlugin")).awaitTermination()
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["https://a.test/y.js"]


def test_walking_ahead_and_by_round_find_the_same(spark, result):
    by_round = discover(starts(spark), responses(spark), FEW, by_round=True)
    assert sorted(by_round.js_entries.collect()) == sorted(result.js_entries.collect())
    key = lambda r: (r.scan, r.seq, r.inline, r.from_url, r.plugin, r.type, r.value)
    assert sorted(map(key, by_round.findings.collect())) == sorted(map(key, result.findings.collect()))
