"""Scalar functions against tables of expected values."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from loomscan.functions import content, paths, readers, registered, scanners, scripts, url


def column(spark, f, values, kind="string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    n = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"v{k} string" for k in range(n)))
    return [r.x for r in df.select("i", f(*(F.col(f"v{k}") for k in range(n))).alias("x")).orderBy("i").collect()]


CASES = {
    url.normalize: [
        ("https://a.test", "https://a.test"), ("https://a.test/", "https://a.test/"), ("https://a.test/guide/", "https://a.test/guide"), ("https://A.test:443/x#y", "https://a.test/x"), ("http://a.test:80/a//b/./c/../d", "http://a.test/a/b/d"),
        ("https://a.test?q=1", "https://a.test/?q=1"), ("https://a.test/für", "https://a.test/f%C3%BCr"), ("not a url", "not a url"), ("https://a.test/../../x", "https://a.test/x"),
    ],
    url.origin: [("https://a.test:8080/x", "https://a.test:8080"), ("HTTP://A.test/x", "http://a.test"), ("x", "")],
    url.directory: [("https://a.test/x/y.js", "https://a.test/x/"), ("https://a.test", "https://a.test/"), ("https://a.test/x", "https://a.test/"), ("", "")],
    url.map_of: [("a.js", "a.js.map"), ("a.js?v=1", "a.js.map?v=1")],
    url.is_map: [("a.js.map?v=1", True), ("a.map.js", False)],
    url.is_static: [("https://a.test/x.css?y", True), ("https://a.test/load?m=a.js", True), ("https://a.test/manifest.json", True), ("https://a.test/page", False)],
    content.jsonp_name: [("cb({})", "cb"), ("window.a.b([1])", "a.b"), ("f(1)", None)],
    content.unwrap_jsonp: [("/**/cb({\"a\":1});", '{"a":1}'), ("cb({bad)", None), ("x", None)],
    content.decode: [(r"a\/b", "a/b"), ("%2Fa%20+", "/a +"), ("%2Fa%", "%2Fa%"), ("%FF%41", "%FF%41"), (r"\u002Fx", "/x"), ("&lt;a&amp;lt;&quot;", '<a&lt;"'), (r"\\n\n", "\\n\n"), ("&#47;x", "&/x"), (r"\ud83d\ude42", "🙂"), ("plain", "plain")],
    content.scope_name: [("https://a:1/b", "https_a_1_b")],
    content.cache_name: [("https://a.test:8/x/y", "a.test_8-x-y.js"), ("https://a.test/x.css", "a.test-x.css"), ("https://a.test", "a.test-.js")],
    content.flat_name: [("/a/b/", "a_b"), ("../x", "__x"), ("a?b", "a_b")],
    content.map_prefix: [("https://a.test/x/y.js.map?v", "y.js"), ("https://a.test/", "map")],
    content.is_source_map: [('{"sources":["a"]}', True), ('{"sources":[]}', False), ("<html>", False), ("{bad", False), ("", False)],
    paths.safe_path: [("a/./b//c", "a/b/c"), ("../a", None), ("", None)],
    paths.safe_file: [("/a/b", "a/b"), ("a/../b", ""), ("a\\b", "a/b")],
    paths.sanitize: [("a/../../b", "b"), ("a:b/c?", "a_b/c_"), ("", "")],
}


@pytest.mark.parametrize("f", CASES, ids=lambda f: f.__name__)
def test_vectors(spark, f):
    assert column(spark, f, [i for i, _ in CASES[f]]) == [o for _, o in CASES[f]]


def test_resolve(spark):
    base = "https://a.test/x/y/z.html?q#f"
    cases = [("b.js", "https://a.test/x/y/b.js"), ("../b.js", "https://a.test/x/b.js"), ("../../../b.js", "https://a.test/b.js"), ("./", "https://a.test/x/y/"), ("/b?c#d", "https://a.test/b?c#d"), ("//c.test/b", "https://c.test/b"), ("http://C.test", "http://c.test/"), ("?n", "https://a.test/x/y/z.html?n"), ("#n", "https://a.test/x/y/z.html?q#n"), ("", "https://a.test/x/y/z.html?q"), ("mailto:a", "mailto:a"), ("a b", "https://a.test/x/y/a%20b"), ("..", "https://a.test/x/"), (" b.js\n", "https://a.test/x/y/b.js"), ("a\\b", "https://a.test/x/y/a/b")]
    assert column(spark, url.resolve, [(base, c) for c, _ in cases]) == [o for _, o in cases]
    assert column(spark, url.resolve, [("nowhere", "b.js"), ("https://a.test", "b.js")]) == ["b.js", "https://a.test/b.js"]


def test_normalize_twice_is_once(spark):
    some = ["https://a.test//b/", "https://a.test/é?x", "https://a.test?x", "x"]
    once = column(spark, url.normalize, some)
    assert column(spark, url.normalize, once) == once


def test_rebase_and_combo(spark):
    start = "https://s.test:8443/app"
    assert column(spark, lambda u: url.rebase_loopback(u, F.lit(start)), ["http://127.0.0.1:5/a?b", "http://localhost", "http://x.test/a", "https://[::1]:3/q"]) == ["https://s.test:8443/a?b", "https://s.test:8443", "http://x.test/a", "https://s.test:8443/q"]
    assert column(spark, url.combo_members, ["https://a.test/??b.js, c.js,?t", "https://a.test/x", "https://a.test/??"]) == [["https://a.test/b.js?t", "https://a.test/c.js?t"], ["https://a.test/x"], ["https://a.test/??"]]


def test_kinds(spark):
    cases = [(("text/html; x", "{}"), "html"), (("application/json", "<html>"), "json"), (("", "  <!doctype html>"), "html"), (("", "cb({})"), "jsonp"), (("x/y", "[1]"), "json"), (("", "var a"), "js"), (("", ""), "js"), (("TEXT/JAVASCRIPT", "{}"), "js")]
    assert column(spark, content.kind, [c for c, _ in cases]) == [o for _, o in cases]


def test_source_paths(spark):
    long = "d/" * 40 + "f.js"
    cases = [(("webpack:///./src/App.jsx", ""), "src/App.jsx"), (("webpack:///webpack/bootstrap", ""), "webpack/bootstrap"), (("../../../../node_modules/foo.js", ""), "node_modules/foo.js"), (("file:///home/user/a.js", ""), "home/user/a.js"), (("~/config", ""), "config"), (("https://h.test/a/b.js", ""), "a/b.js"), (("b.js", "src/"), "src/b.js"), (("webpack://", ""), ""), (("..", ""), ""), ((long, ""), "d/" * 32 + "_".join(["d"] * 8 + ["f.js"]))]
    assert column(spark, paths.source_path, [c for c, _ in cases]) == [o for _, o in cases]
    assert len(column(spark, paths.source_path, [("x" * 600 + "/name.js", "")])[0]) == 512


def test_scanners():
    assert scanners.inline_bodies('<script>var a="</script>";b</script><script src=x></script><SCRIPT a>q</SCRIPT><script/><scripty></scripty>') == ['var a="</script>";b', "q", ""]
    assert scanners.inline_bodies("<script><!-- </script> --> x</script>") == ["<!-- </script> --> x"]
    assert scanners.inline_bodies("<script>a\\\"</script>b") == ['a\\"</script>b']
    assert scanners.balanced('window.X = {"a":{"b":"}"}} ;', "window.X") == '"a":{"b":"}"}'
    assert scanners.balanced("window.X = 1", "window.X") == ""
    assert [scanners.vlq(s) for s in ("A", "C", "D", "gB", "gC", "!", "g", "2H")] == [(0, 1), (1, 1), (-1, 1), (16, 2), (32, 2), None, None, (123, 2)]
    assert scanners.mappings("AAAA,CAAC;AACA;!,A;C") == [(0, 0, 0, 0, 0, -1), (0, 1, 0, 0, 1, -1), (1, 0, 0, 1, 1, -1), (3, 1, -1, -1, -1, -1)]
    assert scanners.rebuilt(scanners.by_source(scanners.mappings("AAAA,IAAI"))[0], ["abcdefgh"]) == "abcdefgh"
    assert scripts.imported_constants('const a="/x/"; b = a + "y/"; c = b + "z.js"; import(c)') == ["/x/y/z.js"]


def test_hosts_are_written_as_browsers_do(spark):
    cases = [
        ("https://Bücher.DE/x", "https://xn--bcher-kva.de/x"), ("http://0x7f.1/a", "http://127.0.0.1/a"), ("https://ex.test\\a\\b?c\\d", "https://ex.test/a/b?c\\d"), ("https:\\\\ex.test/q", "https://ex.test/q"), ("https:///a.test/x", "https://a.test/x"),
        ("https://[2001:DB8:0:0:1:0:0:1]/", "https://[2001:db8::1:0:0:1]/"), ("https://[::ffff:1.2.3.4]:8443/x", "https://[::ffff:102:304]:8443/x"), ("https://0300.0250.1/", "https://192.168.0.1/"), ("https://4294967295/", "https://255.255.255.255/"),
        ("https://ex%41mple.test/", "https://example.test/"), ("https://日本語。jp/", "https://xn--wgv71a119e.jp/"), ("http://a.test:0080/", "http://a.test/"), ("https://a.test/?c d'\"<é>#f", "https://a.test/?c%20d%27%22%3C%C3%A9%3E"), ("https://faß.bücher.example/", "https://xn--fa-hia.xn--bcher-kva.example/"),
    ]
    assert column(spark, url.normalize, [c for c, _ in cases]) == [o for _, o in cases]
    assert column(spark, url.normalize, [o for _, o in cases]) == [o for _, o in cases]
    wrong = ["https://[1::2::3]/", "https://256.1.1.1/", "https://1.2.3.4.5/", "https://4294967296/", "https://a.09/", "https://x.0x/", "https://a.test:70000/", "https://a b/", "https://[1:2]/", "https://[::12345]/"]
    assert column(spark, url.normalize, wrong) == wrong and column(spark, url.parses, wrong) == [False] * len(wrong)
    assert column(spark, url.resolve, [("https://A.test/x?y", "?c d"), ("https://a.test/", "https:\\\\0x7f.1\\b"), ("https://a.test/x/", "\\y")]) == ["https://a.test/x?c%20d", "https://127.0.0.1/b", "https://a.test/y"]


def test_punycode_and_groups_against_the_standard_library(spark):
    r = random.Random(1)
    labels = [x for x in ("".join(r.choice("abcü日é🙂ßxyz-ñжñ") for _ in range(r.randrange(1, 20))) for _ in range(300)) if not x.isascii()]
    assert column(spark, lambda u: url.host(F.concat(F.lit("https://"), u)), labels) == ["xn--" + x.encode("punycode").decode() for x in labels]
    groups = [":".join("%04X" % r.choice([0, 0, 0, 1, r.randrange(65536)]) for _ in range(8)) for _ in range(300)]
    assert column(spark, lambda u: url.host(F.concat(F.lit("https://["), u, F.lit("]"))), groups) == [f"[{ipaddress.IPv6Address(g)}]" for g in groups]


def test_native_functions_in_sql(spark):
    names = registered.register(spark)
    assert {f"loom_{n}" for n in registered.NATIVE} <= set(names)
    given = {"address": "https://A.test:443/x/../y.js?q r#z", "base": "https://a.test/b/", "ref": "c.js", "start": "https://s.test", "path": "a//b/../c?d'\\e.js", "content_type": "text/html", "body": "cb({\"a\": 1})", "source": "webpack:///./src/it's.ts", "root": "", "name": "a:/b?"}
    for name, (f, parameters, _) in registered.NATIVE.items():
        df = spark.createDataFrame([tuple(given[p] for p in parameters), tuple(None for _ in parameters)], ", ".join(f"{p} string" for p in parameters))
        called = spark.sql(f"SELECT loom_{name}({', '.join(parameters)}) AS x FROM {{rows}}", rows=df)
        assert called.collect() == df.select(f(*(F.col(p) for p in parameters)).alias("x")).collect(), name
        plan = called._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
    members = spark.sql("SELECT u, m.pos, m.member FROM VALUES ('https://a.test/??b.js,c.js'), ('https://b.test/x') AS t(u), LATERAL loom_members(t.u) m").collect()
    assert sorted((r.pos, r.member) for r in members) == [(0, "https://a.test/b.js"), (0, "https://b.test/x"), (1, "https://a.test/c.js")]


def test_plain_addresses_have_the_parts_of_others(spark):
    # In capitals the scheme takes the long way; the parts are the same.
    rests = ["h.test", "h.test/", "h.test/a//b/./c.js", "1.2.3.4/x", "h-1_2.test/@:~|[]!$;=,", "h.test/a%20b"]
    rows = spark.createDataFrame([(i, s + r) for i, r in enumerate(rests) for s in ("https://", "HTTPS://")], "i int, u string")
    found: dict = {}
    for r in rows.select("i", url.cut_up(F.col("u")).alias("p")).select("i", "p.ok", "p.scheme", "p.host", "p.path", "p.query", "p.mark").collect():
        found.setdefault(r.i, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in found.values()) and found[2] == {(True, "https", "h.test", "/a//b/./c.js", "", "")}
    assert url._CUT_UP.startswith(f"u -> if(u rlike {url._PLAIN}, {url._PLAIN_PARTS}, ")


def test_plain_references_resolve_as_others(spark):
    bases = ["https://h.test/a/p1/index.html", "https://h.test/a/", "https://h.test", "http://h.test:81/a/b.js", "https://h.test/a/../b/c", "https://h.test/a//b", "https://0x7f.1/a/b", "https://1.2.3.999/a", "https://H.test/a/b", "https://h.test/a?b/c", "https://h.test/a b/c", "about:blank", "x.js"]
    refs = ["/x.js", "x.js", "./x.js", "./x/y.js", "././x", "../x.js", "/a/", "a/", "./", "/", "", ".", "..", "/..", "/a/../b", "/a//b", "//k.test/x", "/.x/y", "x/.y", "a/..", "data:x", "a:b", "/a:b", "x?y", "/x#y", "/a b", " /a", "/a\\b", "/ü", "/a|b", "/a\n", "https://k.test/x.js", "https://k.test/x/", "https://k.test", "https://K.test/x", "https://k.test/a/../b", "https://k.test:443/x", "http://0x7f.1/x", "%41/~!$&'()*+,;=@[]_b", None]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string").select("b", "r", url.parsed(F.col("b")).alias("p"))
    at = lambda f: f(F.col("p"), F.col("r"))
    for r in rows.select("b", "r", *(at(f).alias(f.__name__) for f in (url.resolve_at, url.resolve_any, url.normalize_at, url.normalize_any))).collect():
        assert (r.resolve_at, r.normalize_at) == (r.resolve_any, r.normalize_any), r
    # Two references are plain anywhere and seven at each of three bases, and are answered without the other way.
    plain = rows.select(url._at(F.col("p"), F.col("r"), "", F.lit(None).cast("string")).alias("u")).where("u is not null").count()
    assert plain == 13 * 2 + 3 * 7


def test_contexts_join_short_strings(spark):
    text = "'a'" + "x" * 60 + '"b"' + "é" * 20 + "c`d`e''f'\"" + "y" * 30 + "'g'"
    pieces = re.split(r"(?=[\"'`])", " " + text)
    expected = [(p[1:], "".join(pieces[max(0, i - 3) : i])[-readers.REACH :]) for i, p in enumerate(pieces) if 0 < i < len(pieces) - 1 and len(p) > 1]
    found = spark.createDataFrame([(text,)], "t string").select(F.explode(readers.strings(F.col("t"))).alias("s")).select("s.value", "s.context")
    assert [tuple(r) for r in found.collect()] == expected


def test_constants_are_read_without_token_objects(spark, monkeypatch):
    monkeypatch.setattr(scripts, "Token", None)
    cases = {
        'const a="/x/"; b = a + "y"; c = b + "z.js"; import(c)': ["/x/yz.js"],
        'a="x";import(a)': [],
        'let a="1";let a="2";import(a);import(a)': ["2", "2"],
        'const a="";import(a)': [],
        "import(": [],
        '="x"': [],
        '="x";const a': [],
        f'const a="{"z" * 201}";import(a)': [],
    }
    assert {t: scripts.imported_constants(t) for t in cases} == cases
