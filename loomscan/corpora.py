"""Texts that the driver's tables don't hold, as SQL that Spark and DuckDB both run.

{name} stands for a table; strings hold no backslashes, which the two would read
differently: chr(92) is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomscan.sources import shared

_S = "CAST({} AS STRING)"
_K = {k: _S.format(k) for k in ("s_suppkey", "p_partkey", "n_nationkey", "r_regionkey", "c_custkey", "o_orderkey")}


def _say(*parts: str) -> str:
    """Literals and column expressions, the latter marked by a leading colon, joined."""
    quoted = lambda p: "'" + p.replace("'", "''").replace("$", "' || chr(36) || '") + "'"  # noqa: E731  a dollar sign would begin a variable
    return " || ".join(_K.get(p[1:], p[1:]) if p.startswith(":") and p[1:2].isalpha() else quoted(p) for p in parts)


_AT = _say("https://s", ":CAST(s_suppkey % 5 AS STRING)", ".example.test/app/p", ":s_suppkey", "/index.html")
_PART = _say("https://p", ":CAST(p_partkey % 7 AS STRING)", ".example.test/js/v", ":CAST(p_partkey % 3 AS STRING)", "/app", ":p_partkey", ".js")

_IMPORTS = _say(
    'import("./p', ":p_partkey", '.js");import(' + "'/q", ":p_partkey", ".js');import(`r", ":p_partkey", '.js`);import(`./${x}/n.js`);import x from "./m',
    ":p_partkey", '.js";import{a,b}from"/n', ":p_partkey", '.js";import "./o', ":p_partkey", '.js";import y from "react";',
)

CORPORA: dict[str, str] = {
    "c_script_html": f"""SELECT s_suppkey AS id, {_AT} AS url, 'html' AS kind, {_say('<html><head><script src="/s/', ':s_suppkey', '.js"></script><link rel="modulepreload" href="m/', ':s_suppkey', '.js"><link rel="prefetch" href="/p/', ':s_suppkey', '.js"><link href="q/', ':s_suppkey', '.js" rel="prefetch"></head><body><script>var a = 1; import("./inner/', ':s_suppkey', '.js")</script><script type="module" src="./e/', ':s_suppkey', '.js"></script></body></html>')} AS text FROM {{supplier}}""",
    "c_import_js": f"""SELECT p_partkey AS id, {_PART} AS url, 'js' AS kind, {_IMPORTS} AS text FROM {{part}}""",
    "c_create_js": f"""SELECT p_partkey AS id, {_PART} AS url, 'js' AS kind, {_say('script.setAttribute("src","/a', ':p_partkey', '.js");script.src="/b', ':p_partkey', '.js";new URL("/c', ':p_partkey', '.js");o("/d', ':p_partkey', '.js?v=1");o("/e', ':p_partkey', '.css");var s=document.createElement("script");require("./node_modules/x/y.js");var h="//cdn.test/lib/";')} || chr(10) || {_say('//# sourceMappingURL=app', ':p_partkey', '.js.map')} AS text FROM {{part}}""",
    "c_webpack_js": f"""SELECT n_nationkey AS id, {_say('https://w.example.test/static/n', ':n_nationkey', '.js')} AS url, 'js' AS kind, {_say('__webpack_require__.p="/r', ':n_nationkey', '/";f=function(e){return "/js/"+e+"-"+{', ':n_nationkey', ':"', ':substr(md5(CAST(n_nationkey AS STRING)), 1, 8)', '",', ':CAST(n_nationkey + 100 AS STRING)', ':"', ':substr(md5(CAST(n_nationkey + 100 AS STRING)), 1, 8)', '"}[e]+".js"}')} AS text FROM {{nation}}""",
    "c_next_js": f"""SELECT n_nationkey AS id, {_say('https://x.example.test/_next/static/n', ':n_nationkey', '.js')} AS url, 'js' AS kind, {_say('self.__BUILD_MANIFEST={"/page', ':n_nationkey', '":["static/chunks/a', ':n_nationkey', '.js","static/css/b.css"]}')} AS text FROM {{nation}}""",
    "c_frame_html": f"""SELECT s_suppkey AS id, {_AT} AS url, 'html' AS kind, {_say('<script>window.__NUXT__={}</script><script src="/_nuxt/e', ':s_suppkey', '.js"></script><link rel="x" href="/_nuxt/f', ':s_suppkey', ".js\">import('../nodes/n", ':s_suppkey', ".js');import('../chunks/c", ':s_suppkey', ".js');_app/immutable <script data-main=\"main", ':s_suppkey', '" src="/lib/require.min.js"></script>')} AS text FROM {{supplier}}""",
    "c_amd_js": f"""SELECT p_partkey AS id, {_PART} AS url, 'js' AS kind, {_say('define(["./a', ':p_partkey', '","/b', ':p_partkey', '.js"],function(){});require(["https://cdn.test/c', ':p_partkey', '"],f)')} AS text FROM {{part}}""",
    "c_manifest_json": f"""SELECT n_nationkey AS id, {_say('https://v.example.test/.vite/n', ':n_nationkey', '/manifest.json')} AS url, 'json' AS kind, {_say('{"index.html":{"file":"assets/i', ':n_nationkey', '.js","isEntry":true},"b.css":{"file":"assets/b.css"},"c.ts":{"file":"/assets/c', ':n_nationkey', '.js"}}')} AS text FROM {{nation}}""",
    "c_sitemap_json": f"""SELECT n_nationkey AS id, {_say('https://t.example.test/t/n', ':n_nationkey', '/sitemap.json')} AS url, 'json' AS kind, {_say('{"routes":[{"name":"home","file":"js/lazy', ':n_nationkey', '.js"},{"name":"none"}],"chunks":{"w":"', ':substr(md5(CAST(n_nationkey AS STRING)), 1, 8)', '"},"workers":["js/worker', ':n_nationkey', '.js"]}')} AS text FROM {{nation}}""",
    "c_federation_js": f"""SELECT p_partkey AS id, {_PART} AS url, 'js' AS kind, {_say('__webpack_init_sharing__;x={remote:"https://r', ':CAST(p_partkey % 9 AS STRING)', '.example.test/remote', ':p_partkey', '/assets/remoteEntry.js",t:"{{host}}/mf-manifest.json"}')} AS text FROM {{part}}""",
    "c_federation_json": f"""SELECT n_nationkey AS id, {_say('https://f.example.test/n', ':n_nationkey', '/mf-manifest.json')} AS url, 'json' AS kind, {_say('{"metaData":{"publicPath":"https://cdn', ':n_nationkey', '.example.test/app"},"exposes":[{"assets":{"js":{"sync":["a', ':n_nationkey', '.js"],"async":["b', ':n_nationkey', '.js",""]}}}]}')} AS text FROM {{nation}}""",
    "c_emp_json": f"""SELECT n_nationkey AS id, {_say('https://e.example.test/n', ':n_nationkey', '/emp.json')} AS url, 'json' AS kind, {_say('{"federatedModules":[{"remote":"r","entry":"entry', ':n_nationkey', '.js","exposes":{"./A":[{"chunks":["js/a', ':n_nationkey', '.js","js/b.js"]}]}}]}')} AS text FROM {{nation}}""",
    "c_hel_json": f"""SELECT n_nationkey AS id, {_say('https://h.example.test/n', ':n_nationkey', '/metadata.json')} AS url, 'json' AS kind, {_say('{"Comp":{"url":"comp', ':n_nationkey', '.js","offlineChunks":["c', ':n_nationkey', '.js"]},"testOne":{"url":"no.js"}}')} AS text FROM {{nation}}""",
    "c_micro_js": f"""SELECT p_partkey AS id, {_PART} AS url, 'js' AS kind, {_say('registerMicroApps([{name:"app', ':p_partkey', '",entry:"/sub/app', ':p_partkey', '/",container:"#c"},{name:"d",entry:"//127.0.0.1:5010/",container:"#d"},{name:"h",entry:"https://m.example.test/h', ':p_partkey', '.html"}])')} AS text FROM {{part}}""",
    "c_const_js": f"""SELECT p_partkey AS id, {_PART} AS url, 'js' AS kind, {_say('const base="/lib/v', ':p_partkey', '/"; mid = base + "x/"; file = mid + "z', ':p_partkey', '.js"; import(file);')} AS text FROM {{part}}""",
    "c_escaped_js": f"""SELECT p_partkey AS id, {_PART} AS url, 'js' AS kind, {_say('a="')} || chr(92) || {_say('/esc', ':p_partkey')} || chr(92) || {_say('/x.js";b="%2Fpct', ':p_partkey', '%2Fy.js";c=&quot;/ent', ':p_partkey', '/z.js&quot;;d="')} || chr(92) || {_say('u002Funi', ':p_partkey', '/w.js";')} AS text FROM {{part}}""",
    "c_sourcemap_json": f"""SELECT c_custkey AS id, {_say('https://m.example.test/js/c', ':c_custkey', '.js.map')} AS url, {_say('{"version":3,"sourceRoot":"', ":CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'root' END", '","sources":["webpack:///./src/App', ':c_custkey', '.jsx","../../lib/u', ':CAST(c_custkey % 13 AS STRING)', '.js","~/conf', ':c_custkey', '"],"sourcesContent":["app', ':c_custkey', '",', ":CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '\"lib\"' END", ',"conf"],"mappings":"AAAA,CAAC;AACA"}')} AS text FROM {{customer}}""",
    "c_paths": f"""SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN {_say('webpack:///./src/A', ':c_custkey', '.jsx')} WHEN 1 THEN {_say('../../../node_modules/f', ':c_custkey', '.js')} WHEN 2 THEN {_say('file:///home/u/a', ':c_custkey', '.js')} WHEN 3 THEN {_say('~/config', ':c_custkey')} WHEN 4 THEN {_say('a//b/./c/../d', ':c_custkey', '.ts')} WHEN 5 THEN {_say('a?b:c*', ':c_custkey', '.js')} WHEN 6 THEN {_say('/abs/p', ':c_custkey', '.js')} ELSE {_say('https://h.test/dir/x', ':c_custkey', '.js')} END AS path FROM {{customer}}""",
    "c_payloads": f"""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/json' WHEN 2 THEN 'Text/JavaScript' WHEN 3 THEN '' ELSE 'text/plain' END AS content_type, CASE c_custkey % 5 WHEN 0 THEN {_say('  <!DOCTYPE html><p>', ':c_custkey')} WHEN 1 THEN {_say('{"a":', ':c_custkey', '}')} WHEN 2 THEN {_say('cb', ':c_custkey', '.f({"a":', ':c_custkey', '});')} WHEN 3 THEN {_say('[', ':c_custkey', ']')} ELSE {_say('var x=', ':c_custkey')} END AS text FROM {{customer}}""",
    "c_urls": f"""SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN {_say('http://127.0.0.1:50315/remote/e', ':o_orderkey', '.js?v=1')} WHEN 1 THEN {_say('https://h.test/a/../b//c', ':o_orderkey', '.JS/')} WHEN 2 THEN {_say('https://H.test:443/x', ':o_orderkey', '#top')} WHEN 3 THEN {_say('https://h.test/s/??a', ':o_orderkey', '.js, b.js,?t=1')} WHEN 4 THEN 'https://h.test' WHEN 5 THEN {_say('https://h.test?q=', ':o_orderkey')} WHEN 6 THEN {_say('http://localhost/dev', ':o_orderkey', '.js.map?x')} WHEN 7 THEN {_say('/rel/p', ':o_orderkey', '.html')} ELSE {_say('https://h.test/load?type=m', ':o_orderkey', '.js')} END AS url FROM {{orders}}""",
    # Mappings with numbers of one and more digits, empty lines and broken segments, and a script of three lines.
    "c_mappings": """SELECT c_custkey AS id, translate(md5('a' || CAST(c_custkey AS STRING)) || md5('b' || CAST(c_custkey AS STRING)) || md5('c' || CAST(c_custkey AS STRING)), '0123456789', CASE WHEN c_custkey % 3 = 0 THEN 'ACDEgh,;,!' ELSE 'ACDEAC,;,C' END) AS mappings, md5('m' || CAST(c_custkey AS STRING)) || chr(10) || md5('n' || CAST(c_custkey AS STRING)) || chr(10) || CAST(c_custkey AS STRING) AS minified FROM {customer}""",
    # A site of scripts with source maps: named by a comment, beside the script, or within it.
    "c_mapped": f"""
SELECT 'https://maps.test' AS url, 200 AS status, 'text/html' AS content_type, '<html>' || (SELECT string_agg({_say('<script src="/j/', ':n_nationkey', '.js"></script>')}, '') FROM {{nation}}) || '</html>' AS text
UNION ALL SELECT {_say('https://maps.test/j/', ':n_nationkey', '.js')}, 200, 'text/javascript', CASE n_nationkey % 3 WHEN 0 THEN {_say('var a;')} || chr(10) || {_say('//# sourceMappingURL=m', ':n_nationkey', '.map')} WHEN 1 THEN 'var b;' ELSE {_say('var c;')} || chr(10) || {_say('//# sourceMappingURL=data:application/json,{"version":3,"sources":["src/in', ':n_nationkey', '.ts"],"sourcesContent":["in', ':n_nationkey', '"]}')} END FROM {{nation}}
UNION ALL SELECT CASE n_nationkey % 3 WHEN 0 THEN {_say('https://maps.test/j/m', ':n_nationkey', '.map')} ELSE {_say('https://maps.test/j/', ':n_nationkey', '.js.map')} END, CASE WHEN n_nationkey % 6 = 4 THEN 404 ELSE 200 END, 'application/json', {_say('{"version":3,"sources":["webpack:///./src/a', ':n_nationkey', '.ts","webpack:///./src/b', ':n_nationkey', '.ts"],"sourcesContent":["A', ':n_nationkey', '","B', ':n_nationkey', '"]}')} FROM {{nation}} WHERE n_nationkey % 3 <> 2""",
    # A closed site: its page, a script for each region, nation and even supplier, and the rest missing.
    "c_responses": f"""
SELECT 'https://site.test' AS url, 200 AS status, 'text/html' AS content_type, {_say('<html><script src="/r/0.js"></script><script src="/r/1.js"></script><script src="/r/2.js"></script><a href="/more.html">m</a></html>')} AS text
UNION ALL SELECT 'https://site.test/more.html', 200, 'text/html', {_say('<html><script src="/r/3.js"></script><script src="/r/4.js"></script></html>')}
UNION ALL SELECT {_say('https://site.test/r/', ':r_regionkey', '.js')}, 200, 'application/javascript', {_say('import("./n', ':CAST(r_regionkey * 5 AS STRING)', '.js");import("./n', ':CAST(r_regionkey * 5 + 1 AS STRING)', '.js");import("./n', ':CAST(r_regionkey * 5 + 2 AS STRING)', '.js");')} FROM {{region}}
UNION ALL SELECT {_say('https://site.test/r/n', ':n_nationkey', '.js')}, CASE WHEN n_nationkey % 5 = 2 THEN 403 ELSE 200 END, 'application/javascript', {_say('import("../s/', ':CAST(n_nationkey * 3 AS STRING)', '.js");import("../s/', ':CAST(n_nationkey * 3 + 1 AS STRING)', '.js");import("/r/n0.js")')} FROM {{nation}}
UNION ALL SELECT {_say('https://site.test/s/', ':s_suppkey', '.js')}, 200, CASE WHEN s_suppkey % 7 = 0 THEN 'text/html' ELSE 'text/javascript' END, CASE WHEN s_suppkey % 7 = 0 THEN '<html>error</html>' ELSE 'var leaf=1' END FROM {{supplier}} WHERE s_suppkey % 2 = 0""",
}


#: Tables whose rows, a few bytes each in their files, become long texts.
_DEALT = {"supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus over the tables below sf_dir.

    Files are split by bytes, of which these tables have too few for all cores, so their
    keys are dealt out before texts are made of them: four parts a core, and one for every
    megabyte of the file.  A setting for shuffles tells nothing of them, and a task has to
    unpack its extractors.
    """
    used = [t for t in ("region", "nation", "supplier", "customer", "part", "orders") if "{" + t + "}" in CORPORA[name]]
    return spark.sql(_fill(name, {t: _dealt(spark, t, f"{sf_dir}/{t}.parquet") for t in used}))


def _dealt(spark: SparkSession, table: str, place: str) -> str:
    if table not in _DEALT:
        return f"parquet.`{place}`"
    parts = max(4 * spark.sparkContext.defaultParallelism, shared.size(spark, place) >> 20)
    return f"(SELECT /*+ REPARTITION({parts}, {_DEALT[table]}) */ * FROM parquet.`{place}`)"


def _fill(name: str, tables: dict[str, str]) -> str:
    out = CORPORA[name]
    for t, place in tables.items():
        out = out.replace("{" + t + "}", place)
    return out


def sql(name: str) -> str:
    """A corpus over tables of these names."""
    return f"({_fill(name, {t: t for t in ('region', 'nation', 'supplier', 'customer', 'part', 'orders')})})"
