"""Queries over captured sites, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan import corpora
from loomscan.functions import content, paths, registered, scanners, url
from loomscan.operators import cookies, discover, mappings, sourcemaps
from loomscan.operators.extract import Doc, Registry, extract, tagged
from loomscan.plans import report
from loomscan.scan import ScanResult, scan
from loomscan.sources import bodies, captures, shared, store, tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def scalar(name: str, corpus: str, column: Callable[..., Column], sql: str, *inputs: str, out: str = "result") -> None:
    """A query that applies one column expression to a corpus or table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(spark, sf_dir, corpus).select(_ID.get(corpus, "id"), column(*(F.col(c) for c in inputs)).alias(out))

    run.__name__ = name
    oracle = f"SELECT {_ID.get(corpus, 'id')}, {sql} AS {out} FROM {_sql(corpus)} t"
    query(oracle)(run)
    for known, (f, _, _) in registered.NATIVE.items():
        if f is column and f"sql_{known}" not in QUERIES:
            _called(f"sql_{known}", known, corpus, oracle, inputs, out)


def _called(name: str, function: str, corpus: str, oracle: str, inputs: tuple[str, ...], out: str) -> None:
    """The same by a call of the SQL function."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        [call] = registered.register(spark, only={function})
        return spark.sql(f"SELECT {_ID.get(corpus, 'id')}, {call}({', '.join(inputs)}) AS {out} FROM {{rows}}", rows=_rows(spark, sf_dir, corpus))

    run.__name__ = name
    query(oracle)(run)


_ID = {"pages": "page_id"}


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return corpora.load(spark, sf_dir, name) if name in corpora.CORPORA else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(name: str) -> str:
    return corpora.sql(name) if name in corpora.CORPORA else name


# SQL for what the corpora need of URL resolution: no dot segments beyond a leading ./
_ORIGIN = r"regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_DIR = r"regexp_extract(url, '^(https?://[^?#]*/)', 1)"
_ENCODE = "array_to_string(list_transform(string_split({}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x21-\\x7E]') THEN replace(url_encode(c), '+', '%20') ELSE c END), '')"


def _resolved(v: str) -> str:
    return f"CASE WHEN {v} LIKE 'http%' THEN {v} WHEN {v} LIKE '//%' THEN 'https:' || {v} WHEN {v} LIKE '/%' THEN {_ORIGIN} || {v} ELSE {_DIR} || regexp_replace({v}, '^\\./', '') END"


def found(name: str, corpus: str, plugin: str, *patterns: str, type_: str = "url", value: str | None = None, sql: str | None = None) -> None:
    """A query of one extractor over a corpus; the SQL extracts with the same patterns and resolves, or is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = extract(_rows(spark, sf_dir, corpus), Registry().only(plugin), keep=("id",))
        return rows.where(F.col("type").isin(*type_.split(","))).select("id", "value").distinct()

    run.__name__ = name
    if sql is None:
        each = " UNION ALL ".join("SELECT id, url, unnest(regexp_extract_all(text, '{}', 1)) AS v FROM {} t".format(p.replace("'", "''"), _sql(corpus)) for p in patterns)
        sql = f"SELECT DISTINCT id, {value or _resolved('v')} AS value FROM ({each})"
    query(sql)(run)


# Pages of the driver's table.
_LINKS = r"""SELECT page_id, url, unnest(regexp_extract_all(html, '<a\b[^>]*\bhref\s*=\s*"([^"]+)"', 1)) AS v FROM pages"""
_THREE = f"SELECT page_id, url, unnest(CASE WHEN contains(rtrim(v, '/'), '.') OR v LIKE '%/' THEN [v] ELSE [v, v || '/index.html', v || '.html'] END) AS v FROM ({_LINKS})"
_NOT = r"regexp_matches(lower(v), '\.(js|css|png|jpe?g|gif|svg|ico|woff2?|ttf|json|xml|map|pdf)$')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "pages").select("page_id", "url", F.lit("html").alias("kind"), F.col("html").alias("text"))


@query(f"""WITH c AS (SELECT page_id, url, split_part(v, '?', 1) AS v FROM ({_THREE}) WHERE NOT starts_with(v, '#')) SELECT DISTINCT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || {_ENCODE.format('v')} AS link FROM c WHERE v LIKE '/%' AND v NOT LIKE '//%' AND NOT {_NOT}""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_pages(spark, sf_dir), Registry().only("HTMLPivotPlugin"), keep=("page_id",)).where("type = 'html'").select("page_id", F.col("value").alias("link"))


@query(r"""SELECT page_id, i - 1 AS idx, bodies[i] AS body FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script>(.*?)</script>', 1) AS bodies FROM pages), unnest(range(1, len(bodies) + 1)) AS u(i) WHERE bodies[i] <> ''""")
def inline_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("page_id", F.posexplode(scanners.inline_scripts(F.col("text"))).alias("idx", "body"))
    return rows.where("body <> ''").withColumn("idx", F.col("idx").cast("long"))


@query(f"""SELECT DISTINCT page_id, v AS ref, {_ORIGIN} || {_ENCODE.format('v')} AS address FROM ({_LINKS}) WHERE v LIKE '/%' AND v NOT LIKE '//%'""")
def resolve_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("page_id", "url", F.explode(matches(F.col("text"), r'<a\b[^>]*\bhref\s*=\s*"([^"]+)"')).alias("ref"))
    return rows.where("ref like '/%' and ref not like '//%'").select("page_id", "ref", url.resolve(F.col("url"), F.col("ref")).alias("address")).distinct()


scalar("normalize_url", "pages", url.normalize, r"regexp_extract(url, '^(https?://[^/?#]+)', 1) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) IN ('', '/') THEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) ELSE rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') END || regexp_extract(url, '(\?[^#]*)', 1)", "url")
scalar("url_origin", "pages", url.origin, _ORIGIN, "url")
scalar("url_dir", "pages", url.directory, _DIR, "url")
scalar("scope_name", "pages", content.scope_name, "translate(replace(replace(url, 'https://', 'https_'), 'http://', 'http_'), ':/', '__')", "url")
scalar("js_cache_filename", "pages", content.cache_name, r"regexp_replace(replace(split_part(regexp_replace(url, '^https?://', ''), '/', 1), ':', '_') || '-' || replace(regexp_extract(regexp_replace(url, '^https?://', ''), '^[^/]*/(.*)$', 1), '/', '-'), '$', '') || CASE WHEN regexp_matches(url, '\.(js|mjs|css|ts|tsx|vue)$') THEN '' ELSE '.js' END", "url")
scalar("absolute_url", "c_urls", url.is_http, "url LIKE 'http://%' OR url LIKE 'https://%'", "url")
scalar("static_resource", "c_urls", url.is_static, "contains(lower(url), '.js')", "url")
scalar("is_map_url", "c_urls", url.is_map, "regexp_matches(lower(url), '^[^?#]*\\.map($|[?#])')", "url")
scalar("map_url", "c_urls", url.map_of, r"split_part(url, '?', 1) || '.map' || CASE WHEN contains(url, '?') THEN '?' || regexp_extract(url, '^[^?]*\?(.*)$', 1) ELSE '' END", "url")
scalar("rebase_loopback", "c_urls", lambda u: url.rebase_loopback(u, F.lit("https://start.test:8443/app")), r"CASE WHEN regexp_matches(url, '^http://(127\.0\.0\.1|localhost)[:/]') THEN 'https://start.test:8443' || regexp_extract(url, '^http://[^/]*(/.*)$', 1) ELSE url END", "url")
scalar("join_url", "c_urls", lambda u: url.join(F.lit("https://b.test/"), u), "'https://b.test' || CASE WHEN url LIKE '/%' THEN url ELSE '/' || url END", "url")
scalar("flat_filename", "c_paths", content.flat_name, r"CASE WHEN contains(translate(replace(replace(regexp_replace(regexp_replace(path, '^/', ''), '/$', ''), '..', '_'), './', '_'), '/<>:|?*', '_______'), '..') THEN '' ELSE translate(replace(replace(regexp_replace(regexp_replace(path, '^/', ''), '/$', ''), '..', '_'), './', '_'), '/<>:|?*', '_______') END", "path")
scalar("map_prefix", "c_sourcemap_json", content.map_prefix, "regexp_extract(url, '([^/]*)\\.map$', 1)", "url")
scalar("safe_source_path", "c_paths", paths.safe_path, "CASE WHEN list_contains(string_split(path, '/'), '..') THEN NULL ELSE array_to_string(list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.')), '/') END", "path")
scalar("safe_file_path", "c_paths", paths.safe_file, "CASE WHEN list_contains(string_split(path, '/'), '..') THEN '' ELSE ltrim(path, '/') END", "path")
_CASES = "CASE id % 8 WHEN 0 THEN {0} WHEN 1 THEN 'node_modules/f' || id || '.js' WHEN 2 THEN {1} WHEN 3 THEN {2} WHEN 4 THEN 'a/b/d' || id || '.ts' WHEN 5 THEN 'a_b_c_' || id || '.js' WHEN 6 THEN 'abs/p' || id || '.js' ELSE {3} END"
scalar("sanitize_path", "c_paths", paths.sanitize, _CASES.format("'webpack_/src/A' || id || '.jsx'", "'file_/home/u/a' || id || '.js'", "'~/config' || id", "'https_/h.test/dir/x' || id || '.js'"), "path")
scalar("source_path", "c_paths", lambda p: paths.source_path(p, F.lit("")), _CASES.format("'src/A' || id || '.jsx'", "'home/u/a' || id || '.js'", "'config' || id", "'dir/x' || id || '.js'"), "path")
scalar("content_kind", "c_payloads", content.kind, "CASE id % 6 WHEN 0 THEN 'html' WHEN 1 THEN 'json' WHEN 2 THEN 'js' ELSE CASE id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'json' WHEN 2 THEN 'jsonp' WHEN 3 THEN 'json' ELSE 'js' END END", "content_type", "text")
scalar("jsonp_detect", "c_payloads", content.is_jsonp, r"regexp_matches(text, '^(window\.)?[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*\s*\(\s*[\[{]')", "text")
scalar("jsonp_name", "c_payloads", content.jsonp_name, r"nullif(regexp_extract(text, '^(?:window\.)?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(\s*[\[{]', 1), '')", "text")
scalar("jsonp_unwrap", "c_payloads", content.unwrap_jsonp, "CASE WHEN id % 5 = 2 THEN regexp_extract(text, '\\((.*)\\)', 1) END", "text")
scalar("valid_map", "c_sourcemap_json", content.is_source_map, "json_valid(text) AND json_array_length(text, '$.sources') > 0", "text")
scalar("data_uri", "c_paths", lambda p: content.data_uri(F.concat(F.lit("data:text/plain;base64,"), F.base64(p.cast("binary")))).cast("string"), "path", "path")
scalar("decode_text", "c_escaped_js", content.decode, "replace(replace(replace(replace(text, '%2F', '/'), chr(92) || 'u002F', '/'), chr(92) || '/', '/'), '&quot;', '\"')", "text")
_called("sql_url_rebase", "url_rebase", "c_urls", ORACLE_SQL["rebase_loopback"], ("url", "'https://start.test:8443/app'"), "result")
_called("sql_url_join", "url_join", "c_urls", ORACLE_SQL["join_url"], ("'https://b.test/'", "url"), "result")
_called("sql_path_of_source", "path_of_source", "c_paths", ORACLE_SQL["source_path"], ("path", "''"), "result")
_called("sql_url_host", "url_host", "pages", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS result FROM pages", ("url",), "result")


@query(rf"""WITH m AS (SELECT id, url, split_part(url, '??', 1) AS p, string_split(regexp_extract(split_part(url, '??', 2), '^([^?#]*)', 1), ',') AS fs, regexp_extract(split_part(url, '??', 2), '^[^?#]*(.*)$', 1) AS s FROM {_sql('c_urls')} t)
SELECT id, unnest(CASE WHEN contains(url, '??') THEN list_transform(list_filter(list_transform(fs, lambda f: trim(f)), lambda f: f <> ''), lambda f: p || f || s) ELSE [url] END) AS member FROM m""")
def combo_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "c_urls").select("id", F.explode(url.combo_members(F.col("url"))).alias("member"))


# Extractors.
found("html_scripts", "c_script_html", "HTMLScriptPlugin", r'<script[^>]*\bsrc="([^"]+)"', r'<link rel="modulepreload" href="([^"]+)"', r'<link rel="prefetch" href="([^"]+)"', r'<link href="([^"]+)" rel="prefetch"')
found("dynamic_imports", "c_import_js", "DynamicImportPlugin", r"""import\s*\(\s*["'`]([^"'`$]+)["'`]\s*\)""")
found("static_imports", "c_import_js", "ESMImportPlugin", r"""import\s*(?:\{[^}]*\}|\*\s*as\s+\w+|\w+)?\s*from\s*["']([^"')]+\.js)["']""", r"""import\s*["']([^"')]+\.js)["']""")
found("script_create", "c_create_js", "ScriptCreatePlugin", r'script\.setAttribute\("src","([^"]+)"\)', r'script\.src="([^"]+)"', r'new URL\("([^"]+)"\)', r'\bo\("([^"]+\.js[^"]*)"\)')
found("source_map_refs", "c_create_js", "SourceMapPlugin", r"sourceMappingURL=(.+)$", type_="map")
found("quoted_js", "c_create_js", "URLPatternPlugin", r"""["'`]([^"'`]+\.js)["'`]""", type_="probe", value="v", sql=r"""SELECT DISTINCT id, v AS value FROM (SELECT id, unnest(regexp_extract_all(text, '["''`]([^"''`]+\.js)["''`]', 1)) AS v FROM """ + _sql("c_create_js") + " t) WHERE NOT contains(v, 'node_modules/')")
found("webpack_chunks", "c_webpack_js", "WebpackPlugin", type_="probe", sql=rf"""SELECT id, '/r' || id || '/js/' || unnest(regexp_extract_all(text, '(\d+):"([^"]+)"', 1)) || '-' || unnest(regexp_extract_all(text, '(\d+):"([^"]+)"', 2)) || '.js' AS value FROM {_sql('c_webpack_js')} t""")
found("next_chunks", "c_next_js", "NextJSPlugin", type_="url,probe", sql=rf"""SELECT id, unnest([{_DIR} || 'static/chunks/a' || id || '.js', {_DIR} || 'static/chunks/a' || id || '.js', 'https://x.example.test/_next/static/chunks/a' || id || '.js']) AS value FROM {_sql('c_next_js')} t""")
ORACLE_SQL["next_chunks"] = rf"""SELECT DISTINCT id, unnest(['https://x.example.test/_next/static/' || v, 'https://x.example.test/_next/' || v]) AS value FROM (SELECT id, unnest(regexp_extract_all(text, '"(static/[^"]+\.js)"', 1)) AS v FROM {_sql('c_next_js')} t)"""
found("build_manifest", "c_manifest_json", "VitePlugin", r'"file":"/?([^"]+\.js)"', value="'https://v.example.test/' || v")
found("nuxt_assets", "c_frame_html", "NuxtJSPlugin", r'"(/_nuxt/[^"]+\.js)"')
found("svelte_assets", "c_frame_html", "SvelteKitPlugin", r"'\.\./((?:nodes|chunks)/[^']+\.js)'", value=_ORIGIN + " || '/_app/immutable/' || v")
found("amd_deps", "c_amd_js", "RequireJSPlugin", r'["\[,]"?((?:\./|/|https://)[^"]+)"', value="CASE WHEN v LIKE 'http%' OR v LIKE '%.js' THEN " + _resolved("v") + " ELSE " + _resolved("v") + " || '.js' END")
found("sitemap_manifest", "c_sitemap_json", "TrunkPlugin", sql=rf"""SELECT id, {_DIR} || unnest(['js/lazy' || id || '.js', 'js/w.' || json_extract_string(text, '$.chunks.w') || '.js', json_extract_string(text, '$.workers[0]')]) AS value FROM {_sql('c_sitemap_json')} t""")
found("federation_refs", "c_federation_js", "ModuleFederationPlugin", type_="url,html", sql=rf"""SELECT id, unnest([e, d || 'mf-manifest.json', d || 'federation-manifest.json', d || 'index.html', replace(d, 'assets/', '') || 'index.html']) AS value FROM (SELECT id, e, replace(e, 'remoteEntry.js', '') AS d FROM (SELECT id, regexp_extract(text, '"([^"]*remoteEntry\.js)"', 1) AS e FROM {_sql('c_federation_js')} t))""")
found("federation_manifest", "c_federation_json", "ModuleFederationManifestPlugin", sql=rf"""SELECT id, json_extract_string(text, '$.metaData.publicPath') || '/' || unnest([json_extract_string(text, '$.exposes[0].assets.js.sync[0]'), json_extract_string(text, '$.exposes[0].assets.js.async[0]')]) AS value FROM {_sql('c_federation_json')} t""")
found("emp_manifest", "c_emp_json", "EmpPlugin", r'"((?:entry\d+|js/\w+)\.js)"')
found("component_metadata", "c_hel_json", "HelMicroPlugin", r'"((?:comp|c)\d+\.js)"', type_="probe", value="v")
found("micro_entries", "c_micro_js", "QiankunPlugin", r'entry:"((?:/[^/]|https)[^"]+)"', type_="html")
found("const_propagation", "c_const_js", "UniversalURLPlugin", sql=rf"""SELECT id, {_ORIGIN} || '/lib/v' || id || '/x/z' || id || '.js' AS value FROM {_sql('c_const_js')} t""")
found("universal_urls", "c_escaped_js", "UniversalURLPlugin", sql=rf"""SELECT id, {_ORIGIN} || unnest(['/esc' || id || '/x.js', '/pct' || id || '/y.js', '/ent' || id || '/z.js', '/uni' || id || '/w.js']) AS value FROM {_sql('c_escaped_js')} t""")


@query(rf"""SELECT id, unnest(['HTMLScriptPlugin', 'UniversalURLPlugin', 'VitePlugin']) AS plugin FROM {_sql('c_script_html')} t UNION ALL SELECT id + 1000000, unnest(['DynamicImportPlugin', 'ESMImportPlugin', 'URLPatternPlugin', 'UniversalURLPlugin']) FROM {_sql('c_import_js')} t""")
def plugin_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which extractors find anything, with all of them running."""
    docs = _rows(spark, sf_dir, "c_script_html").unionByName(_rows(spark, sf_dir, "c_import_js").withColumn("id", F.col("id") + 1000000))
    rows = extract(docs, keep=("id",))
    return rows.where("plugin <> 'HTMLPivotPlugin' or type = 'html'").select("id", "plugin").distinct()


@query(rf"""SELECT id, unnest(regexp_extract_all(text, 'src="(/s/[^"]+)"', 1)) AS value FROM {_sql('c_script_html')} t""")
def custom_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extractor of a caller's own, beside none of the others."""

    def own(d: Doc) -> Column:
        return tagged("probe", matches(d.text, 'src="(/s/[^"]+)"'))

    return extract(_rows(spark, sf_dir, "c_script_html"), Registry({"Own": own}), keep=("id",)).select("id", "value")


@query(rf"""SELECT id, unnest(regexp_extract_all(text, 'src="([^"]+)"', 1)) AS value FROM {_sql('c_script_html')} t""")
def udtf_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's Python table function, called laterally for each document."""

    class Sources:
        def eval(self, text: str):
            import re

            for m in re.finditer('src="([^"]+)"', text):
                yield (m[1],)

    spark.udtf.register("own_sources", F.udtf(Sources, returnType="value string"))
    _rows(spark, sf_dir, "c_script_html").createOrReplaceTempView("udtf_docs")
    return spark.sql("SELECT id, s.value FROM udtf_docs, LATERAL own_sources(text) s")


@query(rf"""SELECT id, {_DIR} || 'inner/' || id || '.js' AS value FROM {_sql('c_script_html')} t""")
def inline_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inline scripts import, relative to their page."""
    docs = _rows(spark, sf_dir, "c_script_html")
    inner = docs.select("id", "url", F.lit("js").alias("kind"), F.posexplode(scanners.inline_scripts(F.col("text"))).alias("inline", "text")).where("text <> ''")
    return extract(inner, Registry().only("DynamicImportPlugin"), keep=("id", "inline")).select("id", "value")


@query(rf"""SELECT id, count(*) AS n FROM (SELECT id, least(generate_series, 50) FROM {_sql('c_script_html')} t, generate_series(1, 50)) GROUP BY id""")
def plugin_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 50 entries of a document count."""
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit('{name:"a",entry:"/e'), i.cast("string"), F.lit('/"}'))), ",")
    docs = _rows(spark, sf_dir, "c_script_html").select("id", "url", F.lit("js").alias("kind"), many.alias("text"))
    return extract(docs, Registry().only("QiankunPlugin"), keep=("id",)).groupBy("id").agg(F.count("*").alias("n"))


# Responses: lookups, routing, budgets and the loop.
_R = _sql("c_responses")
_ASKED = "(SELECT 'https://site.test/s/' || CAST(s_suppkey AS STRING) || '.js' AS url FROM supplier)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "supplier").select(F.concat(F.lit("https://site.test/s/"), F.col("s_suppkey").cast("string"), F.lit(".js")).alias("url"))


@query(f"SELECT f.url, r.status FROM {_ASKED} f LEFT JOIN {_R} r USING (url)")
def fetch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.fetch(_asked(spark, sf_dir), _rows(spark, sf_dir, "c_responses")).select("url", "status")


@query(f"SELECT f.url, length(r.text) AS size FROM {_ASKED} f JOIN {_R} r USING (url) WHERE r.status BETWEEN 200 AND 299")
def fetch_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.fetch(_asked(spark, sf_dir), _rows(spark, sf_dir, "c_responses")).where("status between 200 and 299").select("url", F.length("text").cast("long").alias("size"))


@query(f"SELECT url, status FROM {_R} r WHERE status BETWEEN 200 AND 299")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.route(_everything(spark, sf_dir)).select("url", "status")


def _everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir, "c_responses")
    return discover.fetch(r.select(url.normalize(F.col("url")).alias("url")), r)


@query(f"SELECT url, CASE WHEN content_type = 'text/html' AND url LIKE '%.js' THEN 'dropped' WHEN content_type = 'text/html' THEN 'document' ELSE 'script' END AS role FROM {_R} r WHERE status = 200")
def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.route(_everything(spark, sf_dir)).select("url", "role")


@query(f"SELECT url FROM {_R} r WHERE status = 200 AND content_type = 'text/html' AND url LIKE '%.js'")
def soft_404(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.route(_everything(spark, sf_dir)).where("role = 'dropped'").select("url")


@query(f"SELECT f.url, r.status IS NOT NULL AS known FROM {_ASKED} f LEFT JOIN {_R} r USING (url)")
def frontier_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.fetch(_asked(spark, sf_dir), _rows(spark, sf_dir, "c_responses")).select("url", F.col("status").isNotNull().alias("known"))


@query(f"SELECT f.url FROM {_ASKED} f ANTI JOIN {_R} r USING (url)")
def claim_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).withColumn("seq", F.lit(1))
    return discover.claim(asked.unionByName(asked), _rows(spark, sf_dir, "c_responses"), ["url"], ["seq"]).select("url")


_SCRIPTS = Registry().only("HTMLScriptPlugin", "DynamicImportPlugin", "HTMLPivotPlugin")


def _discovered(spark: SparkSession, sf_dir: str) -> discover.Result:
    starts = spark.range(1).select(F.lit("site").alias("scan"), F.lit("https://site.test").alias("start"))
    return discover.discover(starts, _rows(spark, sf_dir, "c_responses"), _SCRIPTS)


_REACH = f"""WITH RECURSIVE r AS (SELECT * FROM {_R} x WHERE status = 200 AND NOT (content_type = 'text/html' AND url LIKE '%.js')),
e AS (SELECT url AS a, CASE WHEN v LIKE '../%' THEN 'https://site.test' || substr(v, 3) WHEN v LIKE './%' THEN 'https://site.test/r' || substr(v, 2) ELSE 'https://site.test' || v END AS b FROM (SELECT url, unnest(regexp_extract_all(text, '(?:import\\(|src=|href=)"([^"]+)"', 1)) AS v FROM r)),
w(url) AS (SELECT 'https://site.test' UNION SELECT e.b FROM w JOIN r ON r.url = w.url JOIN e ON e.a = w.url)"""


@query(_REACH + " SELECT w.url FROM w JOIN r ON r.url = w.url WHERE r.content_type <> 'text/html'")
def crawl_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir).js_entries.select("url")


@query(_REACH + " SELECT w.url, CASE WHEN w.url LIKE '%/r/_.js' THEN 'HTMLScriptPlugin' ELSE 'DynamicImportPlugin' END AS plugin FROM w JOIN r ON r.url = w.url WHERE r.content_type <> 'text/html'")
def js_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir).js_entries.select("url", "plugin")


@query(_REACH + " SELECT count(*) AS js_count FROM w JOIN r ON r.url = w.url WHERE r.content_type <> 'text/html'")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir).summary().select("js_count")


@query("SELECT s_suppkey % 3 AS scan, s_suppkey AS seq FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) <= 20 - s_suppkey % 3")
def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _rows(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).alias("scan"), F.col("s_suppkey").alias("seq"))
    return discover.budgeted(pages, pages.select("scan", F.col("scan").alias("used")).distinct(), 20, ["seq"])


_FRAG = "(SELECT 'a' AS scan, n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'js/v' || CAST(n_nationkey % 3 AS STRING) || '/c' || CAST(n_nationkey AS STRING) || '.js' ELSE '/x/d' || CAST(n_nationkey AS STRING) || '.js' END AS fragment, 'https://d.test/p/' AS from_url FROM nation)"
_KNOWN = f"(SELECT 'a' AS scan, url FROM {_sql('c_import_js')} t)"


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    odd = F.concat(F.lit("/x/d"), s, F.lit(".js"))
    return _rows(spark, sf_dir, "nation").select(F.lit("a").alias("scan"), k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("js/v"), (k % 3).cast("string"), F.lit("/c"), s, F.lit(".js"))).otherwise(odd).alias("fragment"), F.lit("https://d.test/p/").alias("from_url"))


@query(f"WITH k AS (SELECT DISTINCT scan, {_DIR} AS dir FROM {_KNOWN}), f AS (SELECT *, regexp_extract(fragment, '^(.*)/', 1) AS p, regexp_extract(fragment, '([^/]*)$', 1) AS n FROM {_FRAG}) SELECT id, dir || n AS candidate FROM f JOIN k ON ends_with(rtrim(dir, '/'), p) AND p <> ''")
def fragment_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _rows(spark, sf_dir, "c_import_js").select(F.lit("a").alias("scan"), "url")
    return discover.suffix_join(_fragments(spark, sf_dir), known).select("id", "candidate")


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


@query(f"SELECT id, 'https://cdn' || CAST(r_regionkey AS STRING) || '.test/' || ltrim(fragment, '/') AS candidate FROM {_FRAG} f, region UNION SELECT id, 'https://s.test/' || ltrim(fragment, '/') FROM {_FRAG} f UNION SELECT id, 'https://d.test' || fragment FROM {_FRAG} f WHERE fragment LIKE '/%'")
def fragment_prepend(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _rows(spark, sf_dir, "region").select(F.lit("a").alias("scan"), F.concat(F.lit("https://cdn"), F.col("r_regionkey").cast("string"), F.lit(".test")).alias("prefix"))
    starts = spark.range(1).select(F.lit("a").alias("scan"), F.lit("https://s.test/app/").alias("start"))
    return discover.resolve_fragments(_fragments(spark, sf_dir), _none(spark, "scan string, url string"), before, _none(spark, "scan string, path string, seq long"), starts).select("id", "candidate").distinct()


@query(f"SELECT id, p || '/' || ltrim(fragment, '/') AS candidate FROM {_FRAG} f, (VALUES ('https://d.test/one'), ('https://q.test/two'), ('https://q.test/three')) v(p) UNION SELECT id, 'https://d.test' || fragment FROM {_FRAG} f WHERE fragment LIKE '/%'")
def fragment_public_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    publics = spark.createDataFrame([("a", "/one/", 1), ("a", "https://q.test/two/", 2), ("a", "/three", 3)], "scan string, path string, seq long")
    out = discover.resolve_fragments(_fragments(spark, sf_dir), _none(spark, "scan string, url string"), _none(spark, "scan string, prefix string"), publics, _none(spark, "scan string, start string"))
    return out.select("id", "candidate").distinct()


@query("SELECT s_suppkey AS id, 'https://d.test/p/c' || CAST(s_suppkey AS STRING) || '.js' AS candidate FROM supplier UNION ALL SELECT s_suppkey, 'https://cdn.test/x/c' || CAST(s_suppkey AS STRING) || '.js' FROM supplier")
def bare_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _rows(spark, sf_dir, "supplier").select(F.lit("a").alias("scan"), F.col("s_suppkey").alias("id"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string"), F.lit(".js")).alias("fragment"), F.lit("https://d.test/p/q.js").alias("from_url"))
    return discover.bare_names(names, spark.createDataFrame([("a", "https://cdn.test/x")], "scan string, prefix string")).select("id", "candidate")


@query(rf"""SELECT DISTINCT id, v AS value, CASE WHEN contains(v, '://') THEN 'queue' WHEN contains(v, '/') THEN 'fragment' ELSE 'bare' END AS route FROM (SELECT id, unnest(regexp_extract_all(text, '["''`]([^"''`]+\.js)["''`]', 1)) AS v FROM {_sql('c_import_js')} t)""")
def probe_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(_rows(spark, sf_dir, "c_import_js"), Registry().only("URLPatternPlugin"), keep=("id",)).where("type = 'probe'")
    return rows.select("id", "value", F.when(F.col("value").contains("://"), "queue").when(F.col("value").contains("/"), "fragment").otherwise("bare").alias("route"))


@query(f"SELECT DISTINCT {_DIR} AS prefix FROM {_sql('c_import_js')} t")
def known_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "c_import_js").select(url.directory(F.col("url")).alias("prefix")).distinct()


@query(_REACH + " SELECT string_agg(w.url, chr(10) ORDER BY w.url) AS report FROM w JOIN r ON r.url = w.url WHERE r.content_type <> 'text/html'")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = _discovered(spark, sf_dir).js_entries
    return report.text_report(js.withColumn("seq", F.col("url"))).select("report")


_META = _REACH + " SELECT 'https___site.test' AS scope, 'url' AS kind, w.url AS value FROM w JOIN r ON r.url = w.url WHERE r.content_type <> 'text/html' UNION SELECT 'https___site.test', 'prepend', regexp_extract(w.url, '^(.*/)', 1) FROM w JOIN r ON r.url = w.url WHERE r.content_type <> 'text/html'"
_META = _META.replace("https___site.test", "https_site.test")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = _discovered(spark, sf_dir).js_entries.withColumn("start", F.lit("https://site.test")).withColumn("scan", F.lit("https://site.test"))
    return store.metadata(js, _none(spark, "scan string, prefix string"), _none(spark, "scan string, path string"))


@query(_META)
def meta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir)


@query("SELECT 'scope' || CAST(n_nationkey AS STRING) AS scope, n_nationkey % 3 <> 0 AS complete FROM nation")
def meta_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes whose addresses are recorded, and whether all their sources are still there."""
    n = _rows(spark, sf_dir, "nation").select(F.concat(F.lit("scope"), F.col("n_nationkey").cast("string")).alias("scope"), F.col("n_nationkey").alias("k"))
    wanted = n.select("scope", F.explode(F.array(F.lit("a.js"), F.lit("b.js"))).alias("path"), "k")
    return store.replayable(n.select("scope", F.lit("url").alias("kind")), wanted.select("scope", "path"), wanted.where("k % 3 <> 0 or path = 'a.js'").select("scope", "path"))


@query("SELECT s_suppkey AS id, 'n' || CAST(s_suppkey % 5 AS STRING) AS scope FROM supplier")
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as it is read back from a store in the shared folder."""
    kept = store.Store(spark, f"{shared.shared_folder(spark)}/store-{uuid.uuid4().hex}")
    kept.write("js", _rows(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), (F.col("s_suppkey") % 5).cast("string")).alias("scope")))
    return kept.read("js").select("id", "scope")


# Source maps.
_M = _sql("c_sourcemap_json")
scalar("map_parsable", "c_sourcemap_json", content.is_source_map, "json_valid(text) AND json_array_length(text, '$.sources') > 0", "text")


@query(f"SELECT id, json_array_length(text, '$.sources') AS n_sources, CAST(json_extract(text, '$.version') AS DOUBLE) AS version, json_extract_string(text, '$.sourceRoot') AS root, json_extract_string(text, '$.sources[1]') AS second FROM {_M} t")
def parse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcemaps.parse_maps(_rows(spark, sf_dir, "c_sourcemap_json")).select("id", F.size("sources").cast("long").alias("n_sources"), "version", "root", F.get("sources", F.lit(1)).alias("second"))


@query(f"SELECT id, true AS has_contents FROM {_M} t")
def has_sources_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcemaps.has_contents(sourcemaps.parse_maps(_rows(spark, sf_dir, "c_sourcemap_json"))).select("id", "has_contents")


_FILES = f"""SELECT id, i AS idx, CASE WHEN id % 4 = 0 THEN '' ELSE CASE i WHEN 1 THEN '' ELSE 'root/' END END || CASE i WHEN 0 THEN 'src/App' || id || '.jsx' WHEN 1 THEN 'lib/u' || id % 13 || '.js' ELSE 'conf' || id END AS path, CASE i WHEN 0 THEN 'app' || id WHEN 1 THEN 'lib' ELSE 'conf' END AS content FROM {_M} t, (VALUES (0), (1), (2)) v(i) WHERE i <> 1 OR id % 3 <> 0"""


@query(_FILES)
def restore_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcemaps.restore(_rows(spark, sf_dir, "c_sourcemap_json"), ("id",)).select("id", "idx", "path", "content")


@query(f"SELECT id, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM ({_FILES}) GROUP BY id")
def sources_per_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sourcemaps.restore(_rows(spark, sf_dir, "c_sourcemap_json"), ("id",))
    return files.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))


@query(f"SELECT id, count(*) AS total, count(*) FILTER (WHERE r <= 2000) AS kept, count(*) FILTER (WHERE r > 2000) AS omitted FROM (SELECT id, row_number() OVER (ORDER BY id, idx) AS r FROM ({_FILES})) GROUP BY id")
def restore_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcemaps.counted(sourcemaps.restore(_rows(spark, sf_dir, "c_sourcemap_json"), ("id",)), "id")


@query(f"SELECT greatest(0, count(*) - 2000) AS omitted FROM ({_FILES})")
def sources_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcemaps.restore(_rows(spark, sf_dir, "c_sourcemap_json"), ("id",)).agg(F.greatest(F.lit(0), F.count("*") - 2000).alias("omitted"))


@query(f"SELECT DISTINCT path FROM ({_FILES})")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcemaps.restore(_rows(spark, sf_dir, "c_sourcemap_json"), ("id",)).select("path").distinct().orderBy("path")


@query(f"SELECT replace(url, '.map', '') AS url, url AS map_url FROM {_M} t")
def map_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _rows(spark, sf_dir, "c_sourcemap_json").select("url", F.lit(200).alias("status"), F.lit("application/json").alias("content_type"), "text")
    return sourcemaps.probe_maps(maps.select(F.replace("url", F.lit(".map"), F.lit("")).alias("url")), maps).select("url", "map_url")


@query(_FILES)
def inline_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps that stand in a script as data addresses."""
    maps = _rows(spark, sf_dir, "c_sourcemap_json")
    scripts = maps.select("id", F.concat(F.lit("data:application/json;base64,"), F.base64(F.col("text").cast("binary"))).alias("uri"))
    return sourcemaps.restore(scripts.select("id", content.utf8(content.data_uri(F.col("uri"))).alias("text")), ("id",)).select("id", "idx", "path", "content")


_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/'"
_SEGMENTS = f"""WITH l AS (SELECT id, unnest(string_split(mappings, ';')) AS line, unnest(range(len(string_split(mappings, ';')))) AS gen_line FROM {_sql('c_mappings')} t),
l2 AS (SELECT id, gen_line, list_filter(string_split(line, ','), lambda x: x <> '') AS segs FROM l),
s AS (SELECT id, gen_line, unnest(segs) AS seg, unnest(range(len(segs))) AS place FROM l2),
r AS (SELECT id, gen_line, place, list_reduce(list_transform(string_split(seg, ''), lambda c: {{'d': CAST(instr({_ALPHABET}, c) - 1 AS BIGINT), 'v': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 'o': CAST([] AS BIGINT[]), 'b': false}}),
  lambda a, c: CASE WHEN a.b OR len(a.o) = 5 THEN a WHEN c.d < 0 THEN {{'d': a.d, 'v': a.v, 's': a.s, 'o': a.o, 'b': true}} WHEN c.d >= 32 THEN {{'d': a.d, 'v': a.v + (c.d % 32) * CAST(power(2, a.s) AS BIGINT), 's': a.s + 5, 'o': a.o, 'b': false}}
  ELSE {{'d': a.d, 'v': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 'o': list_append(a.o, CASE WHEN (a.v + c.d * CAST(power(2, a.s) AS BIGINT)) % 2 = 0 THEN 1 ELSE -1 END * ((a.v + c.d * CAST(power(2, a.s) AS BIGINT)) // 2)), 'b': false}} END,
  {{'d': CAST(0 AS BIGINT), 'v': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 'o': CAST([] AS BIGINT[]), 'b': false}}) AS x FROM s),
v AS (SELECT id, gen_line, place, x.o AS o, NOT x.b AND (len(x.o) = 5 OR x.s = 0) AND len(x.o) NOT IN (0, 2, 3) AS good FROM r)"""
_MAPPINGS = _SEGMENTS + """,
u AS (SELECT * FROM v QUALIFY count(*) FILTER (WHERE NOT good) OVER (PARTITION BY id, gen_line ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0),
g AS (SELECT id, gen_line, place, good, len(o) AS k, sum(coalesce(o[1], 0)) OVER (PARTITION BY id, gen_line ORDER BY place) AS c0, sum(coalesce(o[2], 0)) OVER w AS c1, sum(coalesce(o[3], 0)) OVER w AS c2, sum(coalesce(o[4], 0)) OVER w AS c3, sum(coalesce(o[5], 0)) OVER w AS c4 FROM u WINDOW w AS (PARTITION BY id ORDER BY gen_line, place)),
q AS (SELECT id, CAST(gen_line AS INT) AS gen_line, place, CAST(c0 AS INT) AS gen_col, CAST(CASE WHEN k >= 4 THEN c1 ELSE -1 END AS INT) AS src, CAST(CASE WHEN k >= 4 THEN c2 ELSE -1 END AS INT) AS src_line, CAST(CASE WHEN k >= 4 THEN c3 ELSE -1 END AS INT) AS src_col, CAST(CASE WHEN k = 5 THEN c4 ELSE -1 END AS INT) AS name FROM g WHERE good)"""


# Numbers of 32 bits, of which a digit from the 36th bit on is none, as mappings.decoded reads them.
_GROWN = "a.v + CASE WHEN a.s <= 30 THEN (c.d % 32) * CAST(power(2, least(a.s, 30)) AS BIGINT) ELSE 0 END"
_WIDE = f"(({_GROWN} + 2147483648) % 4294967296 - 2147483648)"
_NUMBERS = _SEGMENTS.replace("a.v + (c.d % 32) * CAST(power(2, a.s) AS BIGINT)", _GROWN).replace("CASE WHEN (a.v + c.d * CAST(power(2, a.s) AS BIGINT)) % 2 = 0 THEN 1 ELSE -1 END * ((a.v + c.d * CAST(power(2, a.s) AS BIGINT)) // 2)", f"CASE WHEN {_WIDE} % 2 = 0 THEN {_WIDE} // 2 ELSE -(({_WIDE} - 1) // 2) END")


@query(_NUMBERS + " SELECT id, gen_line, place, o[1] AS value FROM v")
def vlq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of every segment, null where it is broken."""
    lines = _rows(spark, sf_dir, "c_mappings").select("id", F.posexplode(F.split("mappings", ";")).alias("gen_line", "line"))
    cut = lines.select("id", F.col("gen_line").cast("long").alias("gen_line"), F.posexplode(F.filter(F.split("line", ","), lambda s: s != "")).alias("place", "segment"))
    return cut.select("id", "gen_line", F.col("place").cast("long").alias("place"), F.get(mappings.decoded(F.col("segment"))["values"], F.lit(0)).alias("value"))


@query(_MAPPINGS + " SELECT id, gen_line, gen_col, src, src_line, src_col, name FROM q")
def parse_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mappings of all maps, as a table with running sums."""
    return mappings.segments(_rows(spark, sf_dir, "c_mappings"), "id").drop("place")


@query(
    _MAPPINGS
    + f""", t AS (SELECT id, unnest(string_split(minified, chr(10))) AS text, unnest(range(len(string_split(minified, chr(10))))) AS line FROM {_sql('c_mappings')} t),
z AS (SELECT id, src, gen_line AS a, place, greatest(gen_col, 0) AS c, lead(gen_line) OVER w AS a2, lead(greatest(gen_col, 0)) OVER w AS c2, row_number() OVER w = 1 AS first FROM q WHERE gen_line < 3 WINDOW w AS (PARTITION BY id, src ORDER BY gen_line, place)),
p AS (SELECT z.id, src, a, place, 0 AS kind, line, substr(text, 1, CASE WHEN line = a THEN c ELSE length(text) END) || CASE WHEN line < a THEN chr(10) ELSE '' END AS piece FROM z JOIN t ON t.id = z.id AND first AND line <= a
UNION ALL SELECT z.id, src, a, place, 1, line, substr(text, CASE WHEN line = a THEN c ELSE 0 END + 1, greatest(0, CASE WHEN line = a2 THEN c2 ELSE length(text) END - CASE WHEN line = a THEN c ELSE 0 END)) || CASE WHEN line < a2 THEN chr(10) ELSE '' END FROM z JOIN t ON t.id = z.id AND line BETWEEN a AND coalesce(a2, a))
SELECT id, src, string_agg(piece, '' ORDER BY a, place, kind, line) AS content FROM p GROUP BY id, src"""
)
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's mappings cut out of the script."""
    return mappings.rebuilt(_rows(spark, sf_dir, "c_mappings"), "id")


@query(f"SELECT id, substr(text, 2, length(text) - 2) AS body FROM {_sql('c_manifest_json')} t")
def brace_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _rows(spark, sf_dir, "c_manifest_json").select("id", F.concat(F.lit("window.X = "), "text", F.lit(";")).alias("text"))
    return docs.select("id", scanners.brace_json(F.col("text"), "window.X").alias("body"))


# Whole scans.
_N = "CAST(n_nationkey AS VARCHAR)"
_MAPPED = f"""WITH js AS (SELECT n_nationkey AS k, 'https://maps.test/j/' || {_N} || '.js' AS url, {_N} AS n FROM nation),
m AS (SELECT k, n, url, CASE k % 3 WHEN 0 THEN 'https://maps.test/j/m' || n || '.map' WHEN 1 THEN url || '.map' ELSE 'data:application/json,{{"version":3,"sources":["src/in' || n || '.ts"],"sourcesContent":["in' || n || '"]}}' END AS map_url FROM js WHERE k % 6 <> 4),
f AS (SELECT url AS js_url, unnest(CASE k % 3 WHEN 2 THEN ['src/in' || n || '.ts'] ELSE ['src/a' || n || '.ts', 'src/b' || n || '.ts'] END) AS path, unnest(CASE k % 3 WHEN 2 THEN ['in' || n] ELSE ['A' || n, 'B' || n] END) AS content FROM m)"""


def _mapped_scan(spark: SparkSession, sf_dir: str, kept: store.Store | None = None, answers: bool = True) -> ScanResult:
    starts = spark.range(1).select(F.lit("maps").alias("scan"), F.lit("https://maps.test").alias("start"))
    responses = _rows(spark, sf_dir, "c_mapped")
    return scan(starts, responses if answers else responses.limit(0), Registry().only("HTMLScriptPlugin", "SourceMapPlugin"), store=kept)


@query(_MAPPED + " SELECT url, map_url FROM m")
def scan_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every script's valid map, wherever it stands."""
    return _mapped_scan(spark, sf_dir).maps.select("url", "map_url")


@query(_MAPPED + " SELECT js_url, path, content FROM f")
def scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that a script's map restores."""
    return _mapped_scan(spark, sf_dir).sources.select("js_url", "path", "content")


@query(_MAPPED + " SELECT (SELECT count(*) FROM js) AS js_count, (SELECT count(*) FROM m) AS map_count, (SELECT count(*) FROM f) AS source_count, greatest(0, (SELECT count(*) FROM f) - 20) AS sources_omitted")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped_scan(spark, sf_dir).summary(kept=20).select("js_count", "map_count", "source_count", "sources_omitted")


@query(_MAPPED + " SELECT js.url, m.map_url, count(f.path) AS n_sources FROM js LEFT JOIN m USING (k) LEFT JOIN f ON f.js_url = js.url GROUP BY ALL")
def scan_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan that has the store and no responses."""
    kept = store.Store(spark, f"{shared.shared_folder(spark)}/store-{uuid.uuid4().hex}")
    _mapped_scan(spark, sf_dir, kept)
    return _mapped_scan(spark, sf_dir, kept, answers=False).js.select("url", "map_url", "n_sources")


@query(_MAPPED + " SELECT js_url, path, content FROM f")
def scan_lost_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a store has lost, restored again from the maps that it knows."""
    kept = store.Store(spark, f"{shared.shared_folder(spark)}/store-{uuid.uuid4().hex}")
    first = _mapped_scan(spark, sf_dir, kept)
    kept.write("sources", first.sources.where("path like '%a%'"), "scan")
    return _mapped_scan(spark, sf_dir, kept).sources.select("js_url", "path", "content")


_MOVED = "SELECT 'https://new' || CAST(r_regionkey AS VARCHAR) || '.test/app/' || f AS url FROM region, (VALUES ('one.js'), ('two.js')) v(f)"


@query(_MOVED)
def redirected_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts that lead to another host: what they name is there, and so is what loopback addresses stand for."""
    k = F.col("r_regionkey").cast("string")
    at, page_at = (F.concat(F.lit("https://new"), k, F.lit(x)) for x in (".test/app/", ".test/app/p.html"))
    r = _rows(spark, sf_dir, "region")
    html, js = "text/html", "text/javascript"
    row = lambda u, c, t, f=None: r.select(u.alias("url"), F.lit(200).alias("status"), F.lit(c).alias("content_type"), F.lit(t).alias("text"), (F.lit(None).cast("string") if f is None else f).alias("final_url"))
    page = row(F.concat(F.lit("https://old"), k, F.lit(".test")), html, '<script src="one.js"></script><script src="http://127.0.0.1:8080/app/two.js"></script>', page_at)
    responses = page.unionByName(row(F.concat(at, F.lit("one.js")), js, "a")).unionByName(row(F.concat(at, F.lit("two.js")), js, "b"))
    starts = r.select(k.alias("scan"), F.concat(F.lit("https://old"), k, F.lit(".test")).alias("start"))
    return discover.discover(starts, responses, Registry().only("HTMLScriptPlugin")).js_entries.select("url")


@query("SELECT 'https://f' || CAST(n_nationkey AS VARCHAR) || '.test' AS start, CASE n_nationkey % 3 WHEN 1 THEN 404 END AS status FROM nation WHERE n_nationkey % 3 <> 0")
def failed_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts that nothing came of, and what they answered, if anything."""
    k = F.col("n_nationkey")
    n = _rows(spark, sf_dir, "nation").select(k.cast("string").alias("scan"), F.concat(F.lit("https://f"), k.cast("string"), F.lit(".test")).alias("start"), (k % 3).alias("m"))
    responses = n.where("m < 2").select(F.col("start").alias("url"), F.when(F.col("m") == 1, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit("<p>x</p>").alias("text"))
    return discover.discover(n.select("scan", "start"), responses, Registry().only("HTMLScriptPlugin")).failed.select("start", "status")


@query("SELECT 'https://n' || CAST(r_regionkey AS VARCHAR) || '.test/_next/static/chunks/app/p' || CAST(r_regionkey AS VARCHAR) || '.js' AS url FROM region")
def flight_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts that only a page's flight payload names, asked for with the header's request."""
    k = F.col("r_regionkey").cast("string")
    r = _rows(spark, sf_dir, "region").select(k.alias("scan"), F.concat(F.lit("https://n"), k, F.lit(".test")).alias("start"), k.alias("k"))
    html = r.select(F.col("start").alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit('<script id="__NEXT_DATA__"></script>').alias("text"), F.lit("").alias("request"))
    flight = r.select(F.col("start").alias("url"), F.lit(200), F.lit("text/x-component"), F.concat(F.lit('1:I[12,["7","/_next/static/chunks/app/p'), "k", F.lit('.js"],"default"]')), F.lit("RSC"))
    script = r.select(F.concat("start", F.lit("/_next/static/chunks/app/p"), "k", F.lit(".js")).alias("url"), F.lit(200), F.lit("text/javascript"), F.lit("x"), F.lit(""))
    return discover.discover(r.select("scan", "start"), html.union(flight).union(script), Registry().only("NextJSPlugin")).js_entries.select("url")


@query(f"SELECT id, regexp_extract(url, '^(.*/)', 1) || 'h' || id || '.map' AS value FROM {_sql('c_import_js')} t")
def header_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps that a header names, however its name is spelled."""
    spelled = F.element_at(F.array(F.lit("SourceMap"), F.lit("X-SourceMap"), F.lit("sourcemap")), (F.col("id") % 3 + 1).cast("int"))
    docs = _rows(spark, sf_dir, "c_import_js").withColumn("headers", F.create_map(F.lit("ETag"), F.lit("1"), spelled, F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".map"))))
    return extract(docs, Registry().only("SourceMapPlugin"), keep=("id",)).where("type = 'map'").select("id", "value")


# Recordings as a source, trees of files as a sink.
@query("SELECT url, length(html) AS size, sha256(html) AS digest FROM pages WHERE url LIKE 'https://www.%' UNION ALL SELECT url, NULL, NULL FROM pages WHERE page_id % 3 = 0 AND url LIKE 'https://www.%'")
def captured_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as recorded exchanges and read again by ranges of addresses; HEAD requests have no text."""
    path = f"{shared.shared_folder(spark)}/recording-{uuid.uuid4().hex}"
    pages = _rows(spark, sf_dir, "pages")
    got = pages.select("url", F.lit("GET").alias("method"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("text"))
    heads = pages.where("page_id % 3 = 0").select("url", F.lit("HEAD"), F.lit(200), F.lit("text/html"), F.lit(None).cast("string"))
    captures.record(got.union(heads), path)
    back = captures.recorded(spark, path, ["url", "method", "text"]).where("url like 'https://www.%' and method in ('GET', 'HEAD')")
    return back.select("url", F.length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"))


_TREE = """, t AS (SELECT 'js' AS slot, 'maps.test-j-' || n || '.js' AS path, CASE k % 3 WHEN 0 THEN 'var a;' || chr(10) || '//# sourceMappingURL=m' || n || '.map' WHEN 1 THEN 'var b;' ELSE 'var c;' || chr(10) || '//# sourceMappingURL=' || (SELECT map_url FROM m WHERE m.k = js.k) END AS content FROM js
UNION ALL SELECT 'sources', path, content FROM f
UNION ALL SELECT 'source_map', substr(sha256(map_url), 1, 12) || '-' || regexp_extract(map_url, '([^/]*)[.]map$', 1) || '.map', '{"version":3,"sources":["webpack:///./src/a' || n || '.ts","webpack:///./src/b' || n || '.ts"],"sourcesContent":["A' || n || '","B' || n || '"]}' FROM m WHERE k % 3 <> 2
UNION ALL SELECT 'html', 'web.html', '<html>' || (SELECT string_agg('<script src="/j/' || n || '.js"></script>', '' ORDER BY k) FROM js) || '</html>')"""


@query(_MAPPED + _TREE + " SELECT 'maps' AS scope, slot, path, CASE WHEN slot = 'html' THEN CAST(length(content) AS VARCHAR) ELSE content END AS content FROM t")
def tree_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan's scripts, maps, sources and page as a tree of files, replaced once, and read again."""
    path = f"{shared.shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    found = shared.keep(tree.files_of(_mapped_scan(spark, sf_dir), _rows(spark, sf_dir, "c_mapped")))
    tree.save(found.withColumn("content", F.lit("an older one")), path)
    tree.save(found, path)
    text = F.decode("content", "utf-8")
    return tree.stored(spark, path).select("scope", "slot", "path", F.when(F.col("slot") == "html", F.length(text).cast("string")).otherwise(text).alias("content"))


@query(_REACH + " SELECT w.url, sha256(r.text) AS digest FROM w JOIN r ON r.url = w.url WHERE r.content_type <> 'text/html'")
def cached_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk whose responses lack half of the addresses, which are stored under their bodies' digests."""
    responses = shared.keep(_rows(spark, sf_dir, "c_responses"))
    half = F.crc32("url") % 2 == 0
    starts = spark.range(1).select(F.lit("site").alias("scan"), F.lit("https://site.test").alias("start"))
    cache = bodies.Bodies(spark, f"{shared.shared_folder(spark)}/bodies-{uuid.uuid4().hex}")
    good = discover.route(discover.answers(responses)).where("role <> 'dropped'").select(F.lit("site").alias("scan"), F.when(F.col("kind") == "html", "html").otherwise("js").alias("slot"), "url", "text")
    entry = F.col("url") == "https://site.test"
    cache.put(good.where(half | entry).where("slot = 'js' or url = 'https://site.test'"))
    cache.compact()
    stored = cache.answers()
    walk = discover.discover(starts, bodies.before(stored, starts, responses.where(~(half | entry) | (F.col("content_type") == "text/html") & ~entry)), _SCRIPTS)
    texts = stored.select("url", "text").unionByName(good.where(~half & (F.col("slot") == "js")).select("url", "text"))
    return walk.js_entries.select("url").join(texts, "url").select("url", F.sha2("text", 256).alias("digest"))


_DIGITS = "'abcdefghijklmnopqrstuvwxyz0123456789'"
# One character beyond ASCII, after one other: its place and code as digits of base 35, and a last one.
# Numbers beyond 32 bits and groups of more than four digits are no hosts: such an address is its own key.
_HOST_SQL = f"""WITH h AS (SELECT s_suppkey AS id, s_suppkey AS s, 3232235520 + s_suppkey AS n, CAST(s_suppkey AS VARCHAR) AS k, (252 - 128) * (6 + length(CAST(s_suppkey AS VARCHAR))) + 1 AS d FROM supplier)
SELECT id, CASE s % 6 WHEN 0 THEN 'https://xn--bcher' || k || '-' || substr({_DIGITS}, CAST(1 + (d - 1) % 35 + 1 AS INT), 1) || CASE WHEN (d - 1) // 35 < 1 THEN substr({_DIGITS}, CAST((d - 1) // 35 + 1 AS INT), 1) ELSE substr({_DIGITS}, CAST(1 + ((d - 1) // 35 - 1) % 35 + 1 AS INT), 1) || substr({_DIGITS}, CAST(((d - 1) // 35 - 1) // 35 + 1 AS INT), 1) END || '.de/x'
  WHEN 1 THEN CASE WHEN s < 16777216 THEN 'http://127.' || s // 65536 || '.' || s // 256 % 256 || '.' || s % 256 || '/a' ELSE 'http://0x7f.' || k || '/a' END
  WHEN 2 THEN CASE WHEN n < 4294967296 THEN 'http://' || n // 16777216 || '.' || n // 65536 % 256 || '.' || n // 256 % 256 || '.' || n % 256 || '/' ELSE 'http://' || n || ':80/' END
  WHEN 3 THEN CASE WHEN length(k) <= 4 THEN 'https://[2001:db8::' || k || ']/' ELSE 'https://[2001:DB8:0:0:0:0:0:' || k || ']:443/' END WHEN 4 THEN 'https://ex' || k || '.test/a/b' ELSE 'https://ex' || k || '.test/q?a%20b=%3C' || k || '%3E' END AS key FROM h"""


@query(_HOST_SQL)
def host_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of addresses whose hosts are spelled in other forms, with backslashes, and with queries to encode."""
    k, s = F.col("s_suppkey").cast("string"), F.col("s_suppkey")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    forms = [say("https://Bücher", k, ".DE/x"), say("http://0x7f.", k, "/a"), say("http://", (F.lit(3232235520) + s).cast("string"), ":80/"), say("https://[2001:DB8:0:0:0:0:0:", k, "]:443/"), say("https:\\\\EX", k, ".test\\a\\b"), say("https://ex", k, ".test/q?a b=<", k, ">")]
    address = F.coalesce(*(F.when(s % 6 == i, f) for i, f in enumerate(forms)))
    return _rows(spark, sf_dir, "supplier").select(s.alias("id"), url.normalize(address).alias("key"))


@query("SELECT 'https://c' || CAST(r_regionkey AS VARCHAR) || '.test/static/js/chunk-' || substr(md5(CAST(n_nationkey AS VARCHAR)), 1, 8) || '.' || substr(md5('h' || CAST(n_nationkey AS VARCHAR)), 1, 8) || '.js' AS url FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0")
def chunk_maps_across_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that one script loads by their ids and whose hashes another one tells, a site for each region."""
    n = _rows(spark, sf_dir, "nation").select(F.concat(F.lit("https://c"), F.col("n_regionkey").cast("string"), F.lit(".test")).alias("site"), F.concat(F.lit("chunk-"), F.substring(F.md5(F.col("n_nationkey").cast("string")), 1, 8)).alias("id"), F.substring(F.md5(F.concat(F.lit("h"), F.col("n_nationkey").cast("string"))), 1, 8).alias("hash"), (F.col("n_nationkey") % 2 == 0).alias("told"))
    row = lambda rows, path, kind, text: rows.select(F.concat("site", path).alias("url"), F.lit(200).alias("status"), F.lit(kind).alias("content_type"), text.alias("text"))
    sites = n.groupBy("site").agg(F.array_sort(F.collect_list(F.when(F.col("told"), F.concat(F.lit('"'), "id", F.lit('":"'), "hash", F.lit('"'))))).alias("map"), F.array_sort(F.collect_list(F.concat(F.lit('r.e("'), "id", F.lit('")')))).alias("calls"))
    page = row(sites, F.lit(""), "text/html", F.lit('<script src="/map.js"></script><script src="/use.js"></script>'))
    # The map is told where no name is made of it, and what is called has no hash in its own document.
    told = row(sites, F.lit("/map.js"), "text/javascript", F.concat(F.lit("webpackJsonp;var m={"), F.array_join("map", ","), F.lit("}")))
    calls = row(sites, F.lit("/use.js"), "text/javascript", F.concat(F.lit('webpackJsonp;p=x+"static/js/";'), F.array_join("calls", ";")))
    chunks = row(n, F.concat(F.lit("/static/js/"), F.col("id"), F.lit("."), F.col("hash"), F.lit(".js")), "text/javascript", F.lit("c"))
    found = discover.discover(sites.select(F.col("site").alias("scan"), F.col("site").alias("start")), page.unionByName(told).unionByName(calls).unionByName(chunks), Registry().only("HTMLScriptPlugin", "WebpackPlugin"))
    return found.js_entries.where("url like '%/static/js/%'").select("url")


# Of each host and shop of a user's: every fourth event sets a cookie, all others ask.
_EVENTS = """WITH e AS (SELECT event_id AS id, event_id * 60000 AS t, 'u' || CAST(user_id % 20 AS VARCHAR) || '.s' || CAST(user_id % 3 AS VARCHAR) || '.test' AS host, 's' || CAST(user_id % 3 AS VARCHAR) || '.test' AS shop FROM events),
s AS (SELECT id, t, host, CASE WHEN id % 8 = 0 THEN shop ELSE host END AS domain, CASE WHEN id % 12 = 0 THEN '/a' ELSE '/' END AS path, 'c' || CAST(id % 5 AS VARCHAR) AS name, CAST(id AS VARCHAR) AS value, CASE WHEN id % 20 = 0 THEN t + 36000000 END AS expires FROM e WHERE id % 4 = 0),
r AS (SELECT id, t, host, CASE WHEN id % 2 = 1 THEN '/a/b' ELSE '/ab' END AS path FROM e WHERE id % 4 <> 0),
m AS (SELECT r.id, r.t, s.* EXCLUDE (id, t), s.t AS set_t FROM r JOIN s ON s.t < r.t AND (r.host = s.domain OR ends_with(r.host, '.' || s.domain)) AND (s.path = '/' OR r.path = s.path OR starts_with(r.path, s.path || '/')) QUALIFY row_number() OVER (PARTITION BY r.id, s.domain, s.path, s.name, s.host ORDER BY s.t DESC) = 1)"""


@query(_EVENTS + " SELECT r.id, coalesce(string_agg(m.name || '=' || m.value, '; ' ORDER BY length(m.path) DESC, m.set_t), '') AS cookie FROM r LEFT JOIN m ON m.id = r.id AND (m.expires IS NULL OR m.expires > m.t) GROUP BY r.id")
def cookie_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cookies that every request carries, by what was set last before it."""
    k, text = F.col("event_id"), lambda c: c.cast("string")
    shop = F.concat(F.lit("s"), text(F.col("user_id") % 3), F.lit(".test"))
    e = _rows(spark, sf_dir, "events").select(k.alias("id"), (k * 60000).alias("at"), F.concat(F.lit("https://u"), text(F.col("user_id") % 20), F.lit("."), shop).alias("site"), shop.alias("shop"))
    i = F.col("id")
    header = F.concat(F.lit("c"), text(i % 5), F.lit("="), text(i), F.when(i % 8 == 0, F.concat(F.lit("; Domain=."), "shop")).otherwise(""), F.when(i % 12 == 0, "; path=/a").otherwise("; Secure"), F.when(i % 20 == 0, "; Max-Age=36000; Expires=Thu, 01 Jan 1970 00:00:00 GMT").otherwise(""))
    sets = e.where("id % 4 = 0").select(F.concat("site", F.lit("/x")).alias("url"), "at", F.array(header).alias("set_cookie"))
    asks = e.where("id % 4 <> 0").select("id", F.concat("site", F.when(i % 2 == 1, "/a/b?q").otherwise("/ab")).alias("url"), "at")
    return cookies.headers(asks, sets)
