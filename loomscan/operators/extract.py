"""Extractors: what documents refer to, as rows with provenance.

Readers give a document's tags, strings and runtime once; each extractor is a predicate
on them, for the kinds of document it applies to, that gives an array of (type, value).
All selected extractors are evaluated in one projection, their values resolved, made
distinct and exploded once, so documents are read once, without shuffle, however many
extractors run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.functions import content, let, scanners, scripts, url
from loomscan.functions.readers import attribute, follows, named, quoted, sections, strings, tags, values

FINDING = "array<struct<type:string,value:string>>"
CAP = 50
# Endings of links that lead to no page.
NO_PAGE = [".js", ".css", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".json", ".xml", ".map", ".pdf"]
# Endings that, standing before .js, tell that an address is no script.
NO_SCRIPT = [".css", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".json", ".xml", ".txt", ".pdf", ".zip", ".rar", ".7z", ".html", ".htm", ".map", ".woff", ".ttf", ".otf", ".eot"]
# Endings of addresses that no application route has.
NO_ROUTE = [".js", ".css", ".png", ".jpg", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot"]
# Texts that a bundler's runtime has.
RUNTIME_MARKERS = ["__webpack_require__", "webpackJsonp", "chunk-", "webpackChunk", "__webpack_public_path__", "resourceBaseUrl", "rspackChunk", "__rspack_"]


@dataclass(frozen=True)
class Doc:
    """A document's columns; text is as captured, decoded without escapes; base is the parsed url.

    tags and strings are what the readers find in text, decoded_tags and
    decoded_strings in decoded; runtime is what a bundler's runtime says, constants what
    imported variables hold; routes is the text of a route manifest.
    """

    url: Column
    kind: Column
    text: Column
    decoded: Column
    headers: Column
    base: Column
    origin: Column
    directory: Column
    tags: Column
    strings: Column
    decoded_tags: Column
    decoded_strings: Column
    runtime: Column
    constants: Column
    routes: Column


Extractor = Callable[[Doc], Column]


def no_texts() -> Column:
    return F.array().cast("array<string>")


def tagged(type_: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(type_).alias("type"), v.alias("value")))


def one(value: Column) -> Column:
    """An array of value, or of nothing if it is null or empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.array(value)).otherwise(F.array().cast("array<string>"))


def gated(*cases: tuple[Column, Column]) -> Column:
    out = F.lit(None).cast(FINDING)
    for condition, found in reversed(cases):
        out = F.when(condition, found).otherwise(out)
    return F.coalesce(out, F.array().cast(FINDING))


def has(text: Column, *words: str) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def internal(path: Column) -> Column:
    """Whether a path is a bundler's name for a module."""
    return path.contains("node_modules/") | path.startswith("webpack://") | path.startswith("webpack-internal://")


def looks_like_script(address: Column) -> Column:
    early = "|".join(e.replace(".", r"\.") for e in NO_SCRIPT)  # one that begins before .js ends before it, too
    return let(F.lower(address), lambda low: low.contains(".js") & ~F.substring_index(low, ".js", 1).rlike(early) & ~low.endswith(".map") & ~low.rlike(r"\A(data|blob|about):"))


def looks_like_entry(value: Column) -> Column:
    """Whether a value looks like a page rather than a resource: it ends like one, or has no dot."""
    low = F.lower(value)
    return (value != "") & (low.endswith(".html") | low.endswith(".htm") | ~F.regexp_replace(low, r"/+\z", "").contains("."))


def entry_candidates(value: Column) -> Column:
    """The pages that a micro-application's entry may mean; none where it is empty or has a placeholder."""

    def pages(v: Column) -> Column:
        bare = F.regexp_replace(v, r"/+\z", "")
        whole = v.endswith(".html") | v.endswith(".htm")
        return F.when((v == "") | v.contains("${"), no_texts()).when(whole, F.array(v)).otherwise(F.array(bare, F.concat(bare, F.lit("/index.html")), F.concat(bare, F.lit(".html"))))

    return let(F.trim(value), pages)


def trimmed_end(x: Column) -> Column:
    return F.regexp_replace(x, r"[),;\"'> ]+\z", "")


def with_js(x: Column) -> Column:
    return F.when(x.endswith(".js"), x).otherwise(F.concat(x, F.lit(".js")))


def html_scripts(d: Doc) -> Column:
    js = lambda v: F.lower(v).endswith(".js")
    of = lambda name, attr, test: F.filter(F.transform(F.filter(d.tags, lambda t: named(t, name) & test(t)), lambda t: attribute(t, attr)), lambda v: v != "")
    linked = lambda rel: F.filter(of("link", "href", lambda t: F.lower(attribute(t, "rel")) == rel), js)
    found = F.concat(of("script", "src", lambda t: F.lit(True)), linked("modulepreload"), linked("prefetch"))
    return gated((d.kind == "html", tagged("url", found)))


def dynamic_imports(d: Doc) -> Column:
    found = values(d.strings, lambda s: s["after"].rlike(r"\A.\s*\)") & ~s["value"].contains("${") & follows(s, r"import\s*\("))
    return gated(((d.kind == "js") & d.text.contains("import"), tagged("url", found)))


def bundler_runtime(d: Doc) -> Column:
    return gated((d.kind == "js", F.concat(tagged("public", one(d.runtime["public"])), tagged("probe", F.coalesce(d.runtime["probes"], no_texts())), tagged("mark", one(d.runtime["mark"])), tagged("chunk", F.coalesce(d.runtime["hashes"], no_texts())), tagged("load", F.coalesce(d.runtime["wanting"], no_texts())))))


def runtime_like(text: Column) -> Column:
    """Whether a script may be a bundler's runtime: by its markers, or since it adds .js to a look-up."""
    return has(text, *RUNTIME_MARKERS) | text.rlike(r"\}\)?\[\w+\]\s*\+\s*[\"']\.js")


def _routes(text: Column) -> Column:
    """Paths of a flight payload's route lists."""
    part = lambda s: F.filter(F.transform(F.split(s, ","), lambda p: F.regexp_replace(p, r"\A[\s\"]+|[\s\"]+\z", "")), lambda p: ~p.isin("", "$undefined", "__PAGE__") & ~p.startswith("$"))
    return F.filter(F.transform(sections(text, r'"c":\[', "]"), lambda s: F.array_join(part(s), "/")), lambda p: p != "")


def _base_path(d: Doc, routes: Column) -> Column:
    """What precedes the first route in the document's own path."""
    path, route = d.base["path"], F.concat(F.lit("/"), F.try_element_at(routes, F.lit(1)))
    at, last = F.position(route, path), F.position(F.concat(F.lit("/"), F.substring_index(route, "/", -1)), path)
    every = F.forall(F.split(F.try_element_at(routes, F.lit(1)), "/"), lambda s: F.contains(path, F.concat(F.lit("/"), s)))
    return F.coalesce(F.when(at > 0, F.substr(path, F.lit(1), at - 1)).when((last > 1) & every, F.substr(path, F.lit(1), last - 1)), F.lit(""))


def json_text(text: Column, key: str) -> Column:
    """The first string that a JSON text gives a key."""
    return F.regexp_extract(text, rf'"{key}"\s*:\s*"([^"]+)"', 1)


def lists_by_key(text: Column) -> Column:
    """(key, list) for every quoted key of a text with a list: the list's text."""
    pair = lambda s: F.transform(s, lambda x, i: F.struct(F.substring_index(F.get(s, i - 1), '"', -1).alias("key"), F.substring_index(x, "]", 1).alias("list")))
    return F.filter(let(F.split(text, r'"\s*:\s*\[', -1), pair), lambda x: x["key"].isNotNull())


def _bare(value: Column) -> Column:
    """A value without the backslash that escaped its closing mark."""
    return F.rtrim(value, F.lit("\\"))


def _imports(flight: Column) -> Column:
    """The lists of a flight payload's import rows: I[number,[list]..."""
    rows = F.filter(F.slice(F.split(flight, r"I\[", -1), 2, 1 << 30), lambda p: p.contains("]") & F.substring_index(p, ",[", 1).rlike(r"\A\d+\z"))
    return F.transform(rows, lambda p: F.substring_index(F.split_part(p, F.lit(",["), F.lit(2)), "]", 1))


def _under(path: Column, *folders: str) -> Column:
    """Whether a path goes on with one of the folders after static/, or after static/immutable/."""
    out = F.lit(False)
    for f in folders:
        out = out | path.startswith(f"static/{f}") | path.startswith(f"static/immutable/{f}")
    return out


def _asset(value: Column) -> Column:
    """The path of a script or style sheet from its build folder on, with the folder's parent if that is told; else null."""
    at = F.locate("static/", value)
    lead, rest = F.left(value, at - 1), F.substr(value, F.greatest(at, F.lit(1)))
    parent = F.when(lead.endswith("/_next/"), "/_next/").when(lead.endswith("_next/"), "_next/").when(lead.endswith("/"), "/").otherwise("")
    return F.when((at > 0) & _under(rest, "chunks/", "css/") & (rest.endswith(".js") | rest.endswith(".css")), F.concat(parent, rest))


def next_js(d: Doc) -> Column:
    origin, t = d.origin, d.text
    chunks = F.filter(F.transform(F.flatten(F.transform(_imports(t), lambda c: quoted(F.replace(c, F.lit('\\"'), F.lit('"'))))), _asset), lambda v: v.isNotNull())
    requests = tagged("request", let(_routes(t), lambda rs: let(_base_path(d, rs), lambda b: F.transform(rs, lambda r: F.concat(origin, b, F.lit("/"), r)))))

    given, flight = json_text(d.decoded, "buildId"), json_text(d.decoded, "b")
    build = F.when(given != "", given).otherwise(flight)
    files = F.array(*(F.lit(n) for n in ("_buildManifest.js", "_ssgManifest.js", "_appManifest.js")))
    manifests = let(build, lambda b: F.when(b != "", F.transform(files, lambda n: F.concat(F.lit("/_next/static/"), b, F.lit("/"), n))).otherwise(no_texts()))
    words = F.flatten(F.transform(values(d.strings, lambda s: s["value"].contains("/_next")), lambda v: F.split(v, " ", -1)))
    addresses = F.filter(F.transform(F.filter(words, lambda w: w.contains("/_next")), lambda w: F.substr(w, F.greatest(F.locate("http", w), F.lit(1)))), url.is_http)
    # Up to the last /_next of an address.
    prefixes = F.filter(F.transform(addresses, lambda w: F.left(w, F.length(w) - F.length(F.substring_index(w, "/_next", -1)) - F.lit(len("/_next")))), lambda p: ~p.contains("{{") & (F.substring_index(p, "://", -1) != ""))
    links = F.filter(F.transform(F.filter(d.tags, lambda g: named(g, "a", exact=True)), lambda g: attribute(g, "href", quoted=True)), lambda h: (h != "") & ~h.rlike(r"\A(#|javascript:|mailto:|tel:)"))
    clean = F.transform(links, lambda h: F.regexp_replace(url.resolve_at(d.base, h), r"(?s)[?#].*\z", ""))
    clean = F.filter(clean, lambda u: (F.regexp_extract(u, r"\A([^:]+://[^/?#]*)", 1) == origin) & ~ends_in(F.lower(u), NO_ROUTE) & ~u.contains("/_next/static"))
    html = let(manifests, lambda m: F.concat(tagged("public", one(build)), tagged("prepend", prefixes), tagged("probe", m), tagged("absolute", F.transform(m, lambda x: F.concat(origin, x))), tagged("url", chunks), tagged("request", F.array(d.url)), requests, tagged("request", clean)))

    hinted = F.filter(F.transform(sections(t, r":HL\[", "]"), quoted), lambda q: (F.get(q, F.lit(1)) == "script") & F.get(q, F.lit(0)).endswith(".js"))
    flown = F.concat(tagged("url", chunks), tagged("url", F.transform(hinted, lambda q: F.get(q, F.lit(0)))), tagged("public", one(json_text(t, "b"))), requests)

    named_sum = t.contains("s.u=") & t.rlike(r'\{\s*"[0-9]+"\s*:')
    built = F.when(named_sum, d.runtime["probes"])
    single = F.array_distinct(F.filter(sections(t, r"\{", "}"), lambda m: m.rlike(r'\A\s*\d+\s*:\s*"[a-f0-9]+"\s*\z')))
    pair = lambda m: F.struct(F.trim(F.substring_index(m, ":", 1)).alias("k"), F.split_part(m, F.lit('"'), F.lit(2)).alias("v"))
    layouts = F.array(*(F.lit(p) for p in ("static/chunks/", "static/", "chunks/", "")))
    guesses = F.flatten(F.transform(F.transform(single, pair), lambda e: F.transform(layouts, lambda p: F.concat(p, e["k"], F.lit("."), e["v"], F.when(p == "", F.lit(".function.chunk.js")).otherwise(F.lit(".js"))))))
    listed_in = F.flatten(F.transform(values(d.strings, lambda s: s["value"].contains("static/")), lambda v: F.split(_bare(v), ",", -1)))
    own = F.transform(F.filter(listed_in, lambda v: v.endswith(".js") & ~F.regexp_like(F.substring_index(v, "static/", 1), F.lit(r"\w\z"))), lambda v: F.substr(v, F.greatest(F.locate("static/", v), F.lit(1))))
    within = F.filter(own, lambda v: _under(v, "chunks/") & ~v.rlike(r"[\s<>()\]]"))
    ids = F.transform(values(d.strings, lambda s: follows(s, r"__webpack_require__\.e\s*\(")), lambda c: F.concat(F.lit("__webpack_require_e__"), c))
    pages = F.when(t.contains("__BUILD_MANIFEST"), F.filter(lists_by_key(t), lambda p: p["key"].rlike("\\A/.")))
    page_keys = F.coalesce(F.transform(pages, lambda p: p["key"]), no_texts())
    listed = F.coalesce(F.filter(F.flatten(F.transform(pages, lambda p: quoted(p["list"]))), lambda c: c.endswith(".js")), no_texts())
    rooted = lambda c: F.regexp_replace(c, r"\A/+", "")
    others = F.filter(F.transform(F.flatten(F.transform(sections(t, r"otherChunks\s*:\s*\[", "]"), quoted)), rooted), lambda c: c.startswith("static/") & c.endswith(".js"))
    sorted_pages = F.when(t.contains("otherChunks"), F.transform(quoted(F.get(sections(t, r"sortedPages\s*:\s*\[", "]"), F.lit(0))), lambda p: F.concat(origin, p)))
    sorted_pages = F.coalesce(sorted_pages, no_texts())
    js = F.concat(
        tagged("url", F.concat(F.coalesce(built, no_texts()), guesses, within)), tagged("probe", ids), tagged("request", F.transform(page_keys, lambda k: F.concat(origin, k))),
        tagged("probe", F.transform(listed, lambda c: F.concat(origin, F.lit("/_next/"), rooted(c)))), tagged("url", listed),
        tagged("probe", F.transform(others, lambda c: F.concat(origin, F.lit("/_next/"), c))), tagged("request", sorted_pages), tagged("html", sorted_pages),
    )
    return gated(
        (d.kind == "flight", flown),
        ((d.kind == "html") & has(t, "__NEXT_DATA__", "/_next/"), html),
        ((d.kind == "js") & has(t, "__NEXT_DATA__", "_next/static", "next/dist", "s.u=", "turbopack", "__BUILD_MANIFEST", "__SSG_MANIFEST"), js),
    )


def ends_in(x: Column, endings: list[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | x.endswith(e)
    return out


def nuxt(d: Doc) -> Column:
    held = F.transform(values(d.strings, lambda s: s["value"].contains("/_nuxt/")), lambda v: F.substring_index(_bare(v), "?", 1))
    attributes = F.flatten(F.transform(d.tags, lambda g: F.array(attribute(g, "src"), attribute(g, "href"))))
    built = lambda vs: tagged("url", F.transform(F.filter(vs, lambda v: v.endswith(".js") & v.contains("/_nuxt/") & ~v.rlike(r"[\s<>()\],]")), lambda v: F.when(url.is_http(v), v).otherwise(F.substr(v, F.locate("/_nuxt/", v)))))
    return gated(((d.kind == "html") & has(d.text, "__NUXT__", "__NUXT_DATA__", "/_nuxt/"), built(F.concat(held, attributes))), ((d.kind == "js") & has(d.text, "buildAssetsDir", '"buildId"', "process.env.NUXT"), built(held)))


def vite(d: Doc) -> Column:
    t, root = d.text, d.origin
    files = F.transform(F.map_values(F.from_json(t, "map<string,struct<file:string>>")), lambda e: e["file"])
    manifest = F.transform(F.filter(files, lambda f: f.endswith(".js")), lambda f: F.concat(root, F.lit("/"), F.regexp_replace(f, r"\A/+", "")))
    of = lambda name, attr, test: F.filter(F.transform(F.filter(d.tags, lambda g: named(g, name, exact=True) & test(g)), lambda g: attribute(g, attr, quoted=True)), lambda v: v != "")
    preloads = of("link", "href", lambda g: attribute(g, "rel", quoted=True) == "modulepreload")
    modules = of("script", "src", lambda g: attribute(g, "type", quoted=True) == "module")
    place = F.when((F.size(preloads) + F.size(modules) > 0) & (root != ""), F.array(F.concat(root, F.lit("/.vite/manifest.json")))).otherwise(no_texts())
    html = F.concat(tagged("url", F.filter(preloads, lambda h: h.endswith(".js") | h.endswith(".css"))), tagged("url", modules), tagged("json", place))
    return gated(
        ((d.kind == "json") & t.contains('"isEntry"') & t.contains('"file"'), tagged("absolute", manifest)),
        ((d.kind == "html") & has(t, "@vite/client", 'type="module"', "modulepreload"), html),
        ((d.kind == "js") & has(t, "__vite", "import.meta.env"), tagged("url", values(d.strings, lambda s: follows(s, r"__vitePreload\s*\(\s*\(\)\s*=>\s*import\s*\(")))),
    )


def svelte(d: Doc) -> Column:
    below = lambda part: F.transform(values(d.strings, lambda s: s["value"].rlike(rf"\A\.{{1,2}}/{part}/[\w-]+\.js\z")), lambda v: F.concat(F.lit("/_app/immutable/"), F.substring_index(v, "/", -2)))
    found = tagged("url", F.concat(below("nodes"), below("chunks")))
    return gated(((d.kind == "html") & has(d.text, "_app/immutable", "__svelte", "sveltekit"), found), ((d.kind == "js") & has(d.text, "_app/immutable", "__sveltekit", ".svelte"), found))


def require_js(d: Doc) -> Column:
    t = d.text
    sources = F.filter(F.transform(F.filter(d.tags, lambda g: named(g, "script", exact=True)), lambda g: attribute(g, "src", quoted=True)), lambda v: has(v, "require.js", "require.min.js"))
    mains = F.filter(F.transform(F.filter(d.tags, lambda g: g.contains("data-main=")), lambda g: attribute(g, "data-main", quoted=True)), lambda v: v != "")
    html = F.concat(sources, F.transform(mains, with_js))
    listed = lambda call: F.flatten(F.transform(sections(t, rf"{call}\s*\(\s*\[", "]"), quoted))
    js = F.transform(F.concat(listed("require"), listed("define")), lambda v: F.when(url.is_http(v), v).otherwise(with_js(v)))
    return gated(((d.kind == "html") & has(t, "require.min.js", "require.js", "data-main=", "require.config"), tagged("url", html)), ((d.kind == "js") & has(t, "require([", "define([", "require.config"), tagged("url", js)))


def federation(d: Doc) -> Column:
    t = d.text
    entries = values(d.strings, lambda s: s["value"].endswith("remoteEntry.js"))
    manifests = values(d.strings, lambda s: s["value"].endswith(".json") & s["value"].contains("manifest"))
    folder = lambda e: F.regexp_replace(url.resolve_at(d.base, e), r"[^/]*\z", "")
    beside = F.flatten(F.transform(entries, lambda e: let(folder(e), lambda f: F.array(e, F.concat(f, F.lit("mf-manifest.json")), F.concat(f, F.lit("federation-manifest.json"))))))
    own = F.transform(F.filter(entries, lambda e: F.substring_index(e, "/", -1) == "remoteEntry.js"), folder)
    dirs = F.flatten(F.transform(own, lambda f: F.array(f, F.when(f.endswith("/assets/"), F.regexp_replace(f, r"assets/\z", "")))))
    # A page is looked for beside an entry in a folder, not at a site's root.
    pages = F.transform(F.filter(dirs, lambda f: f.isNotNull() & url.is_http(f) & (F.size(F.split(f, "/")) > 4)), lambda f: F.concat(f, F.lit("index.html")))
    found = F.concat(tagged("url", F.filter(F.concat(manifests, beside), lambda v: ~has(v, "{{", "}}"))), tagged("html", pages))
    return gated(((d.kind == "js") & has(t, "remoteEntry.js", "__webpack_share_scopes__", "__webpack_init_sharing__"), found))


_ASSETS = "array<struct<assets:struct<js:struct<sync:array<string>,async:array<string>>>>>"


def _chunks(list_: Column) -> Column:
    return F.coalesce(F.flatten(F.transform(list_, lambda e: F.concat(F.coalesce(e["assets"]["js"]["sync"], no_texts()), F.coalesce(e["assets"]["js"]["async"], no_texts())))), no_texts())


def federation_manifest(d: Doc) -> Column:
    t = d.text
    m = F.from_json(t, f"metaData struct<publicPath:string,region:map<string,string>>, exposes {_ASSETS}, shared {_ASSETS}")
    path = F.coalesce(F.nullif(m["metaData"]["publicPath"], F.lit("")), F.lit("/"))
    modern = tagged("url", let(F.regexp_replace(path, r"([^/])\z", "$1/"), lambda p: F.transform(F.filter(_chunks(m["exposes"]), lambda c: c != ""), lambda c: F.concat(p, c))))
    cn = F.coalesce(F.nullif(m["metaData"]["region"]["cn"], F.lit("")), F.lit(""))
    base = F.when(cn != "", F.concat(F.lit("https://"), F.regexp_replace(cn, r"/+\z", ""))).otherwise(F.lit(""))
    mid = F.regexp_replace(F.replace(F.coalesce(m["metaData"]["publicPath"], F.lit("")), F.lit("//__CDN_PREFIX__/"), F.lit("")), r"\A/+|/+\z", "")
    older = tagged("absolute", let(F.concat(base, F.lit("/"), mid, F.lit("/")), lambda p: F.transform(F.array_distinct(F.concat(_chunks(m["shared"]), _chunks(m["exposes"]))), lambda c: F.concat(p, c))))
    place = F.get(values(d.strings, lambda s: s["value"].endswith("manifest.json") & follows(s, r"baseHost\s*\+")), F.lit(0))
    # baseHost is set to one address, or to the second of two that a condition chooses from.
    said = F.substring_index(F.get(F.split(t, r"baseHost\s*=(?!=)", -1), F.lit(1)), ";", 1)
    held = F.regexp_extract_all(said, F.lit("[\"']([^\"']+)[\"']"), F.lit(1))
    host = F.coalesce(F.when(said.contains("?"), F.get(held, F.lit(1))), F.get(F.filter(F.slice(held, 1, 1), url.is_http), F.lit(0)), F.regexp_extract(d.url, r"\A([^:]+://[^/]*)/", 1))
    return gated(
        ((d.kind == "json") & t.contains('"metaData"') & has(t, '"publicPath"', '"region"'), F.when(F.coalesce(F.size(m["exposes"]) > 0, F.lit(False)), modern).otherwise(older)),
        ((d.kind == "js") & t.contains("baseHost"), tagged("json", F.transform(one(place), lambda p: F.concat(host, F.lit("/"), F.regexp_replace(p, r"\A/+", ""))))),
    )


def is_component_metadata(text: Column) -> Column:
    """Whether a JSON text is an object some of whose objects carry url or offlineChunks."""
    members = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    carries = lambda v: (F.schema_of_variant(v).startswith("OBJECT")) & (F.try_variant_get(v, "$.url", "variant").isNotNull() | F.try_variant_get(v, "$.offlineChunks", "variant").isNotNull())
    return F.coalesce(F.exists(F.map_values(members), carries), F.lit(False))


def component_metadata(d: Doc) -> Column:
    t = d.text

    def clean(v: Column) -> Column:
        for a, b in (("{{specifiedVersionKey}}", ".v1"), ("{{", ""), ("}}", "")):
            v = F.replace(v, F.lit(a), F.lit(b))
        return v

    paths = F.transform(values(d.strings, lambda s: s["value"].endswith(".json") & s["value"].contains("metadata") & ~has(s["value"], "window", "location")), clean)
    joined = F.transform(values(d.strings, lambda s: s["value"].contains("/components/docs/metadata") & s["value"].contains(".json")), clean)
    components = values(d.strings, lambda s: s["value"].endswith(".js") & s["value"].contains("/components/"))
    set_to, or_else = values(d.strings, lambda s: follows(s, r"COMPONENT_CDN_PREFIX\s*=")), values(d.strings, lambda s: s["value"].rlike(r"\A//\S+\z") & follows(s, r"\|\|"))
    prefixes = F.concat(set_to, F.transform(or_else, lambda p: F.concat(F.lit("https:"), p)))
    usual = F.when(has(t, "hel-micro", "helMicro", "components/docs/metadata"), F.array(F.lit("/components/docs/metadata.v1.json"))).otherwise(no_texts())
    js = F.concat(tagged("url", paths), tagged("probe", joined), tagged("url", components), tagged("prepend", prefixes), tagged("probe", usual))
    members = F.try_variant_get(F.try_parse_json(t), "$", "map<string,variant>")
    parts = F.map_values(F.map_filter(members, lambda k, v: ~(k.startswith("test") | k.startswith("mock"))))
    held = F.flatten(F.transform(parts, lambda c: F.concat(one(F.try_variant_get(c, "$.url", "string")), F.coalesce(F.try_variant_get(c, "$.offlineChunks", "array<string>"), no_texts()))))
    return gated(
        ((d.kind == "js") & has(t, "hel-micro", "helMicro", "hel_meta", "components/docs/metadata", "COMPONENT_CDN_PREFIX", "componentCdnPrefix"), js),
        ((d.kind == "json") & has(t, '"url"', '"offlineChunks"') & is_component_metadata(t), tagged("probe", F.filter(held, lambda v: v.isNotNull()))),
    )


def static_imports(d: Doc) -> Column:
    js = F.filter(d.strings, lambda s: s["value"].endswith(".js") & s["mark"].isin('"', "'") & ~s["value"].rlike(r"\A(data|blob):|\)"))
    clause = lambda js: values(js, lambda s: s["before"].rlike(r"\bimport\b[^;()]*\bfrom\s*\z|\bimport\s*\{[^}]*\}\s*from\s*\z"))
    alone = lambda js: values(js, lambda s: follows(s, "import"))
    return gated(((d.kind == "js") & d.text.contains("import"), tagged("url", let(js, lambda js: F.concat(clause(js), alone(js))))))


def script_create(d: Doc) -> Column:
    js = F.filter(d.strings, lambda s: s["value"].endswith(".js") | s["value"].contains(".js?"))

    def found(js: Column) -> Column:
        after = lambda pattern: values(js, lambda s: s["value"].endswith(".js") & follows(s, pattern))
        short = values(js, lambda s: follows(s, r"\bo\s*\("))
        return F.concat(after(r"script\.setAttribute\s*\(\s*[\"']src[\"']\s*,"), after(r"script\.src\s*="), after(r"\bnew\s+URL\s*\("), short)

    return gated(((d.kind == "js") & has(d.text, "createElement", ".src", "setAttribute"), tagged("url", let(js, found))))


def modern_js(d: Doc) -> Column:
    body = d.routes
    given = F.coalesce(F.get(values(d.strings, lambda s: follows(s, r"(b\.p|__webpack_public_path__)\s*=")), F.lit(0)), F.lit(""))
    base = F.when(given != "", F.concat(F.regexp_replace(F.when(given.startswith("//"), F.concat(F.lit("https:"), given)).otherwise(given), r"/+\z", ""), F.lit("/"))).otherwise(F.lit(""))
    paths = values(strings(body), lambda s: s["value"].endswith(".js") & s["value"].rlike(r"\A/?static/."))
    found = F.concat(tagged("prepend", one(base)), F.when(base != "", tagged("absolute", let(base, lambda b: F.transform(paths, lambda p: F.concat(b, F.regexp_replace(p, r"\A/+", "")))))).otherwise(tagged("url", paths)))
    return gated(((d.kind == "html") & (F.coalesce(body, F.lit("")) != ""), found))


def quoted_js(d: Doc) -> Column:
    """Every quoted script, and as prefixes the hosts of two labels that are quoted with a path of plain segments."""
    segments = lambda v: F.slice(F.split(F.regexp_replace(v, r"/\z", ""), "/", -1), 3, 1 << 30)
    host = lambda v: v.startswith("//") & F.coalesce(F.get(segments(v), F.lit(0)).rlike(r"\A[A-Za-z0-9][A-Za-z0-9-]*\.[A-Za-z0-9]+\z"), F.lit(False))
    prefixes = values(d.strings, lambda s: host(s["value"]) & F.forall(F.slice(segments(s["value"]), 2, 1 << 30), lambda p: p.rlike(r"\A[\w-]+\z")))
    found = values(d.strings, lambda s: s["value"].endswith(".js") & (F.length(s["value"]) > 3) & ~internal(s["value"]))
    return gated((d.kind == "js", F.concat(tagged("prepend", F.transform(prefixes, lambda p: F.concat(F.lit("https:"), F.regexp_replace(p, r"/\z", "")))), tagged("probe", found))))


def map_reference(base: Column, ref: Column) -> Column:
    """The absolute address of a source map reference."""
    return (
        F.when(ref.startswith("data:") | url.is_http(ref), ref)
        .when(ref.startswith("//"), F.when(url.cut_up(base)["ok"], F.concat(url.scheme(base), F.lit(":"), ref)).otherwise(F.concat(F.lit("https:"), ref)))
        .when(ref.startswith("/"), F.concat(url.origin_of(url.cut_up(base)), ref))
        .otherwise(url.normalize_at(url.cut_up(base), ref))
    )


def source_map_refs(d: Doc) -> Column:
    """The maps that headers name, and the one that a comment names: with #, else with @, else the last that is held inline."""
    given = F.filter(F.array(d.headers["x-sourcemap"], d.headers["sourcemap"]), lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
    lines = F.filter(F.split(d.text, r"[\r\n]", -1), lambda line: line.startswith("//") & line.contains("sourceMappingURL"))
    told = F.transform(lines, lambda line: F.struct(F.substr(line, F.lit(3), F.lit(1)).alias("sign"), content.trim_all(F.substr(F.substring_index(line, "=", 1), F.lit(4))).alias("key"), content.trim_all(F.substr(line, F.length(F.substring_index(line, "=", 1)) + 2)).alias("value")))
    by = lambda sign: F.coalesce(F.get(F.filter(told, lambda x: (x["sign"] == sign) & (x["key"] == "sourceMappingURL") & (x["value"] != "")), F.lit(0))["value"], F.lit(""))
    data = "data:application/json"
    inline = F.filter(F.transform(F.slice(F.split(d.text, data, -1), 2, 1 << 30), lambda p: F.regexp_extract(p, r"\A[^\"'\s]+", 0)), lambda p: p != "")
    ref = let(F.struct(by("#").alias("new"), by("@").alias("old")), lambda r: F.when(r["new"] != "", map_reference(d.url, r["new"])).when(r["old"] != "", map_reference(d.url, r["old"])).otherwise(F.concat(F.lit(data), F.try_element_at(inline, F.lit(-1)))))
    return gated((d.kind == "js", tagged("map", F.concat(F.coalesce(F.transform(given, lambda v: map_reference(d.url, F.trim(v))), no_texts()), one(ref)))))


def sitemap(d: Doc) -> Column:
    first = lambda test: F.get(values(d.decoded_strings, test), F.lit(0))
    place = F.coalesce(first(lambda s: s["value"].endswith("sitemap.json")), first(lambda s: s["value"].endswith(".json") & follows(s, r"\bfetch\s*\(")))
    m = F.from_json(d.text, "routes array<struct<file:string>>, chunks map<string,string>, workers array<string>")
    listed = F.concat(F.coalesce(F.transform(m["routes"], lambda r: r["file"]), no_texts()), F.coalesce(F.transform(F.map_entries(m["chunks"]), lambda e: F.concat(F.lit("js/"), e["key"], F.lit("."), e["value"], F.lit(".js"))), no_texts()), F.coalesce(m["workers"], no_texts()))
    return gated(
        (d.kind.isin("js", "html") & has(d.text, "sitemap.json", "trunk_app"), tagged("json", F.transform(one(place), lambda p: url.resolve_at(d.base, p)))),
        ((d.kind == "json") & has(d.text, '"routes"', '"workers"'), tagged("url", F.filter(listed, lambda v: F.coalesce(v, F.lit("")) != ""))),
    )


def entry_shaped(v: Column) -> Column:
    low = F.lower(v)
    return (url.is_http(v) | (v.startswith("/") & ~v.startswith("//"))) & ~v.contains("${") & (low.endswith(".html") | low.endswith(".htm") | low.endswith("/"))


def micro_entries(markers: list[str], names: list[str], words: list[str], lists_first: bool = False) -> Extractor:
    """Entries of micro-applications: strings of the named properties near one of the words."""

    def extract(d: Doc) -> Column:
        gate = (d.kind == "js") & has(d.text, *markers)
        found = scripts.near(F.when(gate, d.decoded), names, words, lists_first)
        kept = F.filter(F.transform(found, lambda v: F.trim(v)), entry_shaped)
        return gated((gate, F.slice(F.array_distinct(tagged("html", F.transform(kept, lambda v: url.resolve_at(d.base, v)))), 1, CAP)))

    return extract


def page_links(d: Doc) -> Column:
    """Links to pages of the same host; a link without a dot stands for three candidates."""
    linking = F.filter(d.tags, lambda t: named(t, "a", "link", "iframe", exact=True))
    raw = F.transform(linking, lambda t: F.when(named(t, "iframe", exact=True), attribute(t, "src")).otherwise(attribute(t, "href")))
    in_scripts = values(d.decoded_strings, lambda s: s["value"].rlike(r"\.html?\z") & (F.length(s["value"]) <= 205) & ~s["value"].rlike(r"[<>\\\s]"))

    def variants(v: Column) -> Column:
        bare = F.regexp_replace(v, r"/+\z", "")
        return F.when(bare.contains(".") | v.endswith("/") | (v == ""), F.array(v)).otherwise(F.array(v, F.concat(v, F.lit("/index.html")), F.concat(v, F.lit(".html"))))

    def candidates(found: Column) -> Column:
        plain = lambda v: (v != "") & ~v.rlike(r"\A(#|javascript:|mailto:)") & ~v.contains("${")
        paths = lambda c: F.filter(F.transform(F.filter(c, plain), lambda v: F.substring_index(v, "?", 1)), lambda v: (v != "") & ~ends_in(F.lower(v), NO_PAGE))
        return F.transform(found, lambda v: paths(let(F.trim(v), variants)))

    def pages(lists: Column) -> Column:
        return F.transform(lists, lambda c: F.filter(F.transform(c, lambda v: url.resolve_at(d.base, v)), lambda u: url.is_http(u) & (F.regexp_extract(u, r"\A[^:]+://([^/?#]*)", 1) == d.base["host"])))

    # A link counts while fewer than CAP distinct pages precede it, so up to two more can come of it.
    capped = F.aggregate(pages(candidates(raw)), no_texts(), lambda acc, c: F.when(F.size(acc) >= CAP, acc).otherwise(F.array_union(acc, c)))
    return gated(((d.kind == "html") & has(d.text, "href=", "iframe"), tagged("html", capped)), ((d.kind == "js") & has(d.text, ".html", "import("), tagged("html", F.array_distinct(F.flatten(pages(candidates(in_scripts)))))))


def emp(d: Doc) -> Column:
    m = F.from_json(d.text, "federatedModules array<struct<entry:string,exposes:map<string,array<struct<chunks:array<string>>>>>>")
    listed = F.flatten(F.transform(m["federatedModules"], lambda f: F.concat(one(f["entry"]), F.coalesce(F.flatten(F.transform(F.flatten(F.map_values(f["exposes"])), lambda e: F.coalesce(e["chunks"], no_texts()))), no_texts()))))
    origin = d.origin
    usual = F.when(origin != "", F.array(F.concat(origin, F.lit("/emp.json")), F.concat(origin, F.lit("/emp-stats.json")))).otherwise(no_texts())
    return gated((d.kind.isin("js", "html") & has(d.text, "__MFE_REMOTE__", "emp.json", "__EMP__"), tagged("json", usual)), ((d.kind == "json") & d.text.contains('"federatedModules"'), tagged("url", F.coalesce(listed, no_texts()))))


def universal(d: Doc) -> Column:
    """Scripts that are named in any way, and if there are none, any quoted text that could be one."""

    def accepted(found: Column) -> Column:
        # A value that several forms name is looked at once.
        full = F.transform(F.transform(F.array_distinct(found), lambda v: F.trim(v)), lambda x: trimmed_end(F.when(x.startswith("//"), F.concat(d.base["scheme"], F.lit(":"), x)).otherwise(x)))
        return F.filter(full, lambda v: looks_like_script(v) & ~internal(v) & (d.base["ok"] | url.is_http(v)))

    gate = d.kind.isin("js", "html") & has(d.text, ".js", "document.write", "import(", "require(", "<script")
    js = F.filter(d.decoded_strings, lambda s: s["value"].contains(".js"))
    def strict(found: Column) -> Column:
        ending = lambda pattern: values(found, lambda s: s["value"].endswith(".js") & follows(s, pattern))
        sources = F.transform(F.filter(d.decoded_tags, lambda t: named(t, "script", exact=True)), lambda t: attribute(t, "src", quoted=True))
        loaders = F.transform(values(found, lambda s: s["value"].rlike(r"!/.+\.js\z")), lambda v: F.substring_index(v, "!", -1))
        registered = F.when(d.decoded.contains("System.register"), F.flatten(F.transform(sections(d.decoded, r"System\.register\s*\(\s*\[", "]"), quoted))).otherwise(no_texts())
        hosts = values(found, lambda s: s["value"].rlike(r"\A//[A-Za-z0-9.-]+/."))
        handed = values(found, lambda s: s["value"].rlike(r"\A/.") & follows(s, r"\w\s*\("))
        paths = values(found, lambda s: s["value"].endswith(".js") & s["value"].contains("/") & s["value"].rlike(r"\A(?:\.{0,2}/)?[\w-]++(?:\.js)?+(?:/[\w-]++(?:\.js)?+)*+\z"))
        return F.concat(F.filter(sources, lambda v: v.contains(".js")), ending(r"\bimport\s*\("), ending(r"\brequire\s*\("), ending(r"\bsrc\s*="), hosts, loaders, F.filter(registered, lambda v: v.contains(".js")), handed, paths, d.constants)

    def found(js: Column) -> Column:
        loose = values(js, lambda s: (F.length(s["value"]) < 500) & ~s["value"].rlike(r"[\\\s]") & s["value"].rlike(r"\.js(\?.*)?\z"))
        return let(accepted(strict(js)), lambda a: F.when(F.size(a) > 0, a).otherwise(accepted(loose)))

    return gated((gate, tagged("whole", F.flatten(F.transform(let(js, found), url.combo_parts)))))


def nothing(d: Doc) -> Column:
    """A reserved place in the order."""
    return F.array().cast(FINDING)


# The extractors' public names, in the order of their provenance.
BUILTIN: dict[str, Extractor] = {
    "HTMLScriptPlugin": html_scripts,
    "DynamicImportPlugin": dynamic_imports,
    "WebpackPlugin": bundler_runtime,
    "NextJSPlugin": next_js,
    "NuxtJSPlugin": nuxt,
    "VitePlugin": vite,
    "SvelteKitPlugin": svelte,
    "RequireJSPlugin": require_js,
    "ModuleFederationPlugin": federation,
    "ModuleFederationManifestPlugin": federation_manifest,
    "HelMicroPlugin": component_metadata,
    "ESMImportPlugin": static_imports,
    "ScriptCreatePlugin": script_create,
    "ModernJSPlugin": modern_js,
    "URLPatternPlugin": quoted_js,
    "SourceMapPlugin": source_map_refs,
    "UmiJSPlugin": nothing,
    "TrunkPlugin": sitemap,
    "QiankunPlugin": micro_entries(["proEntry", "entry"], ["proEntry", "entry"], ["container", "activeRule", "activeWhen", "sandbox", "singular", "name"]),
    "GarfishPlugin": micro_entries(["Garfish", "garfish"], ["entry"], ["name"]),
    "MicroAppPlugin": micro_entries(["microApp.start", "micro-app"], ["url"], ["name", "container"]),
    "WujiePlugin": micro_entries(["startApp", "wujie"], ["url"], ["name", "el"]),
    "IcestarkPlugin": micro_entries(["AppRoute", "@ice/stark", "icestark"], ["url"], ["name", "container", "sandbox"], lists_first=True),
    "HTMLPivotPlugin": page_links,
    "EmpPlugin": emp,
    "UniversalURLPlugin": universal,
}


class Registry:
    """Extractors by name, in order; adding a known name replaces it in its place."""

    def __init__(self, extractors: dict[str, Extractor] | None = None):
        self._all = dict(BUILTIN if extractors is None else extractors)

    def add(self, name: str, extractor: Extractor) -> Registry:
        return Registry(self._all | {name: extractor})

    def only(self, *names: str) -> Registry:
        if unknown := [n for n in names if n not in self._all]:
            raise KeyError(f"unknown extractors: {', '.join(unknown)}")
        return Registry({n: e for n, e in self._all.items() if n in names})

    def without(self, *names: str) -> Registry:
        return Registry({n: e for n, e in self._all.items() if n not in names})

    @property
    def names(self) -> list[str]:
        return list(self._all)

    def items(self):
        return self._all.items()


def extract(docs: DataFrame, registry: Registry | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep's columns, url, plugin, plugin_idx, type, value and pos for everything that documents refer to.

    docs: url, kind, text and optionally headers (map; names in any case) and mark (that
    a runtime elsewhere puts after chunks' names).  type is url or probe (scripts: an
    absolute address, or a fragment that has to be resolved), map (a source map's
    address), html or json (further documents), prepend or public (prefixes), request (to
    be fetched with a header), mark (what a runtime puts after chunks' names), chunk ("id
    hash" of a chunk whose name is told) or load ("id prefix" of one whose hash isn't).  Values are distinct within a document, extractor and
    type; pos orders them.
    """
    registry = registry or Registry()
    order = {n: i for i, n in enumerate(BUILTIN)}
    fields = [f for f in docs.columns if f in ("url", "kind", "text", "headers", "mark")]
    base = docs.select(*keep, *fields)
    for name, kind in (("headers", "map<string,string>"), ("mark", "string")):
        if name not in fields:
            base = base.withColumn(name, F.lit(None).cast(kind))
    of = lambda *kinds: F.col("kind").isin(*kinds)
    names = set(registry.names)
    base = base.withColumns({"_base": url.parsed(F.col("url")), "headers": content.lower_keys(F.col("headers")), "decoded": F.when(F.col("kind") != "json", content.decode(F.col("text"))).otherwise(F.col("text"))})
    marker = "_MODERNJS_ROUTE_MANIFEST"
    routes = scanners.brace_json(F.when((F.col("kind") == "html") & F.col("text").contains(marker), F.col("text")), f"window.{marker}") if "ModernJSPlugin" in names else F.lit(None).cast("string")
    base = base.withColumns({"_origin": url.origin_of(F.col("_base")), "_directory": url.directory_of(F.col("_base")), "_routes": routes})
    runtime = scripts.runtime(F.when(of("js") & runtime_like(F.col("text")), F.col("text")), F.col("_directory"), F.col("mark")) if names & {"WebpackPlugin", "NextJSPlugin"} else F.lit(None).cast("struct<public:string,probes:array<string>,mark:string,hashes:array<string>,wanting:array<string>>")
    dynamic = of("js", "html") & F.col("text").rlike(r"\bimport\s*\(\s*[A-Za-z_$]")
    assembled = scripts.constants(F.when(dynamic, F.col("decoded"))) if "UniversalURLPlugin" in names else no_texts()
    base = base.withColumns({
        "_tags": F.when(of("html"), tags(F.col("text"))), "_strings": F.when(of("html", "js"), strings(F.col("text"))), "_decoded_tags": F.when(of("html", "js") & F.contains(F.col("decoded"), F.lit("<script")), tags(F.col("decoded"))).otherwise(no_texts()),
        "_runtime": runtime, "_constants": assembled,
    })
    # Most texts hold no escapes, and their strings are those of the text as captured.
    base = base.withColumn("_decoded_strings", F.when(F.col("decoded") == F.col("text"), F.col("_strings")).when(of("html", "js"), strings(F.col("decoded"))))
    d = Doc(*(F.col(c) for c in ("url", "kind", "text", "decoded", "headers", "_base", "_origin", "_directory", "_tags", "_strings", "_decoded_tags", "_decoded_strings", "_runtime", "_constants", "_routes")))

    def stamped(found: Column, idx: int) -> Column:
        return F.transform(found, lambda f: F.struct(F.lit(idx).alias("idx"), f["type"].alias("type"), F.trim(f["value"]).alias("value")))

    listed = list(registry.items())
    found = F.concat(*(stamped(e(d), i) for i, (_, e) in enumerate(listed)))

    def routed(f: Column) -> Column:
        """An address that resolves is one; what doesn't has to be looked for, or with type whole is given up."""

        def final(x: Column) -> Column:
            address = url.is_http(x["u"])
            type_ = F.when(x["type"] == "absolute", "url").when(x["type"] == "whole", F.when(address, "url")).when((x["type"] == "url") & ~address, "probe").otherwise(x["type"])
            return F.concat(x["idx"].cast("string"), F.lit(" "), type_, F.lit(" "), F.when(x["u"].isNotNull() & address, x["u"]).otherwise(x["value"]))

        address = F.when(f["type"].isin("url", "whole"), url.normalize_at(F.col("_base"), f["value"]))
        return let(F.struct(f["idx"].alias("idx"), f["type"].alias("type"), f["value"].alias("value"), address.alias("u")), final)

    # Distinct by one text each, which is a hash set, while structs would be compared pair by pair.
    known = F.transform(F.filter(found, lambda f: F.coalesce(f["value"], F.lit("")) != ""), routed)
    keys = F.array_distinct(F.filter(known, lambda k: k.isNotNull()))
    rows = base.select(*keep, "url", F.posexplode(keys).alias("pos", "_key"))
    at = F.substring_index("_key", " ", 1).cast("int")
    of_registry = lambda texts: F.element_at(F.array(*texts), at + 1)
    return rows.select(
        *keep, "url", of_registry([F.lit(n) for n, _ in listed]).alias("plugin"), of_registry([F.lit(order.get(n, len(order) + k)) for k, (n, _) in enumerate(listed)]).alias("plugin_idx"),
        F.split_part("_key", F.lit(" "), F.lit(2)).alias("type"), F.regexp_replace("_key", r"\A\d+ [a-z]+ ", "").alias("value"), "pos",
    ).withColumn("value", F.when(F.col("type").isin("url", "map", "html", "json", "request", "prepend", "public"), url.hosted(F.col("value"))).otherwise(F.col("value")))
