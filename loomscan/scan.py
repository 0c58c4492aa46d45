"""Whole scans: discovery, source maps, restored sources, a summary, and their replay from a store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.functions import content, url
from loomscan.operators import sourcemaps
from loomscan.operators.discover import PAGE_BUDGET, Result, discover
from loomscan.operators.extract import Registry
from loomscan.sources.bodies import Bodies, before, with_stored
from loomscan.sources.shared import keep
from loomscan.sources.store import Store

#: Restored files of all scans together whose text a result carries.
KEPT_SOURCES = 2000
_TABLES = {
    "js": "scan string, start string, url string, from_url string, plugin string, is_inline boolean, seq long",
    "html": "scan string, url string, from_url string, plugin string",
    "maps": "scan string, url string, map_url string, seq long, pos long",
    "sources": "scan string, js_url string, map_url string, idx long, path string, content string, mode string",
    "prefixes": "scan string, kind string, value string",
}


@dataclass
class ScanResult:
    """js: scan, start, url, from_url, plugin, is_inline, seq, map_url, n_sources.  html: pages entered by links.

    maps: scan, url (of the script), map_url of every valid map.  sources: scan, js_url,
    map_url, idx, path, content, mode.  failed: scan, start, status of starts without a
    successful response.  replayed: scan, of those that came from the store.
    """

    js: DataFrame
    html: DataFrame
    maps: DataFrame
    sources: DataFrame
    prefixes: DataFrame
    failed: DataFrame
    replayed: DataFrame

    def summary(self, kept: int = KEPT_SOURCES) -> DataFrame:
        """scan, js_count, map_count, source_count and sources_omitted: those beyond the first `kept` of all scans."""
        js = self.js.groupBy("scan").agg(F.count("*").alias("js_count"), F.count("map_url").alias("map_count"))
        files = sourcemaps.counted(self.sources, "scan", kept).select("scan", F.col("total").alias("source_count"), F.col("omitted").alias("sources_omitted"))
        return js.join(files, "scan", "left").select("scan", "js_count", "map_count", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("source_count", "sources_omitted")))


def scan(starts: DataFrame, responses: DataFrame, registry: Registry | None = None, budget: int = PAGE_BUDGET, store: Store | None = None, known: Bodies | None = None) -> ScanResult:
    """Scans starts (scan, start) over captured responses.

    known: bodies of earlier scans, which go before the responses; those of the scripts
    and pages that were found are put there.

    With a store, scans that are in it and whose sources are all there come from it, and
    neither their documents are read nor their maps; scans whose sources were lost have
    these restored again from the maps that are known; all others are discovered, and
    written to the store if it takes any.
    """
    spark = starts.sparkSession
    starts = starts.select(F.col("scan").cast("string").alias("scan"), "start")
    nothing = {name: spark.createDataFrame([], schema) for name, schema in _TABLES.items()}
    held = _stored(store, starts) if store else None
    states = held.states if held else spark.createDataFrame([], "scan string, whole boolean")
    parts = {name: [] for name in _TABLES}
    missing = starts
    if held:
        # Which scans are there is a table, and what they have comes by semi-joins with it.
        missing = starts.join(states, "scan", "left_anti")
        for name in _TABLES:
            parts[name].append(held.tables[name].join(states.where("whole") if name == "sources" else states, "scan", "left_semi"))
        if not states.where("not whole").isEmpty():
            again = held.tables["maps"].join(states.where("not whole"), "scan", "left_semi")
            _, sources = _restored(again, responses)
            parts["sources"].append(keep(sources))
            _write(store, {"sources": parts["sources"][-1]})
    failed = None
    if held is None or not missing.isEmpty():
        answered = responses
        if known is not None:
            stored = keep(known.answers().join(missing.select("scan").distinct(), "scan", "left_semi"))
            answered = before(stored, missing, responses)
            responses = with_stored(stored, responses)
        found = discover(missing, answered, registry, budget)
        if known is not None:
            known.put(_bodies(found, responses))
        maps, sources = _restored(_references(found.js_entries, found.maps, responses), responses)
        led = found.starts.groupBy("scan").agg(F.min_by("start", "seq").alias("start"))
        js = found.js_entries.join(led, "scan", "left")
        fresh = {"js": js, "html": found.html_entries, "maps": keep(maps), "sources": keep(sources), "prefixes": _prefixes(found.findings, js)}
        for name, rows in fresh.items():
            parts[name].append(rows.select(*nothing[name].columns))
        if store:
            _write(store, {n: fresh[n].select(*nothing[n].columns) for n in fresh}, found.starts)
        failed = found.failed
    out = {name: _union(rows) if rows else nothing[name] for name, rows in parts.items()}
    # Of a script's maps the last one that was told counts.
    last = out["maps"].groupBy("scan", "url").agg(F.max_by("map_url", F.struct("seq", "pos")).alias("map_url"))
    files = out["sources"].groupBy("scan", F.col("js_url").alias("url")).agg(F.count("*").alias("n_sources"))
    js = out["js"].join(last, ["scan", "url"], "left").join(files, ["scan", "url"], "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)).cast("long"))
    return ScanResult(js, out["html"], out["maps"].select("scan", "url", "map_url"), out["sources"], out["prefixes"], failed if failed is not None else spark.createDataFrame([], "scan string, start string, status int"), states.select("scan"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _references(js: DataFrame, told: DataFrame, responses: DataFrame) -> DataFrame:
    """scan, url, map_url, seq, pos: what scripts say of their maps, and the address beside each one that says nothing."""
    silent = js.select("scan", "url", "seq").join(told.select("scan", "url").distinct(), ["scan", "url"], "left_anti")
    beside = silent.select("scan", "url", url.map_of(F.col("url")).alias("map_url"), "seq", F.lit(0).cast("long").alias("pos"))
    return told.select("scan", "url", "map_url", "seq", F.col("pos").cast("long").alias("pos")).unionByName(beside)


def _restored(references: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid maps, and the files that they restore; the script's own text where a map has no contents."""
    plain = responses.where(F.coalesce("request", F.lit("")) == "") if "request" in responses.columns else responses
    texts = plain.where("status between 200 and 299").select(url.normalize(F.col("url")).alias("_at"), "content_type", "text")
    held = references.where("map_url like 'data:%'").withColumn("text", content.utf8(content.data_uri(F.col("map_url"))))
    elsewhere = references.where("map_url not like 'data:%'")
    met = elsewhere.withColumn("_at", url.normalize(F.col("map_url"))).join(texts.where(sourcemaps.may_be_map("content_type")), "_at").select(*references.columns, "text")
    valid = held.unionByName(met).where(content.is_source_map(F.col("text")))
    maps = valid.select(*references.columns)
    parsed = sourcemaps.has_contents(sourcemaps.parse_maps(valid))
    lacking = parsed.where("not has_contents").withColumn("_at", F.col("url")).join(texts.select("_at", F.col("text").alias("minified")), "_at", "left")
    whole = sourcemaps.restore(parsed.where("has_contents").select(*references.columns, "text"), ("scan", "url", "map_url"))
    rebuilt = sourcemaps.restore(lacking.select(*references.columns, "text", "minified"), ("scan", "url", "map_url"), minified="minified")
    files = whole.unionByName(rebuilt)
    return maps, files.select("scan", F.col("url").alias("js_url"), "map_url", F.col("idx").cast("long").alias("idx"), "path", "content", "mode")


def _prefixes(findings: DataFrame, js: DataFrame) -> DataFrame:
    """What a later scan may begin with: prefixes that were told, directories of the own origin, public paths."""
    told = findings.where("type in ('prepend', 'public')").select("scan", F.col("type").alias("kind"), "value")
    own = js.where(url.origin(F.col("url")) == url.origin(F.col("start"))).select("scan", F.lit("prepend").alias("kind"), url.directory(F.col("url")).alias("value"))
    return told.unionByName(own).distinct()


def _bodies(found: Result, responses: DataFrame) -> DataFrame:
    """scan, slot, url and text of a walk's scripts and of the pages that it began with."""
    texts = responses.where("status between 200 and 299").select(url.normalize(F.col("url")).alias("url"), "text").where("text is not null")
    scripts = found.js_entries.select("scan", F.lit("js").alias("slot"), "url")
    pages = found.starts.select("scan", F.lit("html").alias("slot"), url.normalize(F.col("start")).alias("url"))
    return scripts.unionByName(pages).join(texts, "url")


@dataclass
class _Stored:
    """tables: of all scans; states: scan and whole, of the wanted scans that are there."""

    tables: dict[str, DataFrame]
    states: DataFrame


def _stored(store: Store, starts: DataFrame) -> _Stored | None:
    """The store's tables, and which of the wanted scans are whole in them and which have lost sources."""
    tables = {name: store.read(name, schema) for name, schema in _TABLES.items()}
    counts = store.read("counts", "scan string, n_sources long")
    if counts is None:
        return None
    spark = starts.sparkSession
    tables = {n: (t if t is not None else spark.createDataFrame([], _TABLES[n])).select(*(f.split()[0] for f in _TABLES[n].split(", "))) for n, t in tables.items()}
    have = tables["sources"].groupBy("scan").agg(F.count("*").alias("n_have"))
    wanted = starts.select("scan").distinct().join(counts, "scan").join(have, "scan", "left")
    return _Stored(tables, keep(wanted.select("scan", (F.coalesce("n_have", F.lit(0)) >= F.col("n_sources")).alias("whole"))))


def _write(store: Store, tables: dict[str, DataFrame], scanned: DataFrame | None = None) -> None:
    """Writes a scan's tables; scanned: the scans whose starts were answered, of which those that have no rows of a table lose what it held.

    The row in counts comes last and makes a scan one that is there, scripts or none.
    """
    for name, rows in tables.items():
        store.write(name, rows, "scan")
        if scanned is not None:
            store.clear(name, _TABLES[name], scanned.select("scan").distinct().join(rows.select("scan"), "scan", "left_anti"), "scan")
    if scanned is not None:
        files = tables["sources"].groupBy("scan").agg(F.count("*").alias("n_sources"))
        store.write("counts", scanned.select("scan").distinct().join(files, "scan", "left").select("scan", F.coalesce("n_sources", F.lit(0)).alias("n_sources")), "scan")
