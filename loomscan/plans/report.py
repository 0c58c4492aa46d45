"""Reports of finished scans: aggregated by Spark, or for one scan written out line by line."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_report(js: DataFrame) -> DataFrame:
    """scan, report: addresses in order of discovery, one a line."""
    return js.groupBy("scan").agg(F.expr("listagg(url, '\n') within group (order by seq)").alias("report"))


def json_report(js: DataFrame) -> DataFrame:
    """scan, report: the entries as JSON, with their maps and numbers of sources where there are any."""
    more = [c for c in ("map_url", "n_sources") if c in js.columns]
    return js.groupBy("scan").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "url", "from_url", "plugin", "is_inline", *more)))).alias("report"))


def _totals(js: int, maps: int, sources: int) -> list[tuple[str, str]]:
    """(name, what is said of it)."""
    return [("JS files", str(js)), ("Source maps", f"{maps} ({'found' if maps else 'not found'})"), ("Restored sources", f"{sources} files (restored)" if sources else "0 (not restored)")]


def markdown(js: DataFrame, pages: DataFrame, maps: int = 0, sources: int = 0, store: str | None = None) -> Iterator[str]:
    """Lines of one scan's report; store: the path of the store that it was written to."""
    yield "## Summary"
    for name, said in _totals(js.count(), maps, sources):
        yield f"- **{name}**: {said}"
    rows = js.orderBy("seq")
    yield from ("", "## JS URLs")
    for r in rows.toLocalIterator():
        yield f"- {r.url}"
    yield from ("", "## JS Provenance", "| JS | discovered by | from | inline |", "|----|---------------|------|--------|")
    for r in rows.toLocalIterator():
        yield f"| {r.url} | {r.plugin or ''} | {r.from_url or '—'} | {'yes' if r.is_inline else ''} |"
    yield from ("", "## Cache Directories")
    yield from [f"- **{name}**: {store}/{table}" for name, table in (("html", "html"), ("js", "js"), ("sourceMap", "maps"), ("sources", "sources"))] if store else ["- cache disabled"]
    if not pages.isEmpty():
        yield from ("", "## HTML Entries")
        for r in pages.orderBy("url").toLocalIterator():
            yield f"- {r.url}  *(discovered by={r.plugin or ''}, from={r.from_url or '—'})*"


def text_summary(js: int, maps: int, sources: int, store: str | None = None) -> Iterator[str]:
    """Lines that follow the addresses of a text report."""
    yield from ("", "--- Summary ---")
    for name, said in _totals(js, maps, sources):
        yield f"{name}: {said}"
    if store:
        yield from (f"Source map dir: {store}/maps", f"Sources dir: {store}/sources")
