"""Scans over captured responses from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomscan.deploy import ship
from loomscan.operators.discover import PAGE_BUDGET
from loomscan.operators.extract import Registry
from loomscan.plans import report
from loomscan.scan import scan
from loomscan.sources.store import Store


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("loomscan", description="Scripts, source maps and sources of captured sites.")
    p.add_argument("--responses", required=True, help="Parquet table of url, status, content_type, text and optionally final_url, headers, request")
    p.add_argument("--url", action="append", required=True, help="where a scan begins; once for each scan")
    p.add_argument("--format", choices=["text", "json", "markdown"], default="text")
    p.add_argument("--store", help="folder of earlier results, and of this one's")
    p.add_argument("--no-read", action="store_true", help="discover anew what the store has")
    p.add_argument("--no-write", action="store_true", help="leave the store as it is")
    p.add_argument("--pages", type=int, default=PAGE_BUDGET, help="pages that a scan enters by links")
    p.add_argument("--only", action="append", help="an extractor to use; all if there is none")
    p.add_argument("--without", action="append", default=[], help="an extractor to leave out")
    p.add_argument("--list", action="store_true", help="name the extractors and end")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if a start has no successful response."""
    if "--list" in (argv if argv is not None else sys.argv[1:]):
        print("\n".join(Registry().names))
        return 0
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("loomscan").getOrCreate()
    ship(spark)
    registry = (Registry().only(*a.only) if a.only else Registry()).without(*a.without)
    store = Store(spark, a.store, reads=not a.no_read, writes=not a.no_write) if a.store else None
    starts = spark.createDataFrame([(u, u) for u in a.url], "scan string, start string")
    result = scan(starts, spark.read.parquet(a.responses), registry, a.pages, store)
    totals = {r.scan: r for r in result.summary().collect()}  # one row a scan
    for u in a.url:
        js, t = result.js.where(F.col("scan") == u), totals.get(u)
        counts = (t.js_count, t.map_count, t.source_count) if t else (0, 0, 0)
        if a.format == "json":
            print("\n".join(r.report for r in report.json_report(js).collect()))
        elif a.format == "markdown":
            for line in report.markdown(js, result.html.where(F.col("scan") == u), *counts[1:], store=a.store):
                print(line)
        else:
            for r in js.orderBy("seq").toLocalIterator():
                print(r.url)
            print("\n".join(report.text_summary(*counts, store=a.store)))
    failed = result.failed.collect()  # at most one row a start
    for r in failed:
        print(f"{r.start}: {'no response' if r.status is None else f'status {r.status}'}", file=sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
