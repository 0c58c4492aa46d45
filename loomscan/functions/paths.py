"""Paths of restored sources: relative, safe and bounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomscan.functions import let
from loomscan.functions.content import RESERVED, trim_all

MAX_DEPTH, MAX_LENGTH = 32, 512


def safe_path(path: Column) -> Column:
    """Without empty and . segments; null if nothing is left or a segment is .."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(parts, lambda s: ~s.isin("", "."))
    return F.when(~F.array_contains(parts, "..") & (F.size(kept) > 0), F.array_join(kept, "/"))


def safe_file(path: Column) -> Column:
    """A clean path as a relative one; empty if a segment is .."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.array_contains(F.split(slashed, "/"), ".."), F.lit("")).when(path.startswith("/"), F.regexp_replace(path, r"\A/+", "")).otherwise(slashed)


def sanitize(path: Column) -> Column:
    """Resolves . and .., dropping what would climb above the root, and replaces reserved characters."""
    parts = F.transform(F.split(F.replace(trim_all(path), F.lit("\\"), F.lit("/")), "/"), lambda s: trim_all(s))
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(F.regexp_replace(s, RESERVED, "_"))))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def _bare(path: Column) -> Column:
    """Without ~/, a scheme with its authority, and a leading / or ./"""

    def rest(p: Column) -> Column:
        after = let(F.regexp_replace(F.substr(p, F.locate("://", p) + F.lit(3)), r"\A//", ""), lambda r: F.when((r != "") & ~r.startswith("/"), F.regexp_extract(r, r"(?s)\A[^/]*/(.*)\z", 1)).otherwise(r))
        return F.when(F.locate("://", p) > 1, after).otherwise(p)

    out = let(F.regexp_replace(trim_all(path), r"\A~/", ""), rest)
    return F.regexp_replace(F.regexp_replace(out, r"\A/", ""), r"\A\./", "")


def _bounded(p: Column) -> Column:
    """At most MAX_LENGTH characters; the file name stays whole if it can."""

    def cut(name: Column) -> Column:
        room = F.lit(MAX_LENGTH - 1) - F.length(name)
        return F.when(room < 0, F.substring(p, 1, MAX_LENGTH)).otherwise(F.concat(F.substr(p, F.lit(1), F.greatest(room, F.lit(0))), F.lit("_"), name))

    return F.when(F.length(p) <= MAX_LENGTH, p).otherwise(let(F.substring_index(p, "/", -1), cut))


def _shallow(p: Column) -> Column:
    """At most MAX_DEPTH directories; deeper ones become part of the name."""
    deep = lambda s: F.concat(F.array_join(F.slice(s, 1, MAX_DEPTH), "/"), F.lit("/"), F.array_join(F.slice(s, MAX_DEPTH + 1, F.greatest(F.size(s) - MAX_DEPTH, F.lit(1))), "_"))
    return let(F.split(p, "/"), lambda s: F.when(F.size(s) - 1 > MAX_DEPTH, deep(s)).otherwise(p))


def source_path(source: Column, root: Column) -> Column:
    """Where a source of a map is to be restored; empty if its name says nothing."""
    path = let(_bare(F.coalesce(root, F.lit(""))), lambda base: F.when(base != "", F.concat(base, F.lit("/"), _bare(source))).otherwise(_bare(source)))
    return let(let(sanitize(F.regexp_replace(F.regexp_replace(path, r"\A/", ""), r"\A\./", "")), _bounded), _shallow)
