"""Functions of the library in SQL: native ones as SQL functions, scanners as Python ones.

A native function is a column expression; its SQL text, over the parameters' names, is the
body of a temporary SQL function, which Spark puts in place of each call.  Nothing of
Python is in the plan of a query that calls it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomscan.functions import content, paths, scanners, scripts, url

#: name: the expression, its parameters, and what it returns.
NATIVE: dict[str, tuple[Callable[..., Column], tuple[str, ...], str]] = {
    "url_key": (url.normalize, ("address",), "string"), "url_resolve": (url.resolve, ("base", "ref"), "string"), "url_is_http": (url.is_http, ("address",), "boolean"), "url_rebase": (url.rebase_loopback, ("address", "start"), "string"),
    "url_directory": (url.directory, ("address",), "string"), "url_origin": (url.origin, ("address",), "string"), "url_host": (url.host, ("address",), "string"), "url_join": (url.join, ("base", "path"), "string"), "url_members": (url.combo_members, ("address",), "array<string>"),
    "url_is_static": (url.is_static, ("address",), "boolean"), "url_is_map": (url.is_map, ("address",), "boolean"), "url_map": (url.map_of, ("address",), "string"),
    "content_kind": (content.kind, ("content_type", "body"), "string"), "content_jsonp_name": (content.jsonp_name, ("body",), "string"), "content_unwrap": (content.unwrap_jsonp, ("body",), "string"), "content_is_map": (content.is_source_map, ("body",), "boolean"),
    "name_scope": (content.scope_name, ("address",), "string"), "name_cached": (content.cache_name, ("address",), "string"), "name_flat": (content.flat_name, ("name",), "string"),
    "path_safe": (paths.safe_path, ("path",), "string"), "path_sanitize": (paths.sanitize, ("path",), "string"), "path_of_source": (paths.source_path, ("source", "root"), "string"),
}
#: Name and Arrow function; what a native expression can't do.
FUNCTIONS = {
    "inline_scripts": scanners._array_udf(scanners.inline_bodies),
    "imported_constants": scripts._array(scripts.imported_constants),
    "decode_vlq": scanners.decode_vlq,
    "parse_mappings": scanners.parse_mappings,
    "unescaped": content._slow,
    "runtime": scripts._runtime,
}
# Names that SQL writes between their operands; called like functions they have to be quoted.
_OPERATOR = re.compile(r"""(r'[^']*'|r"[^"]*"|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`[^`]*`)|(?<![\w`.])(<=>|<=|>=|==|!=|<>|\|\||[=<>+\-*/%!&|^]|and|or|not|in|div|rlike|like|NOT|AND|OR|IN)(?=\()""", re.S)


def spelled(column: Column) -> str:
    """A column as SQL that Spark parses again."""
    return _OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`", column._jc.node().sql())


def register(spark: SparkSession, prefix: str = "loom_", only: set[str] | None = None) -> list[str]:
    """Registers functions for SQL in this session, all or some native ones, under a prefix; returns their names."""
    names = []
    for name, (f, parameters, kind) in NATIVE.items():
        if only is not None and name not in only:
            continue
        given = ", ".join(f"{p} string" for p in parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS {kind} RETURN {spelled(f(*(F.col(p) for p in parameters)))}")
        names.append(prefix + name)
    if only is not None:
        return names
    members = spelled(url.combo_members(F.col("address")))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}members(address string) RETURNS TABLE(pos int, member string) RETURN SELECT pos, member FROM (SELECT posexplode({members}) AS (pos, member))")
    return [*names, f"{prefix}members", *_scanners(spark, prefix)]


def _scanners(spark: SparkSession, prefix: str) -> list[str]:
    """The Python functions, and the table function chunks(text, base)."""
    names = []
    for name, f in FUNCTIONS.items():
        spark.udf.register(prefix + name, f)
        names.append(prefix + name)

    class Chunks:
        """Chunks that a runtime names, one a row."""

        def eval(self, text: str, base: str):
            for address in scripts.Runtime(text or "").addresses(base or ""):
                yield (address,)

    spark.udtf.register(f"{prefix}chunks", F.udtf(Chunks, returnType="address string"))
    return [*names, f"{prefix}chunks"]
