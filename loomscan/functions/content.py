"""Functions of payloads: what kind they are, what they say once unescaped, and where they may be stored."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_JSONP = r"\A(?:window\.)?([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\(\s*[\[{]"
# Media types that name a kind.
KINDS = {"html": ["text/html", "application/xhtml+xml"], "json": ["application/json", "text/json"], "js": ["application/javascript", "text/javascript", "application/x-javascript", "application/ecmascript", "text/ecmascript"]}
# Endings of cache files that need no .js.
CACHE_ENDINGS = r"\.(js|mjs|css|ts|tsx|vue)\z"
# Characters that can't stand in file names.
RESERVED = r"[\x00-\x1F/\\:*?\"<>|]"


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def utf8(content: Column) -> Column:
    """Bytes as text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def is_jsonp(text: Column) -> Column:
    return F.coalesce(text.rlike(_JSONP), F.lit(False))


def jsonp_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, _JSONP, 1), F.lit(""))


def unwrap_jsonp(text: Column) -> Column:
    """The JSON inside a callback, null where there is none that parses."""
    body = trim_all(F.regexp_replace(trim_all(text), r"(?s)\A/\*.*?\*/", ""))
    inner = trim_all(F.regexp_extract(body, r"(?s)\A[^(]*\((.*)\)[^)]*\z", 1))
    return F.when(is_jsonp(body) & F.try_parse_json(inner).isNotNull(), inner)


def kind(content_type: Column, text: Column) -> Column:
    """html, json, js or jsonp: by the media type, else by the first 200 characters."""
    mime = trim_all(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))
    head = trim_all(F.substring(F.coalesce(text, F.lit("")), 1, 200))
    sniffed = F.when(head.startswith("<!DOCTYPE") | head.startswith("<!doctype") | head.startswith("<html"), "html").when(is_jsonp(head), "jsonp").when(head.startswith("{") | head.startswith("["), "json").otherwise("js")
    out = None
    for k, mimes in KINDS.items():
        out = (F if out is None else out).when(mime.isin(mimes), F.lit(k))
    return out.otherwise(sniffed)


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
_SLOW = r"%[0-9A-Fa-f]{2}|\\u[0-9a-fA-F]{4}|#([0-9]+|[xX][0-9a-fA-F]+);"
_ESCAPES = ((r"\\", "\0"), (r"\/", "/"), (r"\"", '"'), (r"\'", "'"), (r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t"), ("\0", "\\"))


def decoded(text: str) -> str:
    """One text without its escapes; see decode."""
    import re
    from urllib.parse import unquote

    def run(m: re.Match) -> str:
        return bytes.fromhex(m[0].replace("\\u", "")).decode("utf-16-be", "replace")

    def one(m: re.Match) -> str:
        n = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    if "%" in text and not re.search("%(?![0-9A-Fa-f]{2})", text):
        try:
            text = unquote(text, errors="strict")
        except UnicodeDecodeError:
            pass
    if "\\" in text:
        for a, b in _ESCAPES:
            text = text.replace(a, b)
        text = re.sub(r"(?:\\u[0-9a-fA-F]{4})+", run, text)
    if "&" in text:
        for a, b in _ENTITIES:
            text = text.replace(a, b)
        text = re.sub(r"#([0-9]+|[xX][0-9a-fA-F]+);", one, text)
    return text


@F.pandas_udf(T.StringType())
def _slow(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else decoded(t) for t in texts], dtype=object)


def decode(text: Column) -> Column:
    """Text without percent, string, unicode and entity escapes, undone in this order.

    Percent escapes are undone in the whole text or not at all.  A numeric entity leaves
    its ampersand.  Only texts with percent or unicode escapes or numeric entities leave
    the JVM.
    """

    def replaced(t: Column, pairs: tuple) -> Column:
        for a, b in pairs:
            t = F.replace(t, F.lit(a), F.lit(b))
        return t

    strings = F.when(text.contains("\\"), replaced(text, _ESCAPES)).otherwise(text)
    return F.coalesce(_slow(F.when(text.rlike(_SLOW), text)), replaced(strings, _ENTITIES))


def data_uri(uri: Column) -> Column:
    """The bytes of a data: address, null where there are none to be had."""
    meta, payload = F.regexp_extract(uri, r"(?s)\Adata:([^,]*),", 1), F.regexp_extract(uri, r"(?s)\Adata:[^,]*,(.*)\z", 1)
    plain = F.try_url_decode(F.replace(payload, F.lit("+"), F.lit("%2B")))
    return F.when(F.coalesce(uri.rlike(r"\Adata:[^,]*,"), F.lit(False)), F.when(meta.contains("base64"), F.try_to_binary(payload, F.lit("base64"))).otherwise(F.to_binary(plain, F.lit("utf-8"))))


def is_source_map(text: Column) -> Column:
    """Whether a payload is JSON with a source list that isn't empty."""
    head = trim_all(F.substring(F.coalesce(text, F.lit("")), 1, 200))
    sources = F.try_variant_get(F.try_parse_json(text), "$.sources", "array<variant>")
    return head.startswith("{") & F.coalesce(F.size(sources) > 0, F.lit(False))


def lower_keys(headers: Column) -> Column:
    """Headers by their names in lower case; of names that differ in case only, one that is in lower case already counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct((F.lower(e["key"]) != e["key"]).alias("other"), F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    kept = F.aggregate(F.array_sort(entries), F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.create_map(e["key"], e["value"]))))
    return F.when(F.exists(F.map_keys(headers), lambda k: k != F.lower(k)), kept).otherwise(headers)


def scope_name(url: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(url, r"\Ahttps://", "https_"), r"\Ahttp://", "http_")
    return F.translate(out, ":/", "__")


def cache_name(url: Column) -> Column:
    """host-path with dashes for slashes, and .js where no known ending stands."""
    bare = F.regexp_replace(url, r"\Ahttps?://", "")
    name = F.concat(F.translate(F.substring_index(bare, "/", 1), ":", "_"), F.lit("-"), F.translate(F.regexp_extract(bare, r"(?s)\A[^/]*/(.*)\z", 1), "/", "-"))
    return F.when(name.rlike(CACHE_ENDINGS), name).otherwise(F.concat(name, F.lit(".js")))


def flat_name(path: Column) -> Column:
    """A path as one safe file name; empty if it can't be made one."""
    out = F.regexp_replace(F.regexp_replace(path, r"\A/", ""), r"/\z", "")
    for a in ("..", "./", "/./"):
        out = F.replace(out, F.lit(a), F.lit("_"))
    out = F.translate(out, "/\\<>:\"|?*\0", "__________")
    return F.when(out.contains(".."), F.lit("")).otherwise(out)


def map_prefix(url: Column) -> Column:
    """A source map's file name without .map, made safe; map if nothing is left."""
    name = F.regexp_replace(F.substring_index(F.regexp_extract(url, r"(?s)\A([^?#]*)", 1), "/", -1), r"\.map\z", "")
    out = F.regexp_replace(name, RESERVED, "_")
    return F.when(out == "", F.lit("map")).otherwise(out)
