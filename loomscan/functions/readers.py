"""Readers of markup and scripts as column expressions: tags with attributes, strings with what stands around them.

Extractors are predicates on what these readers give, so a text is read once however
many extractors look at it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomscan.functions import let

#: Characters of context that a string keeps.
REACH = 48
NO_STRINGS = "array<struct<mark:string,value:string,before:string,context:string,after:string>>"


def tags(html: Column) -> Column:
    """The opening tags of a text, in order, as they stand there."""
    return F.regexp_extract_all(html, F.lit(r"<[A-Za-z][^<>]*>"), F.lit(0))


def named(tag: Column, *names: str, exact: bool = False) -> Column:
    """Whether a tag has one of the names; exact: in lower case."""
    name = F.regexp_extract(tag, r"\A<([A-Za-z][A-Za-z0-9]*)", 1)
    return (name if exact else F.lower(name)).isin(*names)


def attribute(tag: Column, name: str, quoted: bool = False) -> Column:
    """The value of a tag's last attribute whose name is, or ends in a word, name; empty if there is none."""
    bare = "" if quoted else r"|[^\s\"'>]+"
    raw = F.regexp_extract(tag, rf"(?is)\A.*\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'{bare})", 1)
    return let(raw, lambda r: F.when(r.startswith('"') | r.startswith("'"), F.substr(r, F.lit(2), F.length(r) - 2)).otherwise(r))


def strings(script: Column) -> Column:
    """What stands between any two quotation marks of a text that follow one another.

    mark: the opening one; before: the text from the mark before up to this one;
    context: the last characters before the opening mark, strings included; after: what
    follows, from the closing mark on.  Code between two strings is among the values;
    predicates tell it apart, and a stray mark costs no string but its own.
    """

    def each(s: Column) -> Column:
        last = lambda x: F.substring(x, -REACH, REACH)  # noqa: E731  right computes its argument twice
        tail = lambda i: F.coalesce(last(F.get(s, i)), F.lit(""))
        row = lambda x, i: F.struct(F.left(x, F.lit(1)).alias("mark"), F.substr(x, F.lit(2)).alias("value"), F.get(s, i - 1).alias("before"), last(F.concat(tail(i - 3), tail(i - 2), tail(i - 1))).alias("context"), F.left(F.get(s, i + 1), F.lit(24)).alias("after"))
        return F.filter(F.transform(s, row), lambda x: x["after"].isNotNull() & x["before"].isNotNull() & (x["value"] != ""))

    # A text that begins with a mark has nothing before it; the blank makes that something.
    return let(F.split(F.concat(F.lit(" "), script), r"(?=[\"'`])", -1), each)


def values(found: Column, test) -> Column:
    """Values of the strings that pass the test."""
    return F.transform(F.filter(found, test), lambda s: s["value"])


def follows(s: Column, pattern: str) -> Column:
    """Whether a string directly follows what the pattern describes, blanks aside."""
    return s["context"].rlike(rf"(?:{pattern})\s*\z")


def sections(text: Column, begin: str, end: str) -> Column:
    """What stands between each match of begin and the next end, which is one character or more."""
    parts = F.split(text, begin, -1)
    return F.transform(F.filter(F.slice(parts, 2, 1 << 30), lambda p: p.contains(end)), lambda p: F.substring_index(p, end, 1))


def quoted(text: Column) -> Column:
    """The strings of a list's text, without what stands between them."""
    return F.transform(F.filter(F.transform(F.split(text, ",", -1), lambda p: F.trim(p)), lambda p: (F.length(p) > 2) & F.left(p, F.lit(1)).isin('"', "'") & (F.left(p, F.lit(1)) == F.right(p, F.lit(1)))), lambda p: F.substr(p, F.lit(2), F.length(p) - 2))
