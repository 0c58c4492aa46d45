"""Reading scripts by their tokens: constants that add up to addresses, and the names of chunks.

A bundler's runtime builds the address of a chunk by adding literals, the chunk's id,
and look-ups of the id in maps.  `addresses` reads such sums whatever their order of
terms and works them out for every id of their maps.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A token: a string, a map of plain entries that is looked up, a dotted name, a number, or a sign.
_TOKEN = re.compile(
    r"""(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<map>\{[^{}]*\}(?=[\s)]*\[))|(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)|(?P<num>\d+)|(?P<sign>=>|===?|\|\||[^\s\w])""",
    re.A,
)
_ENTRY = re.compile(r"""(?:"([^"\\]{1,80})"|'([^'\\]{1,80})'|([\w$]{1,60}))\s*:\s*(?:"([^"\\]{1,80})"|'([^'\\]{1,80})')""", re.A)
_HEX = re.compile(r"[0-9a-f]+")
_HOLDS, _HELD = re.compile(r"""["']?\s*:\s*(\[)?"""), re.compile(r"""["']([^"']+)["']""")
# Names that a public path is assigned to.
PUBLIC_NAMES = ("window.__webpack_public_path__", "window.resourceBaseUrl")


class Token(NamedTuple):
    kind: str
    text: str

    @property
    def value(self) -> str:
        return self.text[1:-1] if self.kind == "str" else self.text


def tokens(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0]) for m in _TOKEN.finditer(text)]


def entries(body: str) -> list[tuple[str, str]]:
    """The (key, value) pairs of a map's text, or of all maps of a text."""
    return [(m[1] or m[2] or m[3], m[4] or m[5]) for m in _ENTRY.finditer(body)]


def is_hex(text: str, least: int = 1, most: int = 1 << 30) -> bool:
    return least <= len(text) <= most and _HEX.fullmatch(text) is not None


def is_chunk(name: str) -> bool:
    """Whether a name is chunk- and lower-case letters and digits."""
    rest = name.removeprefix("chunk-")
    return rest != name and rest.isascii() and rest.isalnum() and rest == rest.lower()


def is_stamped(text: str) -> bool:
    """Whether a text is a hash and a time: hash.time."""
    hash_, _, time = text.partition(".")
    return is_hex(hash_, 6, 20) and 10 <= len(time) <= 16 and time.isascii() and time.isdigit()


def query_of(address: str) -> str:
    """The query of a script's address, if it is made of words."""
    path, _, query = address.partition("?")
    return f"?{query}" if path.endswith(".js") and query and re.fullmatch(r"[\w=]+", query, re.A) else ""


def earliest(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Each key with its first value."""
    out: dict[str, str] = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


@dataclass(frozen=True)
class Term:
    """A part of a sum: text, the id, a look-up (of the id, in a map), a name of one id, or something unknown."""

    kind: str
    text: str = ""
    index: str = ""
    map: tuple[tuple[str, str], ...] = ()
    or_id: bool = False

    def worth(self, key: str) -> str:
        if self.kind == "lookup":
            return earliest(list(self.map)).get(key, key)
        if self.kind == "special":
            return self.text if key == self.map[0][0] else key
        return {"text": self.text, "id": key}.get(self.kind, "")


class Runtime:
    """A script whose sums name chunks."""

    def __init__(self, text: str):
        self.text, self.tokens = text, tokens(text)
        self.pairs = entries(text)
        self.hashes: dict[str, str] = {}
        self.wanting: list[str] = []
        self.public = next((ts[2].value for ts in self._runs(3) if ts[0].kind == "name" and ts[1].text == "=" and ts[2].kind == "str" and ts[2].value and self._is_public(ts[0].text)), "")

    @staticmethod
    def _is_public(name: str) -> bool:
        owner, _, field = name.rpartition(".")
        return name in PUBLIC_NAMES or owner == "__webpack_require__" or (field == "p" and len(owner) == 1 and owner.islower())

    def _runs(self, n: int) -> Iterator[tuple[Token, ...]]:
        return zip(*(self.tokens[i:] for i in range(n)))

    def _is(self, at: int, text: str) -> bool:
        return at < len(self.tokens) and self.tokens[at].text == text

    def _index(self, at: int) -> str | None:
        """The name in brackets at a token."""
        ts = self.tokens[at : at + 3]
        return ts[1].text if len(ts) == 3 and ts[0].text == "[" and ts[1].kind == "name" and ts[2].text == "]" else None

    def _named(self, name: str) -> tuple[tuple[str, str], ...]:
        """The entries of the map that is assigned to a name."""
        m = re.search(rf"(?<![\w$.]){re.escape(name)}\s*=\s*(\{{[^{{}}]*\}})", self.text)
        return tuple(entries(m[1])) if m else ()

    def _term(self, at: int, depth: int = 0) -> tuple[Term, int] | None:
        """The term that begins at a token, and the token after it; groups stand at most four deep."""
        if at >= len(self.tokens) or depth > 4:
            return None
        t = self.tokens[at]
        if t.kind == "str":
            return Term("text", t.value), at + 1
        if t.kind in ("map", "name") and (index := self._index(at + 1)):
            return Term("lookup", index=index, map=self._entries(t)), at + 4
        if t.kind == "name":
            return Term("name", t.text), at + 1
        if t.kind == "num":
            return Term("text", t.text), at + 1
        return self._group(at, depth) if t.text == "(" else None

    def _entries(self, t: Token) -> tuple[tuple[str, str], ...]:
        return tuple(entries(t.text)) if t.kind == "map" else self._named(t.text)

    def _group(self, at: int, depth: int) -> tuple[Term, int] | None:
        """(map)[id], (term || id), (term), or (number === id ? text : id)."""
        ts = self.tokens[at : at + 9]
        if len(ts) == 9 and ts[1].kind == "num" and ts[2].text == "===" and ts[4].text == "?" and ts[5].kind == "str" and ts[6].text == ":" and ts[7].text == ts[3].text and ts[8].text == ")":
            return Term("special", ts[5].value, ts[3].text, ((ts[1].text, ""),)), at + 9
        if len(ts) > 3 and ts[1].kind in ("map", "name") and ts[2].text == ")" and (index := self._index(at + 3)):
            return Term("lookup", index=index, map=self._entries(ts[1])), at + 6
        if (inner := self._term(at + 1, depth + 1)) is None:
            return None
        term, at = inner
        if self._is(at, "||") and at + 1 < len(self.tokens):
            other = self.tokens[at + 1]
            term = Term("lookup", "", term.index, term.map, True) if term.kind == "lookup" and other.text == term.index else Term("name", "") if other.kind == "str" else term
            at += 2
        return (term, at + 1) if self._is(at, ")") else None

    def sums(self) -> Iterator[tuple[int, list[Term]]]:
        """Where each sum of two or more terms begins, and its terms."""
        at = 0
        while at < len(self.tokens):
            begin, terms = at, []
            while (found := self._term(at)) is not None:
                terms.append(found[0])
                at = found[1]
                if not self._is(at, "+"):
                    break
                at += 1
            if len(terms) > 1:
                yield begin, terms
            at = max(at, begin + 1) if len(terms) > 1 else begin + 1

    def _hashes(self, pairs: list[tuple[str, str]]) -> dict[str, str]:
        return {k: v for k, v in earliest(pairs).items() if 3 <= len(v) <= 40 and v.isascii() and v.isalnum()}

    def _worked_out(self, terms: list[Term]) -> list[str]:
        """The addresses that a sum with look-ups stands for."""
        lookups = [t for t in terms if t.kind == "lookup"]
        if not lookups or terms[-1].kind != "text" or ".js" not in terms[-1].text:
            return []
        index = lookups[-1].index
        terms = [Term("id") if t.kind == "name" and t.text == index else t for t in terms]
        keyed = next((t for t in reversed(lookups) if not t.or_id), lookups[-1])
        hashes = self._hashes(list(keyed.map))
        if not hashes and len(lookups) > 1:  # the map isn't where it is looked up: any ids with hashes will do
            hashes = earliest([(k, v) for k, v in self.pairs if k.isdigit() and is_hex(v, 6, 40)]) or earliest([(k, v) for k, v in self.pairs if not k.isdigit() and is_hex(v, 5, 20)])
        first = next(i for i, t in enumerate(terms) if t.kind != "text" and t.kind != "name")
        lead = "" if any(t.kind == "text" for t in terms[:first]) else None
        absolute = self.public.rstrip("/") + "/" if self.public.startswith(("http://", "https://")) else ""
        if len(lookups) == 1:
            lead = lead if lead is None else self.public.rstrip("/") if self.public.startswith("/") else ""
            terms = [Term("text", "-") if t.kind == "text" and not t.text and 0 < i < len(terms) - 1 and terms[i + 1].kind == "lookup" else t for i, t in enumerate(terms)]
        elif lead is None:
            lead = "" if terms[-1].text == ".async.js" or not terms[first].or_id else "static/js/async/"
        else:
            lead = absolute
        made = ["".join(hashes[k] if t is keyed else t.worth(k) for t in terms) for k in hashes]
        return [lead + ("/" if lead.startswith("/") and not m.startswith("/") else "") + m if lead else m for m in made]

    def _arrow(self, begin: int, terms: list[Term]) -> list[str]:
        """id => "prefix" + id + "-": the hashes stand anywhere."""
        texts = [t.kind for t in terms[:3]] == ["text", "name", "text"]
        if begin < 2 or not self._is(begin - 1, "=>") or not texts or len(terms) != 3 or terms[2].text != "-" or terms[1].text != self.tokens[begin - 2].text:
            return []
        return [f"{terms[0].text}{k}-{v}.js" for k, v in self.pairs if k.isdigit() and is_hex(v, 6, 10)]

    def direct(self) -> list[str]:
        """Scripts that one id alone stands for."""
        return [ts[4].value for ts in self._runs(5) if ts[0].kind == "num" and ts[1].text == "===" and ts[2].kind == "name" and ts[3].text == "?" and ts[4].kind == "str" and ts[4].value.endswith(".js")]

    def _added(self, test: Callable[[str], bool]) -> str:
        """The first literal that is added to something and passes the test."""
        return next((ts[1].value for ts in self._runs(2) if ts[0].text == "+" and ts[1].kind == "str" and test(ts[1].value)), "")

    def loads(self) -> list[str]:
        """Names chunk-.. that a method is called with."""
        calls = (ts for ts in self._runs(4) if ts[0].kind == "name" and "." in ts[0].text and ts[1].text == "(" and ts[2].kind == "str" and ts[3].text == ")")
        return list(dict.fromkeys(ts[2].value for ts in calls if is_chunk(ts[2].value)))

    def _taken_apart(self) -> list[Token]:
        """All tokens, with those of maps that something is looked up in."""
        return [u for t in self.tokens for u in (tokens(t.text) if t.kind == "map" else [t])]

    def _lists_itself(self) -> bool:
        """Whether the script puts a chunk that tells one number on a bundler's list."""
        for ts in self._runs(6):
            owner, _, method = ts[0].text.rpartition(".")
            listed = owner.rpartition(".")[2]
            if method == "push" and listed.startswith("webpackChunk_") and ts[4].kind == "num" and [t.text for t in (*ts[1:4], ts[5])] == ["(", "[", "[", "]"]:
                return True
        return False

    def _single(self) -> list[tuple[str, str]]:
        """The entries of maps that have one, under a number."""
        ts = self._taken_apart()
        fives = zip(*(ts[i:] for i in range(5)))
        return [(k.value if k.kind == "str" else k.text, v.value) for a, k, b, v, z in fives if (a.text, b.text, z.text) == ("{", ":", "}") and k.kind in ("num", "str") and v.kind == "str"]

    def _flagged(self) -> list[str]:
        """Chunks that a map has a 1 for."""
        ts = self._taken_apart()
        return [k.value for k, b, v in zip(ts, ts[1:], ts[2:]) if k.kind == "str" and b.text == ":" and v.text == "1"]

    def _without_sums(self) -> list[str]:
        """Maps from ids to hashes whose sum isn't told."""
        fallback = next((ts[4].value for ts in self._runs(5) if ts[0].text == "||" and ts[1].text in ('""', "''") and ts[2].text == ")" and ts[3].text == "+" and ts[4].kind == "str" and ts[4].value.endswith("/")), "")
        prefix = fallback or self._added(lambda v: v.strip("/") == "static/js" and v.endswith("js/")) or self._added(lambda v: re.fullmatch(r"[\w-]+/[\w-]+/", v, re.A) is not None)
        words = {k: v for k, v in self.pairs if k.isdigit() and not is_hex(v)}
        folder, query = self._added(lambda v: re.fullmatch(r"\w+/", v, re.A) is not None), next((q for t in self.tokens if t.kind == "str" and (q := query_of(t.value))), "")
        out = [f"{prefix}{k}.{v}.js" for k, v in self.pairs if k.startswith("chunk-") and is_hex(k[6:]) and is_hex(v)]
        out += [f"{folder}{words.get(k, k)}.chunk.{v}.js{query}" for k, v in self.pairs if k.isdigit() and is_hex(v, 20, 24)]
        if self._lists_itself():
            out += [f"{k}.{v}.js" for k, v in self._single() if k.isdigit() and is_hex(v, 7, 40)]
        self.hashes = earliest([(k, v) for k, v in self.pairs if is_chunk(k) and is_hex(v, 5, 10)])
        self.wanting = [f"{x} {prefix}" for x in self.loads() if x not in self.hashes]
        return out + ([f"{prefix}{k}.{v}.js" for k, v in self.hashes.items()] or [f"{prefix}{x}.js" for x in self.loads() if likely_hash(x)])

    @property
    def mark(self) -> str | None:
        """hash.timestamp that the runtime puts after every name."""
        return self._added(lambda v: v.startswith(".") and v.endswith(".js") and is_stamped(v[1:-3]))[1:-3] or None

    def marked(self, mark: str | None, base: str) -> list[str]:
        """Absolute addresses of the chunks that are named here, under a mark."""
        if mark is None:
            return []
        chunk = lambda k: k.startswith("chunk-") and is_hex(k[6:], 6)
        ids = [k for k, v in self.pairs if chunk(k) and is_stamped(v)] + [k for k in self._flagged() if chunk(k)] + self.loads()
        return [f"{base}{x}.{mark}.js" for x in dict.fromkeys(ids)]

    def addresses(self, base: str, mark: str | None = None) -> list[str]:
        """Chunks to be probed: those that sums stand for, or else those that maps hint at.

        base: the script's own directory; mark: one that is known from another script.
        """
        found = [a for begin, terms in self.sums() for a in (self._worked_out(terms) or self._arrow(begin, terms))]
        if found:
            found += [d for d in self.direct() if d not in found]
        else:
            found = self._without_sums() + self.marked(self.mark or mark, base)
        return list(dict.fromkeys(found))


def likely_hash(chunk: str) -> bool:
    """Whether chunk-.. is a finished name: long, and more than seven tenths of it hexadecimal."""
    rest = chunk.removeprefix("chunk-")
    return rest != chunk and len(rest) >= 8 and sum(c in "0123456789abcdefABCDEF" for c in rest) > 0.7 * len(rest)


def imported_constants(text: str, passes: int = 3) -> list[str]:
    """Values of variables that are imported, followed through constants and sums of a name and a string.

    Later assignments win; passes: how many sums may build on one another.
    """
    found = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(text)]
    kinds, texts = [k for k, _ in found] + ["sign"] * 5, [t for _, t in found] + [""] * 5  # what is before the first is the last, which is empty
    known: dict[str, str] = {}
    sums: list[tuple[str, str, str]] = []
    used: list[str] = []
    for i, sign in enumerate(texts):
        if sign == "=" and kinds[i - 1] == "name":
            if kinds[i + 1] == "str" and texts[i - 2] in ("const", "let", "var"):
                if 1 <= len(texts[i + 1]) - 2 <= 200:
                    known[texts[i - 1]] = texts[i + 1][1:-1]
            elif kinds[i + 1] == "name" and texts[i + 2] == "+" and kinds[i + 3] == "str" and 1 <= len(texts[i + 3]) - 2 <= 200:
                sums.append((texts[i - 1], texts[i + 1], texts[i + 3][1:-1]))
        elif sign == "(" and texts[i - 1] == "import" and kinds[i + 1] == "name" and texts[i + 2] == ")":
            used.append(texts[i + 1])
    for _ in range(passes):
        before = dict(known)
        for target, source, end in sums:
            if source in known:
                known[target] = known[source] + end
        if known == before:
            break
    return [known[v] for v in used if v in known]


@cache
def _any_of(*names: str) -> re.Pattern[str]:
    return re.compile("|".join(map(re.escape, names)))


def properties(text: str, names: list[str]) -> Iterator[tuple[int, int, list[str], bool]]:
    """Begin, end, strings and listed for each property of one of the names that holds a string or a list of strings."""
    for m in _any_of(*names).finditer(text):
        rest = _HOLDS.match(text, m.end())
        if rest is None:
            continue
        end = text.find("]", rest.end()) if rest[1] else -1
        if rest[1] and end < 0:
            continue
        body = text[rest.end() : end] if rest[1] else text[rest.end() : rest.end() + 1] + _until(text, rest.end())
        held = _HELD.findall(body)
        if held:
            yield m.start(), end + 1 if rest[1] else rest.end() + len(body), held if rest[1] else held[:1], bool(rest[1])


def _until(text: str, at: int) -> str:
    """What follows an opening quotation mark up to and with the next one, if one stands there."""
    if at >= len(text) or text[at] not in "\"'":
        return ""
    ends = [e for e in (text.find('"', at + 1), text.find("'", at + 1)) if e >= 0]
    return text[at + 1 : min(ends) + 1] if ends else ""


def entries_near(text: str, names: list[str], words: list[str], lists_first: bool = False, reach: int = 400) -> list[str]:
    """Strings of properties that have one of the words within reach characters."""
    kept = [(listed, held) for a, z, held, listed in properties(text, names) for about in [text[max(0, a - reach) : z + reach]] if any(w in about for w in words)]
    if lists_first:
        return [v for listed, held in kept if listed for v in held] + [held[0] for _, held in kept]
    return [held[0] for listed, held in kept if not listed]


RUNTIME = T.StructType([T.StructField("public", T.StringType()), T.StructField("probes", T.ArrayType(T.StringType())), T.StructField("mark", T.StringType()), T.StructField("hashes", T.ArrayType(T.StringType())), T.StructField("wanting", T.ArrayType(T.StringType()))])


@F.pandas_udf(RUNTIME)
def _runtime(texts: pd.Series, bases: pd.Series, marks: pd.Series) -> pd.DataFrame:
    out = []
    for text, base, mark in zip(texts, bases, marks):
        r = None if text is None else Runtime(text)
        if r is None:
            out.append(("", [], None, [], []))
        else:
            probes = r.addresses(base or "", mark)
            out.append((r.public, probes, r.mark, [f"{k} {v}" for k, v in r.hashes.items()], r.wanting))
    return pd.DataFrame(out, columns=["public", "probes", "mark", "hashes", "wanting"])


def runtime(text: Column, base: Column, mark: Column) -> Column:
    """A runtime's public path, what it makes worth probing, its mark, and chunks' ids: with a hash, and loaded without one.

    Nothing for null.  hashes: "id hash"; wanting: "id prefix", for another script's hash.
    """
    return _runtime(text, base, mark)


def _array(f: Callable[[str], list[str]]):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else f(t) for t in texts], dtype=object)

    return run


def constants(text: Column) -> Column:
    return _array(imported_constants)(text)


def near(text: Column, names: list[str], words: list[str], lists_first: bool = False) -> Column:
    return _array(lambda t: entries_near(t, names, words, lists_first))(text)
