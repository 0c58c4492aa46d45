"""Cookies as a table of events: what a request carries is what was set last before it.

A cookie is told apart by name, domain, path and the host that set it.  Domains of a
request are the suffixes of its host, paths the prefixes of its own that end at a slash.
A request may carry hundreds of cookies, so none is sent to it: sets and requests meet by
stretches of time, and a task goes through those of a stretch in their order, with what is
held by then.  What earlier stretches ended with is carried over.  Beyond MOST cookies
hosts are dealt into groups, and a set goes to those that have requests for it, so a task
holds a group's cookies, and a group or site with most of all rows is many stretches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomscan.functions import url
from loomscan.sources.shared import keep, parts

#: Cookies that a group of hosts has, about; rows that a stretch has at least; characters of headers sent on at once; cookies that are held merged.
MOST, ROWS, BYTES, HELD = 50_000, 10_000, 8 << 20, 1 << 20
_COOKIE = ["domain", "path", "name", "host"]
_CUT = pa.schema([("dealt", pa.int32()), ("first", pa.int32()), ("final", pa.int32()), ("cuts", pa.list_(pa.int64()))])


def _named(pairs: Column, name: str) -> Column:
    """Values of an attribute, in order."""
    return F.transform(F.filter(pairs, lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))) == name), lambda p: F.when(F.instr(p, "=") > 0, F.trim(F.substr(p, F.instr(p, "=") + 1))).otherwise(F.lit("")))


def _date(text: Column) -> Column:
    """Milliseconds of a date as servers write it; null if it is none."""
    part = lambda i: F.regexp_extract(text, r"(\d{1,2})[ -]([A-Za-z]{3})[ -](\d{4}) (\d\d:\d\d:\d\d)", i)
    return F.unix_millis(F.try_to_timestamp(F.concat(part(1), F.lit(" "), F.initcap(part(2)), F.lit(" "), part(3), F.lit(" "), part(4), F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z")))


def parsed(responses: DataFrame) -> DataFrame:
    """at, seq, host, name, value, domain, path, expires: the cookies that responses set; responses: url, at, set_cookie.

    at: milliseconds; set_cookie: an array of headers, of which those without a name are
    left out, and so are cookies that have run out when they are set (they replace none).
    Max-Age goes before Expires; expires is null for cookies of the session.
    """
    # A condition on u would be asked before rows are dealt out, and parse every address again.
    rows = responses.select("at", "set_cookie", url.parsed(F.col("url")).alias("u")).select("at", "u", F.posexplode(F.when(F.col("u.ok"), F.col("set_cookie"))).alias("seq", "h"))
    cut = rows.select("at", "seq", F.regexp_replace("u.host", ":[0-9]+$", "").alias("host"), F.split("h", ";").alias("s")).select("at", "seq", "host", F.trim(F.get("s", F.lit(0))).alias("first"), F.slice("s", F.lit(2), F.size("s")).alias("attributes"))
    last = lambda name: F.try_element_at(F.filter(_named(F.col("attributes"), name), lambda v: v != ""), F.lit(-1))
    age = F.try_element_at(F.filter(F.transform(_named(F.col("attributes"), "max-age"), lambda v: F.regexp_extract(v, r"^[+-]?\d{1,12}", 0)), lambda v: v != ""), F.lit(-1)).cast("long")
    until = F.get(F.filter(F.transform(_named(F.col("attributes"), "expires"), _date), lambda v: v.isNotNull()), F.lit(0))
    told = cut.where("instr(first, '=') > 1").select(
        "at", "seq", "host", F.trim(F.substring_index("first", "=", 1)).alias("name"), F.trim(F.substr("first", F.instr("first", "=") + 1)).alias("value"),
        F.coalesce(F.nullif(F.lower(F.regexp_replace(last("domain"), r"^\.", "")), F.lit("")), "host").alias("domain"), F.coalesce(last("path"), F.lit("/")).alias("path"),
        F.when(age <= 0, F.lit(0)).when(age.isNotNull(), F.col("at") + age * 1000).otherwise(until).alias("expires"),
    )
    return told.where("expires is null or expires > at")


def _domains(host: Column) -> Column:
    """The domains that a host is in."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


@lru_cache(1 << 12)
def _reach(host: str, path: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """The cookie paths that an address is in, the longest first, and for each its cells: the domains that it is in, and the path."""
    labels, segments = host.split("."), path.split("/")
    domains = [".".join(labels[i:]) for i in range(len(labels))]
    upto = ["/".join(segments[:i]) for i in range(1, len(segments) + 1)]
    paths = {p for p in [*(p + "/" for p in upto[:-1]), *upto] if p}
    return [(p, [(d, p) for d in domains]) for p in sorted(paths, key=len, reverse=True)]


class _Cell:
    """The cookies of a domain and path, in the order that they were set in, and what has changed lately."""

    def __init__(self):
        self.texts, self.since, self.log, self.before = {}, {}, [], 0  # before: changes that were taken out of the log

    def change(self, n: int, cookie: tuple, text: str | None) -> None:
        self.texts.pop(cookie, None)
        self.since.pop(cookie, None)
        if text is not None:
            self.texts[cookie], self.since[cookie] = text, n
        self.log.append((n, cookie, text))
        if len(self.log) > 1000 + 2 * len(self.texts):
            self.before += len(self.log)
            self.log = []


class _Jar:
    """What is held as time goes on.

    Cookies of a path that several domains of a host have are merged once, and again only
    where they have changed.
    """

    def __init__(self):
        self._cells, self._ends, self._changes, self._merged, self._size, self._room = {}, [], 0, {}, 0, 1000

    def _change(self, cell: tuple[str, str], cookie: tuple, text: str | None) -> None:
        self._changes += 1
        self._cells.setdefault(cell, _Cell()).change(self._changes, cookie, text)

    def _holds(self, cell: tuple[str, str], cookie: tuple, n: int) -> bool:
        return self._cells[cell].since.get(cookie) == n

    def set(self, domain: str, path: str, host: str, text: str, expires: int | None) -> None:
        cell, cookie = (domain, path), (domain, host, text.partition("=")[0])
        self._change(cell, cookie, text)
        if expires is not None:
            heapq.heappush(self._ends, (expires, self._changes, cell, cookie))
            if len(self._ends) > self._room:  # most of them were replaced
                self._ends = [(e, n, cell, c) for e, n, cell, c in self._ends if self._holds(cell, c, n)]
                heapq.heapify(self._ends)
                self._room = 1000 + 2 * len(self._ends)

    def header(self, host: str, path: str, at: int) -> str:
        while self._ends and self._ends[0][0] <= at:
            _, n, cell, cookie = heapq.heappop(self._ends)
            if self._holds(cell, cookie, n):
                self._change(cell, cookie, None)
        lines = []
        for of, cells in _reach(host, path):
            found = [c for c in map(self._cells.get, cells) if c]
            if found:
                lines.extend((found[0].texts if len(found) == 1 else self._together(host, of, found)).values())
        return "; ".join(lines)

    def _together(self, host: str, path: str, cells: list[_Cell]) -> dict[tuple, str]:
        """Texts of several cells' cookies, in the order that they were set in."""
        texts, seen = self._merged.get((host, path), ({}, []))
        if len(seen) < len(cells) or any(n < c.before for n, c in zip(seen, cells)):
            texts = {k: t for _, k, t in sorted((n, k, c.texts[k]) for c in cells for k, n in c.since.items())}
            self._size += len(texts)
            if self._size > HELD:
                self._merged, self._size = {}, len(texts)
        else:
            for _, cookie, text in sorted(x for n, c in zip(seen, cells) for x in c.log[n - c.before :]):
                texts.pop(cookie, None)
                if text is not None:
                    texts[cookie] = text
        self._merged[host, path] = texts, [c.before + len(c.log) for c in cells]
        return texts


def _go_through(key: str):
    """Headers of requests, from rows in the order of part, time, and requests before sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, jar = None, _Jar()
        for batch in batches:
            asker = batch.column("asker").filter(pc.equal(batch.column("kind"), 0))
            headers, size, sent = [], 0, 0
            for p, at, kind, domain, path, host, text, expires in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "kind", "domain", "path", "host", "text", "expires"))):
                if p != part:
                    part, jar = p, _Jar()
                if kind:
                    jar.set(domain, path, host, text, expires)
                    continue
                headers.append(jar.header(domain, path, at) if domain else "")
                size += len(headers[-1])
                if size > BYTES:
                    yield pa.RecordBatch.from_arrays([asker.slice(sent, len(headers)), pa.array(headers, pa.string())], [key, "cookie"])
                    sent, headers, size = sent + len(headers), [], 0
            yield pa.RecordBatch.from_arrays([asker.slice(sent, len(headers)), pa.array(headers, pa.string())], [key, "cookie"])

    return each


def _number(responses: DataFrame) -> int:
    """About how many cookies are set, without parsing addresses: by host, name and attributes but for times."""
    host, rest = F.regexp_extract("url", r"\A[^/?#]*//([^/?#]*)", 1), F.regexp_replace("h", r"(?i)\A([^;=]*)=[^;]*|;\s*(?:max-age|expires)[^;]*", "$1")
    return responses.select("url", F.explode("set_cookie").alias("h")).agg(F.approx_count_distinct(F.xxhash64(host, rest))).first()[0]


def headers(requests: DataFrame, responses: DataFrame, key: str = "id") -> DataFrame:
    """key and cookie, the header of every request: those with longer paths first, then those set first; empty for none.

    requests: key, url, at; responses: url, at, set_cookie.  A request carries what was
    set before its own time and hasn't run out by then.  Addresses that aren't any carry
    nothing; null times are no times.  Responses are read several times.
    """
    spark = requests.sparkSession
    n = parts(spark)
    responses = responses.where("at is not null")
    cookies = _number(responses)
    groups = 1 + cookies // MOST
    # Dealt by ranges, so that a task has few stretches, and sends few rows of what these ended with.
    told = parsed(responses.repartitionByRange(n, "at", "url")).withColumn("text", F.concat("name", F.lit("="), "value"))
    asked = requests.select(key, "at", "url").repartitionByRange(n, key).select(F.col(key).alias("asker"), F.col("at").cast("long").alias("at"), url.parsed(F.col("url")).alias("u"))
    # No column that is made of addresses is null, or that would be asked before rows are dealt out, and parse every address there.
    usable = F.col("u.ok") & F.col("at").isNotNull()
    asked = asked.select("asker", "at", F.coalesce(F.when(usable, F.regexp_replace("u.host", ":[0-9]+$", "")), F.lit("")).alias("domain"), F.when(F.col("u.path") == "", F.lit("/")).otherwise(F.col("u.path")).alias("path"))
    if groups == 1:
        asked, sets = asked.withColumn("dealt", F.lit(0)), told.withColumn("dealt", F.lit(0))
        times = requests.select(F.lit(0).alias("dealt"), "at").unionByName(responses.select(F.lit(0).alias("dealt"), "at"))
    else:
        asked, sets = _dealt(asked, told, groups)
        times = asked.select("dealt", "at").unionByName(sets.select("dealt", "at"))
    # Numbers: at most n for each group.
    spread = times.where("at is not null").groupBy("dealt").agg(F.count("at"), F.percentile_approx("at", [i / n for i in range(1, n)], 1000)).collect()
    stretches, total = [], 0
    for group, rows, at in spread:
        many = max(1, min(n, rows // max(ROWS, 4 * cookies // groups)))  # what is carried over is a quarter of the rows at most
        cuts = sorted({int(at[i * n // many - 1]) for i in range(1, many)})
        stretches.append({"dealt": group, "first": total, "final": total + len(cuts), "cuts": cuts})
        total += len(cuts) + 1
    total = max(1, total)
    cut = F.broadcast(spark.createDataFrame(pa.Table.from_pylist(stretches, _CUT)))
    place = lambda rows: rows.join(cut, "dealt", "left").withColumn("part", F.col("first") + F.size(F.filter("cuts", lambda c: c < F.col("at"))))

    sets = place(sets)
    last = F.max(F.struct("at", "seq", "text", "expires")).alias("set")
    ends = sets.where("part < final").groupBy("dealt", "final", "part", *_COOKIE).agg(last)
    # What a stretch ended with holds in those up to and with the next one that has any.
    to = F.coalesce(F.lead("part").over(W.partitionBy("dealt", *_COOKIE).orderBy("part")), "final")
    carried = ends.select("set.*", *_COOKIE, "part", to.alias("to")).withColumn("part", F.explode(F.sequence(F.col("part") + 1, F.col("to"))))
    columns = ["part", "at", "seq", "domain", "path", "host", "text", "expires"]
    given = sets.select(*columns).unionByName(carried.select(*columns)).withColumn("kind", F.lit(1))
    # Requests without a time wait for nothing and are dealt out.
    part = F.when(F.col("at").isNull() | F.col("part").isNull(), F.pmod(F.xxhash64("asker"), F.lit(total)).cast("int")).otherwise(F.col("part"))
    rows = place(asked).select(part.alias("part"), "at", F.lit(0).alias("kind"), "domain", "path", "asker").unionByName(given, allowMissingColumns=True)
    # A request comes before what is set at its own time.
    dealt = rows.repartitionById(min(total, 4 * n), "part").sortWithinPartitions("part", "at", "kind", "seq", "domain", "host", "text", "expires")
    return dealt.mapInArrow(_go_through(key), T.StructType([T.StructField(key, requests.schema[key].dataType), T.StructField("cookie", T.StringType())]))


def _dealt(asked: DataFrame, told: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """Requests and sets with the group (dealt) that they meet in; a set is in each that has requests for its domain.

    Hosts go by site, their last two labels; those of a site with more than MOST cookies by
    themselves, and a host with as many by the first segment of paths.
    """
    site, segment = (lambda host: F.substring_index(host, ".", -2)), F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit("")).alias("segment")
    told = keep(told)
    names = told.select(F.explode(F.array_distinct(F.array(site(F.col("domain")), "domain"))).alias("of"), F.xxhash64(*_COOKIE).alias("h"))
    large = [r["of"] for r in names.groupBy("of").agg(F.approx_count_distinct("h").alias("n")).where(F.col("n") > MOST).collect()]  # two for MOST cookies at most
    host = F.col("domain")
    by = F.when(~site(host).isin(large), site(host)).when(~host.isin(large), host).otherwise(F.concat(host, F.lit("/"), segment))
    asked = asked.withColumn("dealt", F.coalesce(F.pmod(F.xxhash64(by), F.lit(groups)).cast("int"), F.lit(0)))
    cells = F.flatten(F.transform(_domains(host), lambda d: F.transform(F.array_distinct(F.array(F.lit(""), "segment")), lambda s: F.struct(d.alias("domain"), s.alias("segment")))))
    reach = keep(asked.select("domain", segment, "dealt").distinct().select(F.explode(cells).alias("cell"), "dealt").select("cell.*", "dealt").distinct())
    return asked, told.withColumn("segment", segment).join(reach, ["domain", "segment"])
