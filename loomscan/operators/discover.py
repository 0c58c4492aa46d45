"""Discovery: the link graph of scripts and pages, walked to a fixpoint in breadth-first rounds.

Any number of scans run at once: every table carries the column scan.  A round is one
pass over the frontier's responses, which gives the round's findings, and one step from
findings to the next frontier: resolved, without what was seen, within the budget and
numbered.  Both are kept in the shared folder; all other state is a union of the
rounds' tables.  Order is explicit, so provenance and budgets don't depend on timing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscan.functions import content, scanners, url
from loomscan.operators.extract import Extractor, Registry, extract, gated, tagged
from loomscan.sources.shared import Grown, keep, shared_folder

__all__ = ["Result", "bare_names", "budgeted", "claim", "discover", "fetch", "keep", "resolve_fragments", "route", "shared_folder", "suffix_join"]

PAGE_BUDGET = 64
# Files that are looked for at the root of a site whose scripts name no others.
FALLBACK = ("emp.json", "emp-stats.json")
#: The request that asks a page for its flight payload.
FLIGHT = "RSC"
_ORDER = ["seq", "inline", "plugin_idx", "rank", "pos", "alt"]


def fetch(frontier: DataFrame, responses: DataFrame) -> DataFrame:
    """frontier's rows with their response; status and text are null where there is none.

    responses: url, status, content_type, text, and optionally final_url, headers, and
    request, which tells answers to requests with a header or another method apart: null
    or empty for plain ones.  A frontier with a column request meets those of its own.
    Where responses have a column scan, an answer with a scan is that scan's alone and goes
    before the ones without.
    """
    r = answers(responses)
    if "request" in frontier.columns:
        return _met(frontier, r, ["url", "request"], "left")
    return _met(frontier, r.where("request = ''").drop("request"), ["url"], "left")


def answers(responses: DataFrame) -> DataFrame:
    """responses by the key of their address, with all columns that they may have, and only, where they have a scan."""
    have = set(responses.columns)
    return responses.select(
        *([F.col("scan").alias("only")] if "scan" in have else []),
        url.normalize(F.col("url")).alias("url"), "status", "content_type", "text",
        (F.col("final_url") if "final_url" in have else F.lit(None).cast("string")).alias("final_url"), (content.lower_keys(F.col("headers")) if "headers" in have else F.lit(None).cast("map<string,string>")).alias("headers"),
        (F.coalesce("request", F.lit("")) if "request" in have else F.lit("")).alias("request"),
    )


def _met(rows: DataFrame, answered: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with what is there for their keys: for their own scan, or else for all scans."""
    if "only" not in answered.columns:
        return rows.join(answered, keys, how)
    own = answered.where("only is not null").withColumnRenamed("only", "scan")
    rest = rows.join(own.select("scan", *keys).distinct(), ["scan", *keys], "left_anti").join(answered.where("only is null").drop("only"), keys, how)
    return rows.join(own, ["scan", *keys]).unionByName(rest)


def route(fetched: DataFrame) -> DataFrame:
    """Successful responses with kind, and role: script, document, map, flight or dropped.

    An HTML body at a script's address is an error page, unless it is empty.  An answer
    to a request for a flight payload is one, unless it is HTML without any.
    """
    ok = fetched.where("status between 200 and 299")
    ok = ok.withColumn("url", F.coalesce(url.normalize(F.nullif("final_url", F.lit(""))), "url")).withColumn("kind", content.kind(F.col("content_type"), F.col("text")))
    page = (F.col("kind") == "html") & url.is_static(F.col("url"))
    role = F.when(page & (F.coalesce(F.length("text"), F.lit(0)) == 0), "script").when(page, "dropped").when(url.is_map(F.col("url")), "map").when(F.col("kind") == "js", "script").otherwise("document")
    if "request" in fetched.columns:
        asked = F.col("request") == FLIGHT
        role = F.when(asked & (F.col("kind") == "html") & ~F.coalesce(F.left("text", F.lit(2000)).contains("I["), F.lit(False)), "dropped").when(asked, "flight").otherwise(role)
        return ok.withColumn("role", role).withColumn("kind", F.when(F.col("role") == "flight", "flight").otherwise(F.col("kind")))
    return ok.withColumn("role", role)


def claim(candidates: DataFrame, seen: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, by order, of each key that wasn't seen."""
    first = F.min_by(F.struct(*(c for c in candidates.columns if c not in keys)), F.struct(*order)).alias("x")
    return candidates.groupBy(*keys).agg(first).select(*keys, "x.*").join(seen.select(*keys), keys, "left_anti")


def budgeted(pages: DataFrame, used: DataFrame, budget: int = PAGE_BUDGET, order: list[str] | None = None) -> DataFrame:
    """The first pages, by order, that a scan's budget still allows; used: (scan, used).

    No scan's sort takes more than `budget` rows of each task.
    """
    rank = F.row_number().over(W.partitionBy("scan").orderBy(*(order or _ORDER)))
    first = pages.withColumn("_rank", rank).where(F.col("_rank") <= budget)
    return first.join(used, "scan", "left").where(F.col("_rank") <= budget - F.coalesce("used", F.lit(0))).drop("_rank", "used")


def _within_budget(new: DataFrame, pages: DataFrame | None, budget: int) -> DataFrame:
    """new without the pages that the budget of their scan doesn't allow any more; other rows aren't ranked among them."""
    html = F.col("page") == "html"
    lane = F.when(html, F.lit(-1)).otherwise(F.pmod(F.xxhash64("url"), F.lit(SPREAD)))
    ranked = new.withColumn("_rank", F.row_number().over(W.partitionBy("scan", lane).orderBy(*_ORDER)))
    if pages is not None:
        ranked = ranked.join(pages.groupBy("scan").agg(F.count("*").alias("_used")), "scan", "left")
    allowed = F.lit(budget) - (F.coalesce("_used", F.lit(0)) if pages is not None else F.lit(0))
    return ranked.where(~html | (F.col("_rank") <= allowed)).select(*new.columns)


def numbered(rows: DataFrame, order: list[str], start: int) -> tuple[DataFrame, int]:
    """rows with seq from start on in their order, and how many there are.

    Sorted over all tasks; of each one only the number of its rows comes to the driver.
    """
    place = F.monotonically_increasing_id()
    held = keep(rows.orderBy(*order).withColumns({"_task": F.shiftright(place, 33).cast("int"), "_row": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes, before, offsets = {r["_task"]: r["n"] for r in held.groupBy("_task").agg(F.count("*").alias("n")).collect()}, start, []
    for task in sorted(sizes):
        offsets += [F.lit(task), F.lit(before)]
        before += sizes[task]
    base = F.create_map(*offsets)[F.col("_task")] if offsets else F.lit(start)
    return held.withColumn("seq", (base + F.col("_row")).cast("long")).drop("_task", "_row"), before - start


#: Into how many tasks the rows of one scan are dealt where they meet few others of it.
SPREAD = 16


def _each_with_each(many: DataFrame, few: DataFrame) -> DataFrame:
    """Rows of one scan, each with each; the many are dealt into SPREAD parts, and the few go to every one."""
    dealt = many.withColumn("_deal", F.pmod(F.xxhash64(*many.columns), F.lit(SPREAD)).cast("int"))
    return dealt.join(few.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["scan", "_deal"]).drop("_deal")


def suffix_join(fragments: DataFrame, known: DataFrame) -> DataFrame:
    """scan, fragment, candidate: for every known directory that ends in the fragment's directory.

    A plain suffix, not cut at segments.  Written as an equality join on all suffixes of
    the distinct known directories; known: scan, url.
    """
    cut = fragments.withColumn("_file", F.substring_index("fragment", "/", -1)).withColumn("_dir", F.expr("substring(fragment, 1, length(fragment) - length(_file) - 1)"))
    dirs = known.select("scan", url.directory(F.col("url")).alias("dir")).where("dir <> ''").distinct()
    bare = F.regexp_replace("dir", "/$", "")
    ends = dirs.withColumn("bare", bare).select("scan", "dir", F.explode(F.transform(F.sequence(F.lit(1), F.length("bare")), lambda i: F.substr("bare", i))).alias("_dir"))
    return cut.where("_dir <> '' and _file <> ''").join(ends, ["scan", "_dir"]).select(*fragments.columns, url.join(F.col("dir"), F.col("_file")).alias("candidate"))


def resolve_fragments(fragments: DataFrame, known: DataFrame, prepends: DataFrame, publics: DataFrame, starts: DataFrame) -> DataFrame:
    """All addresses that path fragments may mean; fragments: scan, fragment, from_url, .., known: scan, url.

    prepends: scan, prefix, publics: scan, path, seq, starts: scan, start.  An absolute
    public path's origin holds for the public paths after it, too.
    """
    real = fragments.where(~F.col("fragment").rlike(r"-\*\.(js|css)$"))
    cols = real.columns
    suffix = suffix_join(real, known)
    before = _each_with_each(real, prepends.select("scan", "prefix")).select(*cols, url.join(F.col("prefix"), F.col("fragment")).alias("candidate"))
    absolute = url.is_http(F.col("path"))
    sticky = publics.withColumn("_own", F.when(absolute, url.origin(F.col("path")))).withColumn("_origin", F.last("_own", ignorenulls=True).over(W.partitionBy("scan").orderBy("seq")))
    rest = F.when(absolute, F.regexp_replace("path", r"^[^:]+://[^/]*", "")).otherwise(F.col("path"))
    under = _each_with_each(real, sticky.select("scan", "_origin", rest.alias("_path"))).select(*cols, url.join(F.concat(F.coalesce("_origin", url.origin(F.col("from_url"))), F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path"))), F.col("fragment")).alias("candidate"))
    own = real.join(starts, "scan").select(*cols, url.join(url.origin(F.col("start")), F.col("fragment")).alias("candidate"))
    rooted = real.where("fragment like '/%'").select(*cols, F.concat(url.origin(F.col("from_url")), F.col("fragment")).alias("candidate"))
    return suffix.unionByName(before).unionByName(under).unionByName(own).unionByName(rooted).where("candidate <> ''").distinct()


def bare_names(names: DataFrame, prepends: DataFrame) -> DataFrame:
    """A bare file name beside its document and under every prefix."""
    beside = names.select(*names.columns, F.concat(url.directory(F.col("from_url")), F.col("fragment")).alias("candidate")).where(url.directory(F.col("from_url")) != "")
    under = _each_with_each(names, prepends.select("scan", "prefix")).select(*names.columns, F.concat(F.regexp_replace("prefix", "/?$", "/"), F.col("fragment")).alias("candidate"))
    return beside.unionByName(under)


@dataclass
class Result:
    """Tables of a finished discovery.

    js_entries: scan, url, from_url, plugin, is_inline, seq.  html_entries: pages entered
    by links.  edges: every address that was asked for, by request.  findings: scan, seq,
    inline, from_url, plugin, type and value of everything that was found.  maps: scan,
    url (of a script), map_url.  failed: scan, start and status of starts without a
    successful response.  starts: scan, start, where it led to.
    """

    js_entries: DataFrame
    html_entries: DataFrame
    edges: DataFrame
    findings: DataFrame
    maps: DataFrame
    failed: DataFrame
    starts: DataFrame
    responses: DataFrame

    def summary(self) -> DataFrame:
        return self.js_entries.groupBy("scan").agg(F.count("*").alias("js_count"))


def _itself(role: Column) -> Extractor:
    """An extractor that tells what a document is, as a finding of type self; inline scripts are none."""
    return lambda d: gated((role != "inline", tagged("self", F.array(role))))


def _parts(answered: DataFrame, *keys: str) -> DataFrame:
    """Answered requests as documents and the scripts within them: keys, url, kind, text, headers, role, inline."""
    docs = route(answered).where("role <> 'dropped'")
    whole = F.array(F.struct(F.lit(-1).alias("inline"), "kind", F.when(F.col("role") != "map", F.col("text")).otherwise(F.lit("")).alias("text"), F.col("role").alias("role")))
    within = scanners.inline_scripts(F.when((F.col("kind") == "html") & (F.col("role") == "document"), F.col("text")))
    inner = F.transform(within, lambda t, i: F.struct(i.alias("inline"), F.lit("js").alias("kind"), t.alias("text"), F.lit("inline").alias("role")))
    parts = F.concat(whole, F.filter(F.coalesce(inner, F.array().cast("array<struct<inline:int,kind:string,text:string,role:string>>")), lambda x: x["text"] != ""))
    return docs.select(*keys, "url", "headers", F.explode(parts).alias("x")).select(*keys, "url", "headers", "x.*")


def _found(docs: DataFrame, registry: Registry, *keys: str) -> DataFrame:
    extractors = Registry({"": _itself(F.col("role")), **dict(registry.items())})
    return extract(docs, extractors, keep=(*keys, "inline", "role")).withColumnRenamed("url", "from_url").drop("role")


def edge_table(responses: DataFrame, registry: Registry | None = None) -> DataFrame:
    """asked, request, inline, from_url, plugin, plugin_idx, type, value, pos: what every response refers to.

    One pass over all responses without a join, whatever scans reach them; a walk over it
    reads no response again.  Held by the address that was asked for.
    """
    given = answers(responses)
    keys = ["asked", "request", *(["only"] if "only" in given.columns else [])]
    docs = _parts(given.withColumn("asked", F.col("url")), *keys)
    return keep(_found(docs, registry or Registry(), *keys).repartition("asked"))


def discover(starts: DataFrame, responses: DataFrame, registry: Registry | None = None, budget: int = PAGE_BUDGET, max_rounds: int | None = None, edges: DataFrame | None = None, by_round: bool = False) -> Result:
    """Walks from starts (scan, start) over captured responses until nothing new turns up.

    js_entries come in order of discovery with the first provenance; html_entries are at
    most budget for each scan.  A scan whose start leads elsewhere goes on from there.  A
    start without a successful response yields nothing and is among failed.  Of several
    starts of one scan the first one is what loopback addresses stand for.  max_rounds is
    for tests: where it is reached with work left, RuntimeError is raised.

    What responses refer to is extracted once, from all of them (edges: an `edge_table` of
    these responses and this registry that is there already), and rounds are joins with
    it.  by_round: documents are read and extracted round by round as they are reached,
    which is less work where most responses are out of reach.  Scans in which a runtime's
    mark has been found go on by rounds, since their documents say more from then on.
    """
    registry = registry or Registry()
    if edges is None and not by_round:
        edges = edge_table(responses, registry)
    ahead = {r.type for r in edges.select("type").distinct().collect()} if edges is not None else None  # of a closed set
    to_key = url.key_of(url.moved_from_loopback(F.col("url"), F.col("_origin")))  # extraction has given hosts their form
    members = url.combo_members(F.col("value"))
    spark, scan_type = starts.sparkSession, starts.schema["scan"].dataType.simpleString()
    none = lambda schema: spark.createDataFrame([], f"scan {scan_type}, {schema}")
    first = starts.select("scan", F.col("start").alias("_start"), url.normalize(F.col("start")).alias("url"), F.lit(None).cast("string").alias("from_url"), F.lit("CLI").alias("plugin"), F.lit(False).alias("is_inline"), F.lit("").alias("page"), F.lit("").alias("request"))
    frontier, n = numbered(first, ["scan", "_start"], 1)
    asked, entered = frontier.select("scan", F.col("_start").alias("start"), "url", "seq"), frontier
    frontier = frontier.drop("_start")
    ways, findings, pages, seen, names, fresh = Grown(), Grown(), Grown(), Grown(), Grown(), Grown()
    base, places, marks = None, None, None
    rounds, fallback, offset = 0, False, 1 + n
    while True:
        if max_rounds is not None and rounds >= max_rounds and n:
            raise RuntimeError(f"{n} addresses are left after {max_rounds} rounds")
        rounds += 1
        kinds: set[str] = set()
        if n:
            ways.add(frontier)
            seen.add(frontier.select("scan", "request", "url"))
            asking = frontier.select("scan", "seq", "url", F.col("url").alias("asked"), "request")
            parts = []
            if edges is not None:
                plain = asking if marks is None else asking.join(marks, "scan", "left_anti")
                parts.append(_met(plain.drop("url"), edges, ["asked", "request"]).drop("request"))
            if edges is None or marks is not None:
                docs = _parts(fetch(asking if edges is None else asking.join(marks, "scan", "left_semi"), responses), "scan", "seq", "asked")
                parts.append(_found(docs if marks is None else docs.join(marks, "scan", "left"), registry, "scan", "seq", "asked"))
            found = keep(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
            findings.add(found)
            kinds = ahead if ahead is not None and marks is None else {r.type for r in found.select("type").distinct().collect()}
            seen.add(found.where("type = 'self' and asked <> from_url").select("scan", F.lit("").alias("request"), F.col("from_url").alias("url")))
            if base is None:  # where the starts led to
                led = found.where("type = 'self'").select("scan", "seq", F.col("from_url").alias("led"))
                places = keep(asked.join(led, ["scan", "seq"]).select("scan", F.col("led").alias("start"), "seq"))
                base = keep(places.groupBy("scan").agg(F.min_by("start", "seq").alias("start")).select("scan", url.origin(F.col("start")).alias("_origin")))
            if "mark" in kinds:
                known = findings.table().where("type = 'mark'").groupBy("scan").agg(F.min_by("value", "seq").alias("mark"))
                marks = keep(known)
            rank = F.when(F.col("type") == "url", 0).when(F.col("type") == "probe", 1).otherwise(2)
            found = found.withColumns({"rank": rank, "alt": F.lit(0).cast("long")})
            row = ["scan", "from_url", "plugin", *_ORDER]
            as_page = lambda p, r="": (F.lit(p).alias("page"), F.lit(r).alias("request"))
            direct = found.where("type = 'url'").select(*row, F.explode(members).alias("url"), *as_page(""))
            further = found.where("type in ('html', 'json')").select(*row, F.col("value").alias("url"), F.when(F.col("type") == "html", "html").otherwise("").alias("page"), F.lit("").alias("request"))
            candidates = direct.unionByName(further)
            if "request" in kinds:
                candidates = candidates.unionByName(found.where("type = 'request'").select(*row, F.col("value").alias("url"), *as_page("", FLIGHT)))
            if "load" in kinds and "chunk" in kinds:
                found = found.unionByName(_hashed(found, findings.table()).select(*found.columns))
            if "probe" in kinds or "load" in kinds:
                probes = found.where("type = 'probe'").withColumnRenamed("value", "fragment").select("fragment", *row)
                probes = keep(claim(probes, none("fragment string") if names.empty else names.table(), ["scan", "fragment"], _ORDER))
                names.add(probes.select("scan", "fragment"))
                fresh.add(probes.where("fragment like '%/%' and fragment not like '%://%'"))
                candidates = candidates.unionByName(probes.where("fragment like '%://%'").select(*row, F.col("fragment").alias("url"), *as_page("")))
                candidates = candidates.unionByName(bare_names(probes.where("fragment not like '%/%'"), _prefixes(findings)).select(*row, F.col("candidate").alias("url"), *as_page("")))
        elif not fresh.empty:
            pending, fresh = fresh.table(), Grown()
            known = findings.table().where("type = 'self' and value = 'script'").select("scan", F.col("from_url").alias("url")).distinct()
            publics = findings.table().where("type = 'public'").groupBy("scan", F.col("value").alias("path")).agg(F.min("seq").alias("seq"))
            made = resolve_fragments(pending.select("scan", "fragment", "from_url", "plugin", "seq"), known, _prefixes(findings), publics, places.select("scan", "start"))
            candidates = made.select("scan", "from_url", "plugin", "seq", F.lit(-1).alias("inline"), F.lit(0).alias("plugin_idx"), F.lit(1).alias("rank"), F.lit(0).alias("pos"), F.xxhash64("candidate").alias("alt"), F.col("candidate").alias("url"), F.lit("").alias("page"), F.lit("").alias("request"))
        elif not fallback and not findings.empty:
            fallback = True
            dynamic = findings.table().where("type in ('url', 'probe') and plugin <> 'HTMLScriptPlugin'").select("scan").distinct()
            usual = places.join(dynamic, "scan", "left_anti").select("scan", "start", F.posexplode(F.array(*(F.lit(f"/{x}") for x in FALLBACK))).alias("pos", "n"))
            candidates = usual.select("scan", F.lit(None).cast("string").alias("from_url"), F.lit("FallbackEmp").alias("plugin"), F.lit(0).cast("long").alias("seq"), F.lit(-1).alias("inline"), F.lit(0).alias("plugin_idx"), F.lit(0).alias("rank"), "pos", F.lit(0).cast("long").alias("alt"), F.concat(url.origin(F.col("start")), F.col("n")).alias("url"), F.lit("").alias("page"), F.lit("").alias("request"))
        else:
            break
        # base: one row a scan, with what a loopback address stands for.
        keyed = candidates.where("url not like 'data:%'").join(base, "scan").withColumn("url", to_key).drop("_origin")
        new = claim(keyed, seen.table(), ["scan", "request", "url"], _ORDER)
        if "html" in kinds:
            new = _within_budget(new, None if pages.empty else pages.table(), budget)
        frontier, n = numbered(new.select("scan", "url", "from_url", "plugin", (F.col("inline") >= 0).alias("is_inline"), "page", "request", *(F.col(c).alias(f"_{c}") for c in _ORDER)), ["scan", *(f"_{c}" for c in _ORDER), "url"], offset)
        frontier = frontier.drop(*(f"_{c}" for c in _ORDER))
        if "html" in kinds:
            pages.add(frontier.where("page = 'html'").select("scan", "url", "from_url", "plugin"))
        offset += n
    return _result(starts, asked, entered, ways, findings, pages, places, responses, none)


def _hashed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Names of chunks that a round's documents load without telling their hash, as probes.

    The hash is another document's, of the same scan and read before; of several that tell
    one the first counts.  The map grows with the rounds, and only new loads meet it: what
    is told later holds for later documents.
    """
    key = lambda rows: rows.withColumn("chunk", F.split_part("value", F.lit(" "), F.lit(1)))
    told = key(known.where("type = 'chunk'")).groupBy("scan", "chunk").agg(F.min(F.struct("seq", "inline", "pos", F.split_part("value", F.lit(" "), F.lit(2)).alias("hash"))).alias("m"))
    loads = key(found.where("type = 'load'")).join(told, ["scan", "chunk"]).where("m.seq < seq or m.seq = seq and m.inline < inline")
    name = F.concat(F.split_part("value", F.lit(" "), F.lit(2)), "chunk", F.lit("."), "m.hash", F.lit(".js"))
    return loads.withColumns({"value": name, "type": F.lit("probe")})


def _prefixes(findings: Grown) -> DataFrame:
    return findings.table().where("type = 'prepend'").select("scan", F.col("value").alias("prefix")).distinct()


def _result(starts: DataFrame, asked: DataFrame, entered: DataFrame, walked: Grown, findings: Grown, pages: Grown, places: DataFrame | None, responses: DataFrame, none) -> Result:
    """The tables of a finished walk."""
    ways = entered.drop("_start") if walked.empty else walked.table()
    if findings.empty:
        every = none("seq long, asked string, inline int, from_url string, plugin string, plugin_idx int, type string, value string, pos int")
    else:
        every = findings.table()
    own = every.where("type = 'self'").select("scan", "seq", F.col("from_url").alias("url"), F.col("value").alias("role"))
    came = ways.select("scan", "seq", "from_url", "plugin", "is_inline", F.col("url").alias("asked"), "request")
    met = own.join(came, ["scan", "seq"])
    js = met.where("role = 'script' and request = ''").groupBy("scan", "url").agg(F.min_by(F.struct("from_url", "plugin", "is_inline", "seq"), "seq").alias("x")).select("scan", "url", "x.*")
    told = every.where("type = 'map' and inline < 0").select("scan", F.col("from_url").alias("url"), F.col("value").alias("map_url"), "seq", "pos")
    fetched = met.where("role = 'map'").select("scan", F.col("from_url").alias("url"), F.col("url").alias("map_url"), "seq", F.lit(0).alias("pos")).where("url is not null")
    maps = told.unionByName(fetched).groupBy("scan", "url", "map_url").agg(F.min(F.struct("seq", "pos")).alias("_at")).select("scan", "url", "map_url", F.col("_at.seq").alias("seq"), F.col("_at.pos").alias("pos"))
    arrived = own.select("scan", "seq")
    lost = asked.join(arrived, ["scan", "seq"], "left_anti").select("scan", "start", "url")
    failed = fetch(lost, responses).select("scan", "start", "status")
    html = none("url string, from_url string, plugin string") if pages.empty else pages.table()
    return Result(js, html, ways.drop("page"), every, maps, failed, none("start string, seq long") if places is None else places, responses)
