"""URL functions as column expressions, for http(s) URLs after the WHATWG URL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomscan.functions import hosts, let

_URL = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
# Characters of a path that have to be percent-encoded.
_UNSAFE = r"[^\x21-\x7E]|[\"<>`{}^]"
_UNSAFE_SQL = r"r'[^\x21-\x7E]|[<>`{}^]|\x22'"
# Endings, and parts, of addresses of static resources.
STATIC_ENDINGS = [".js", ".mjs", ".jsonp", ".ts", ".tsx", ".vue", ".css", ".woff", ".woff2", ".ttf", ".svg", ".png", ".jpg"]
STATIC_PARTS = [".js", ".mjs", ".jsonp", ".tsx"]


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _URL, i)


def is_http(url: Column) -> Column:
    """Whether an address is absolute: http:// or https://, in lower case."""
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def parses(url: Column) -> Column:
    """Whether an address has a scheme and, for http(s), a host that is one."""
    return parsed(url)["ok"]


def _encoded(part: str, unsafe: str) -> str:
    """SQL: a part with what matches `unsafe` percent-encoded by its UTF-8 bytes."""
    each = rf"if(c rlike {unsafe}, replace(url_encode(c), '+', '%20'), c)"
    return rf"if({part} rlike {unsafe}, array_join(transform(split({part}, ''), c -> {each}), ''), {part})"


# Characters of a query that have to be percent-encoded, besides those of no ASCII.
_UNSAFE_QUERY = "r\"[^\\x21-\\x7E]|[<>']|\\x22\""
_SPLIT = r"r'(?s)\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z'"
_HOST_OF = r"regexp_extract(u, r'(?i)\Ahttps?://([^/?#]*)', 1)"
_WHOLE = r"r'(?i)\A(https?://[^/?#\s\\@:\[\]]+(:[0-9]{0,5})?|https?://\[[0-9a-fA-F:.]+\](:[0-9]{0,5})?)([/?#]|\z)'"
#: In an http address a backslash is a slash, and further slashes before the host don't count.
_SLASHED = r"if(u rlike r'(?i)\Ahttps?:[^?#]*\\', concat(regexp_replace(translate(regexp_extract(u, r'(?s)\A([^?#]*)', 1), chr(92), '/'), r'\A([A-Za-z]+:)/{3,}', '$1//'), regexp_extract(u, r'(?s)\A[^?#]*(.*)\z', 1)), if(u rlike r'(?i)\Ahttps?:///', regexp_replace(u, r'\A([A-Za-z]+:)/+', '$1//'), u))"


#: An address in which nothing has to be lower-cased, encoded or left out: no port, no query, no mark.
_PLAIN = r"r'\Ahttps?://[a-z0-9_.-]+(/[!$-;=@-\[\]_a-z|~]*)?\z'"
_PLAIN_PARTS = "named_struct('all', u, 'ok', true, 'scheme', substring_index(u, ':', 1), 'host', substring_index(substring_index(u, '/', 3), '/', -1), 'path', substr(u, length(substring_index(u, '/', 3)) + 1), 'query', '', 'mark', '')"


def _part_of(i: int) -> str:
    return f"regexp_extract(w, {_SPLIT}, {i})"


def _lambda() -> str:
    """SQL from an address to its parts; few lambdas within each other, each of which costs the analyser a round."""
    port = rf"regexp_extract({_part_of(2)}, r':([0-9]{{0,5}})\z', 1)"
    own = rf"{port} = '' or w rlike r'(?i)\A(https://[^/?#]*:0*443|http://[^/?#]*:0*80)([/?#]|\z)'"
    host = rf"concat(regexp_replace(lower({_part_of(2)}), r':[0-9]{{0,5}}\z', ''), if({own}, '', concat(':', cast(cast({port} as int) as string))))"
    fields = {"all": "u", "ok": rf"coalesce(w rlike {_WHOLE} and cast(coalesce(nullif({port}, ''), '0') as int) < 65536, false)", "scheme": f"lower({_part_of(1)})", "host": host, "path": _encoded(_part_of(3), _UNSAFE_SQL), "query": _encoded(_part_of(4), _UNSAFE_QUERY), "mark": _part_of(5)}
    each = hosts.let(_SLASHED, "w", "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")")
    return f"u -> if(u rlike {_PLAIN}, {_PLAIN_PARTS}, {each})"


def _hosted() -> str:
    """SQL from an address' parts to the same with the host in its shortest form, and not ok where it is none."""
    name, port = r"regexp_replace(p.host, r':[0-9]{0,5}\z', '')", r"regexp_extract(p.host, r'(:[0-9]{0,5})\z', 1)"
    same = "named_struct('all', p.all, 'ok', {ok}, 'scheme', p.scheme, 'host', {host}, 'path', p.path, 'query', p.query, 'mark', p.mark)"
    found = hosts.let(hosts.host(name), "x", same.format(ok="x is not null", host=f"if(x is null, p.host, concat(x, {port}))"))
    return f"p -> if(p.ok and {_odd('p.host')}, {found}, p)"


def _odd(host: str) -> str:
    """SQL: whether a host and its port may have another form."""
    return rf"not ({host} rlike r'\A[a-z0-9_-]+([.][a-z0-9_-]+)*(:[0-9]+)?\z' and not {host} rlike r'(\A|[.])(0x[0-9a-f]*|[0-9]+)[.]?(:[0-9]*)?\z')"


#: An address whose host is of small letters and digits and ends in no number.
_NOT_ODD = r"r'\Ahttps?://([a-z0-9_-]+[.])*[a-z_-][a-z0-9_-]*(:[0-9]+)?([/?#]|\z)'"
_CUT_UP, _HOSTED = _lambda(), _hosted()


def cut_up(url: Column) -> Column:
    """parsed, but for the host, which keeps its form."""
    return F.element_at(F.call_function("transform", F.array(url), F.expr(_CUT_UP)), 1)


def parsed(url: Column) -> Column:
    """all, ok, scheme, host, path, query and mark of an address.

    host: in its shortest form, with the port unless it is the scheme's own; path and
    query are percent-encoded.
    """
    return F.element_at(F.call_function("transform", F.array(cut_up(url)), F.expr(_HOSTED)), 1)


def hosted(url: Column) -> Column:
    """An address with its host in its shortest form; for addresses that are put together already."""
    again = lambda p: F.when(p["ok"], F.concat(_origin(p), p["path"], p["query"], p["mark"])).otherwise(p["all"])
    odd = F.expr(f"u -> not u rlike {_NOT_ODD} and {_odd(_HOST_OF)}")
    return F.when(is_http(url) & F.element_at(F.call_function("transform", F.array(url), odd), 1), let(parsed(url), again)).otherwise(url)


def _origin(p: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), p["host"])


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Host and port, in lower case, without a port that is the scheme's own."""
    return parsed(url)["host"]


def origin(url: Column) -> Column:
    """scheme://host[:port], empty for what isn't an http(s) address."""
    return let(parsed(url), origin_of)


def origin_of(p: Column) -> Column:
    """origin, of an address that is parsed already."""
    return F.when(p["ok"], _origin(p)).otherwise(F.lit(""))


def encode_path(path: Column) -> Column:
    """Percent-encodes what can't stand in a path, by its UTF-8 bytes."""
    each = F.transform(F.split(path, ""), lambda c: F.when(c.rlike(_UNSAFE), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(path.rlike(_UNSAFE), F.array_join(each, "")).otherwise(path)


def encode_query(query: Column) -> Column:
    """Percent-encodes what can't stand in a query."""
    return F.element_at(F.call_function("transform", F.array(query), F.expr(f"t -> {_encoded('t', _UNSAFE_QUERY)}")), 1)


def _resolved_dots(path: Column) -> Column:
    """Removes . and .. segments of an absolute path; a final one leaves a slash."""
    step = lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s)))
    kept = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    out = F.concat(F.lit("/"), F.regexp_replace(kept, r"\A/", ""), F.when(path.rlike(r"/\.\.?\z") & (kept != ""), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"/\.\.?(/|\z)"), out).otherwise(path)


def clean_path(path: Column) -> Column:
    """Without empty, . and .. segments and without a trailing slash; at least /."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    out = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    messy = path.rlike(r"//|/\z|/\.\.?(/|\z)")
    return F.when(path.isin("", "/"), path).when(messy, F.concat(F.lit("/"), F.array_join(out, "/"))).otherwise(path)


def resolve(base: Column, ref: Column) -> Column:
    """The address that ref means in a document at base; ref itself where that can't be told."""
    return hosted(resolve_at(parsed(base), ref))


def _cut(ref: Column) -> Column:
    """A reference without blanks around it, cut into path, query and mark."""
    clean = F.regexp_replace(F.regexp_replace(ref, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    part = lambda r, i: F.regexp_extract(r, r"(?s)\A([^?#]*)(\?[^#]*)?(#.*)?\z", i)
    cut = let(clean, lambda r: F.struct(r.alias("all"), F.replace(part(r, 1), F.lit("\\"), F.lit("/")).alias("path"), part(r, 2).alias("query"), part(r, 3).alias("mark")))
    whole = F.struct(ref.alias("all"), ref.alias("path"), F.lit("").alias("query"), F.lit("").alias("mark"))
    return F.when(~ref.rlike(r"[\x00-\x20\\?#]"), whole).otherwise(cut)


def _folder(path: Column) -> Column:
    """A path up to its last slash."""
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)))


#: A segment that can be neither . nor .. and in which nothing has to be encoded; one that isn't a scheme, either.
_SEGMENT, _FIRST = r"[!$--0-;=@-\[\]_a-z|~][!$-.0-;=@-\[\]_a-z|~]*+", r"[!$--0-9;=@-\[\]_a-z|~][!$-.0-9;=@-\[\]_a-z|~]*+"
_PLAIN_BASE = rf"\Ahttps?://[a-z0-9_.-]+/(?:{_SEGMENT}/)*+(?:{_SEGMENT})?+\z"


def _at(base: Column, ref: Column, end: str, other: Column) -> Column:
    """A reference of plain segments put to a plain base, where nothing has to be worked out; else other.  end: what may follow them."""
    rooted, below = rf"\A(?:/{_SEGMENT})++{end}\z", rf"\A(?:\./)?+{_FIRST}(?:/{_SEGMENT})*+{end}\z"
    plain = base["ok"] & base["all"].rlike(_PLAIN_BASE)
    return (
        F.when(ref.rlike(rf"\Ahttps?://[a-z0-9_.-]+(?:/{_SEGMENT})++{end}\z"), ref)
        .when(ref.rlike(rooted) & plain, F.concat(_origin(base), ref))
        .when(ref.rlike(below) & plain, F.concat(_origin(base), _folder(base["path"]), F.when(ref.startswith("./"), F.substr(ref, F.lit(3))).otherwise(ref)))
        .otherwise(other)
    )


def resolve_at(base: Column, ref: Column) -> Column:
    """resolve, for a base that is parsed already; the host keeps its form."""
    return _at(base, ref, "/?+", resolve_any(base, ref))


def resolve_any(base: Column, ref: Column) -> Column:
    """resolve_at, whatever base and reference are made of."""

    def whole(p: Column) -> Column:
        out = F.concat(_origin(p), _resolved_dots(F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])), p["query"], F.replace(p["mark"], F.lit(" "), F.lit("%20")))
        return F.when(p["ok"], out).otherwise(p["all"])

    def choose(b: Column, r: Column) -> Column:
        path, tail = r["path"], F.concat(encode_query(r["query"]), F.replace(r["mark"], F.lit(" "), F.lit("%20")))
        here = F.when(b["path"] == "", F.lit("/")).otherwise(b["path"])
        given = F.when(path.startswith("//"), F.concat(b["scheme"], F.lit(":"), path, r["query"], r["mark"])).otherwise(r["all"])
        rooted = F.when(path.startswith("/"), encode_path(path)).otherwise(F.concat(_folder(here), encode_path(path)))
        return (
            F.when(r["all"].rlike(r"(?i)\Ahttps?:[/\\]{2}") | (b["ok"] & path.startswith("//")), let(cut_up(given), whole))
            .when(r["all"].rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:") | ~b["ok"], r["all"])
            .when((path == "") & (r["query"] == ""), F.concat(_origin(b), here, b["query"], r["mark"]))
            .when(path == "", F.concat(_origin(b), here, tail))
            .otherwise(F.concat(_origin(b), _resolved_dots(rooted), tail))
        )

    return let(F.struct(base.alias("b"), _cut(ref).alias("r")), lambda x: choose(x["b"], x["r"]))


def _key(p: Column) -> Column:
    key = F.concat(_origin(p), F.when((p["path"] == "") & (p["query"] == ""), F.lit("")).when(p["path"] == "", F.lit("/")).otherwise(clean_path(p["path"])), p["query"])
    return F.when(p["ok"], key).otherwise(p["all"])


def normalize(url: Column) -> Column:
    """The key of a resource: no fragment, a clean path, lower-case host; a bare origin stays bare."""
    return let(parsed(url), _key)


def key_of(url: Column) -> Column:
    """normalize, for an address whose host has its form already: far less for the analyser to go through."""
    return let(cut_up(url), _key)


def normalize_at(base: Column, ref: Column) -> Column:
    """normalize of resolve_at, in one step, but for the host's form: the key has no dot segments and no mark whatever the address had."""
    return _at(base, ref, "", normalize_any(base, ref))


def normalize_any(base: Column, ref: Column) -> Column:
    """normalize_at, whatever base and reference are made of."""

    def choose(b: Column, r: Column) -> Column:
        path, all_ = r["path"], r["all"]
        here = F.when(b["path"] == "", F.lit("/")).otherwise(b["path"])
        folder = _folder(here)
        return (
            F.when(all_.rlike(r"(?i)\Ahttps?:[/\\]{2}"), all_)
            .when(b["ok"] & path.startswith("//"), F.concat(b["scheme"], F.lit(":"), path, r["query"]))
            .when(all_.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:") | ~b["ok"], all_)
            .when((path == "") & (r["query"] == ""), F.concat(_origin(b), here, b["query"]))
            .when(path == "", F.concat(_origin(b), here, r["query"]))
            .otherwise(F.concat(_origin(b), F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)), r["query"]))
        )

    return let(cut_up(let(F.struct(base.alias("b"), _cut(ref).alias("r")), lambda x: choose(x["b"], x["r"]))), _key)


def rebase_loopback(url: Column, start: Column) -> Column:
    """An address on a loopback host, moved to the origin of start; the rest is kept as spelled."""

    def moved(u: Column, p: Column, q: Column) -> Column:
        local = F.regexp_replace(p["host"], r":[0-9]*\z", "").isin("127.0.0.1", "localhost", "[::1]")
        elsewhere = (p["host"] != q["host"]) | (p["scheme"] != q["scheme"])
        return F.when(p["ok"] & local & q["ok"] & elsewhere, F.concat(_origin(q), F.regexp_extract(u, r"(?s)\A[^:]+://[^/]*(/.*)?\z", 1))).otherwise(u)

    return let(url, lambda u: let(parsed(u), lambda p: let(parsed(start), lambda q: moved(u, p, q))))


def moved_from_loopback(url: Column, origin: Column) -> Column:
    """An address on a loopback host, moved to an origin if that isn't empty."""
    parts = r"(?is)\Ahttps?://(?:127\.0\.0\.1|localhost|\[::1\])(?::[0-9]*)?(?=[/?#]|\z)"
    return F.when(url.rlike(parts) & (origin != ""), F.concat(origin, F.regexp_replace(url, parts, ""))).otherwise(url)


def directory(url: Column) -> Column:
    """The directory with its slash, empty for what isn't an address."""
    return let(parsed(url), directory_of)


def directory_of(p: Column) -> Column:
    """directory, of an address that is parsed already."""
    return F.when(p["ok"], F.concat(_origin(p), F.when(p["path"] == "", F.lit("/")).otherwise(_folder(p["path"])))).otherwise(F.lit(""))


def join(base: Column, path: Column) -> Column:
    """Base and path with one slash between them."""
    return F.when(path == "", base).otherwise(F.concat(F.regexp_replace(base, r"/\z", ""), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))


def combo_parts(url: Column) -> Column:
    """The files of a combo address (prefix??a,b) as spelled, or the address itself, as an array."""
    after = F.regexp_extract(url, r"(?s)\?\?(.*)\z", 1)
    prefix, files = F.substring_index(url, "??", 1), F.regexp_extract(after, r"(?s)\A([^?#]*)", 1)
    suffix = F.regexp_extract(after, r"(?s)\A[^?#]*(.*)\z", 1)
    names = F.filter(F.transform(F.split(files, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(url.contains("??") & (F.size(names) > 0), F.transform(names, lambda x: F.concat(prefix, x, suffix))).otherwise(F.array(url))


def combo_members(url: Column) -> Column:
    """combo_parts, those of a combo address normalised."""
    return F.when(url.contains("??") & url.rlike(r"\?\?\s*[^?#,\s]|\?\?[^?#]*,\s*[^?#,\s]"), F.transform(combo_parts(url), normalize)).otherwise(F.array(url))


def is_static(url: Column) -> Column:
    """Whether an address looks like a static resource: by its path's ending, or .js or the like anywhere."""
    path, whole = F.lower(F.regexp_extract(url, r"(?s)\A([^?#]*)", 1)), F.lower(url)
    out = F.lit(False)
    for e in STATIC_ENDINGS:
        out = out | path.endswith(e)
    for e in STATIC_PARTS:
        out = out | whole.contains(e)
    return F.coalesce(out, F.lit(False))


def is_map(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)\A([^?#]*)", 1)).endswith(".map"), F.lit(False))


def map_of(url: Column) -> Column:
    """The address of a script's source map: .map before the query."""
    return F.concat(F.substring_index(url, "?", 1), F.lit(".map"), F.when(url.contains("?"), F.regexp_extract(url, r"(?s)(\?.*)\z", 1)).otherwise(F.lit("")))
