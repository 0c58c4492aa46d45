"""Personal data in DataFrame operations: patterns, and weakly supervised further spans.

Patterns find what is surely of a kind.  Those spans are masked, and a wider pattern
looks for what else may be personal data in the rest: addresses that are spelled out,
numbers without a country's code, numbers that fail a check.  Labelers (shapes, lists,
context words) vote for or against each of all these candidates;
expectation-maximisation estimates how reliable they are from the votes alone, and a
linear classifier is fitted to the posterior labels.  Votes are added up before anything
is fitted, so the model comes from all candidates of all documents and what reaches the
driver is a table of vote patterns, of which there can be only so many.  Scans are a
single pass without shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.llm.graph import keep

KINDS = ["email", "ip", "card", "phone"]
_L = "A-Za-z0-9._%+\\-"
# A candidate begins where a run of its characters does, or right after the last one: so no run is read again from each of its places.
_EMAIL = rf"(?:(?<![{_L}])|\G)[{_L}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20\-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9\-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_AT, _DOT = r"(?:\(at\)|\[at\]|\{at\})", r"(?:\(dot\)|\[dot\]|\{dot\}|\.)"
#: Addresses with their signs spelled out, addresses of eight groups, and any numbers.
WIDE = (
    rf"(?<![{_L}])[{_L}]{{1,64}}+\x20?{_AT}\x20?[A-Za-z0-9\-]{{1,63}}+(?:\x20?{_DOT}\x20?[A-Za-z0-9\-]{{1,63}}+)++"
    rf"|(?<![{_L}])[{_L}]{{1,64}}+\x20at\x20[A-Za-z0-9\-]{{1,63}}+(?:\x20dot\x20[A-Za-z0-9\-]{{1,63}}+)++"
    r"|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
    r"|(?<![0-9A-Za-z.,+_/=#\-])\(?[0-9](?:[\x20()./\-]{0,2}[0-9])++(?![0-9A-Za-z_=])"
)
_MASK = ""

# Endings of host names, beginnings of cards' and telephone numbers.
_ENDINGS = r"(?i)[.\x20)\]}](?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|nl|be|ch|at|uk|us|ca|pl|se|pt|mx|ar)\z"
_ISSUERS = r"\A(?:4|5[1-5]|2[2-7]|3[47]|6)"
_CODES = r"\A\+(?:1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\A\(?0[1-9]"
_LOCAL = r"\A(?:0+|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.|\.0+\z"
# Words that announce a kind in English, French, German and Spanish.
_ANNOUNCE = {
    "email": r"mail|courriel|correo|contact|kontakt|contacto|write|schreib|écri|escrib",
    "ip": r"\bip|host|server|serveur|servidor|address|adress|dirección|client|login",
    "card": r"card|karte|carte|tarjeta|visa|master|amex|credit|kredit|crédit|crédito",
    "phone": r"tel|phone|fon\b|call|mobil|handy|fax|cell|whatsapp|appel|ruf|llam|móvil|contact|kontakt|contacto",
}
_OTHER = r"order|invoice|isbn|issn|version|build|ref|commit|sha|token|hash|total|price|page|seite|página|bestell|rechnung|commande|facture|pedido|factura|precio|preis|prix|nummer|número|numéro|number|serial|\bid|\bnr|\bno|date|datum|fecha|year|jahr|año|sku|article|artikel|artículo"
_GAP = r"[^\p{L}\p{N}]{0,4}(?:\p{L}{1,8}[^\p{L}\p{N}]{1,3})?\z"
_UNITS = r"\A\x20?(?i:%|€|\$|£|°|(?:eur|euros?|usd|dollars?|km|kg|mb|gb|kb|px|cm|mm|ms|bytes?|pages?|seiten|páginas)\b)"
_DATED = r"\A(?:[12][0-9]{3}[\-/.][01]?[0-9][\-/.][0-3]?[0-9]|[0-3]?[0-9][\-/.][01]?[0-9][\-/.][12][0-9]{3}|[12][0-9]{3}\x20?[\-/]\x20?[12][0-9]{3}|97[89][\x20\-]?[0-9][\x20\-]?[0-9].*)(?:\x20[0-9].*)?\z"
_NATIONAL = r"\A(?:\(0?[0-9]{2,5}\)[\x20\-]?[0-9]{3,4}[\x20\-]?[0-9]{2,5}|0[0-9]{1,4}[\x20/\-]{1,2}[0-9]{2,}(?:[\x20\-][0-9]{2,})*+|[2-9][0-9]{2}[\x20.\-][0-9]{3}[\x20.\-][0-9]{4}|0[1-9](?:[\x20.][0-9]{2}){4}|[6-9][0-9]{2}(?:\x20[0-9]{2,3}){2,3})\z"

#: The labelers, and how often each is believed to be right before any vote is seen.
VOTERS = {"shape": 0.97, "list": 0.8, "before": 0.8, "after": 0.8, "groups": 0.7, "digits": 0.7}
FEATURES = [*KINDS, *VOTERS, "n_digits", "n_marks"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


#: kind: pattern, what a text with a match holds, and what a match has to meet.
BASE: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column], Column]]] = {
    "email": (_EMAIL, lambda t: F.contains(t, F.lit("@")), lambda v: F.lit(True)),
    "ip": (_IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")),
    "card": (_CARD, lambda t: t.rlike(r"[0-9][\x20\-]?[0-9]"), lambda v: F.when(F.length(v) >= 13, F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v))).otherwise(False)),
    "phone": (_PHONE, lambda t: t.rlike(r"\+[0-9]"), lambda v: F.length(_digits(v)).between(9, 15)),
}
#: Places that are added up at once where starts are worked out.
_BLOCK = 64


def _cut(text: Column, pattern: str) -> Column:
    """v: the matches, left to right; g: what lies before, between and after them."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("g"))


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, v, b, a>>: matches with 40 characters before and 12 after them.

    A start is the sum of all lengths before it: those of whole blocks, then of the block.
    """
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)

    def sized(s: Column) -> Column:
        lengths = F.zip_with(s["g"], s["v"], lambda g, v: F.length(g) + F.coalesce(F.length(v), F.lit(0)))
        return _let(F.struct(s["v"].alias("v"), s["g"].alias("g"), lengths.alias("n")), blocked)

    def blocked(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["n"]) - 1) / _BLOCK).cast("int")), lambda k: add(F.slice(s["n"], k * _BLOCK + 1, F.lit(_BLOCK))))
        return _let(F.struct(s["v"].alias("v"), s["g"].alias("g"), s["n"].alias("n"), blocks.alias("t")), placed)

    def placed(s: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            start = add(F.slice(s["t"], F.lit(1), block)) + add(F.slice(s["n"], block * _BLOCK + 1, i % _BLOCK)) + F.length(s["g"][i])
            return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("v"), F.substring(s["g"][i], -40, 40).alias("b"), F.substring(s["g"][i + 1], 1, 12).alias("a"))

        return F.transform(s["v"], one)

    return _let(_cut(text, pattern), sized)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,v:string,b:string,a:string>>)")


def _base(text: Column, kind: str) -> Column:
    pattern, gate, valid = BASE[kind]
    return F.when(gate(text), F.filter(_spans(text, pattern), lambda s: valid(s["v"]))).otherwise(_none())


def _masked(text: Column) -> Column:
    """text with every base span replaced by as many signs that no pattern takes."""

    def hidden(pattern: str, gate: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Callable[[Column], Column]:
        one = lambda g, v: F.concat(g, F.when(v.isNull(), F.lit("")).when(valid(v), F.repeat(F.lit(_MASK), F.length(v))).otherwise(v))
        join = lambda s: F.array_join(F.zip_with(s["g"], s["v"], one), "")
        return lambda t: F.when(gate(t), _let(_cut(t, pattern), join)).otherwise(t)

    for pattern, gate, valid in BASE.values():
        text = _let(text, hidden(pattern, gate, valid))
    return text


def _wide_kind(v: Column) -> Column:
    n = F.length(_digits(v))
    return F.when(v.rlike(r"\A[^0-9(]*[A-Za-z]") & ~v.contains(":") | v.rlike(r"(?i)(?:\bat\b)"), F.lit("email")).when(v.contains(":"), F.lit("ip")).when(n.between(13, 19), F.lit("card")).when(n.between(7, 12), F.lit("phone"))


def _features(kind: Column, s: Column) -> Column:
    """The candidate's FEATURES as small integers."""
    v, b, a = s["v"], s["b"], s["a"]
    of = lambda **by: F.coalesce(*(F.when(kind == F.lit(k), c) for k, c in by.items()), F.lit(0))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)
    digits = _digits(v)
    n = F.length(digits)
    solid = v.rlike(r"\A[0-9]+\z")
    shape = of(
        email=vote(v.rlike(r"(?i)[.\x20)\]}][a-z]{2,24}\z") & (~v.contains(" at ") | v.rlike(_ENDINGS)), F.lit(True)), ip=F.lit(1), card=vote(n.between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), never), F.lit(True)),
        phone=vote((v.rlike(r"\A\+") | v.rlike(_NATIONAL)) & ~v.rlike(_DATED), v.rlike(_DATED) | ~n.between(7, 15)),
    )
    listed = of(email=vote(v.rlike(_ENDINGS), F.lit(True)), ip=vote(~v.rlike(_LOCAL), F.lit(True)), card=vote(digits.rlike(_ISSUERS), F.lit(True)), phone=vote(v.rlike(_CODES), v.rlike(r"\A\+")))
    announced = of(**{k: b.rlike(rf"(?i)(?:{w})\p{{L}}*{_GAP}").cast("int") for k, w in _ANNOUNCE.items()}) == F.lit(1)
    before = vote(announced, b.rlike(rf"(?i)(?:{_OTHER})\p{{L}}*{_GAP}"))
    after = vote(never, a.rlike(_UNITS) | a.rlike(r"\A[.,:/\-]?[0-9]"))
    groups = of(email=F.lit(0), ip=F.lit(0), card=vote(v.rlike(r"\A[0-9]{4}([\x20\-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}\z"), ~solid), phone=vote(v.rlike(r"[0-9][\x20()./\-]+[0-9]+[\x20()./\-]+[0-9]"), solid))
    plain = of(email=F.lit(0), ip=F.lit(0), card=vote(never, F.size(F.array_distinct(F.split(digits, ""))) <= 3), phone=vote(never, F.size(F.array_distinct(F.split(digits, ""))) <= 3))
    return F.array(*((kind == F.lit(k)).cast("int") for k in KINDS), shape, listed, before, after, groups, plain, F.least(n, F.lit(20)), F.least(F.length(v) - F.length(F.regexp_replace(v, r"[\x20()./\-]", "")), F.lit(6)))


def _candidates(text: Column) -> Column:
    """array<struct<kind, start, end, f>> of what the wide pattern finds outside of base spans."""
    return _let(_masked(text), _wide)


def _wide(masked: Column) -> Column:
    some = masked.rlike(r"[0-9](?:[\x20()./\-]{0,2}[0-9]){6}|[\[({]at[\])}]|\x20dot\x20|:[0-9A-Fa-f]{1,4}:")
    kinds = F.transform(_spans(masked, WIDE), lambda s: F.struct(_wide_kind(s["v"]).alias("kind"), s.alias("s")))
    kinds = F.filter(kinds, lambda c: c["kind"].isNotNull())
    return F.when(some, F.transform(kinds, lambda c: F.struct(c["kind"].alias("kind"), c["s"]["start"].alias("start"), c["s"]["end"].alias("end"), _features(c["kind"], c["s"]).alias("f"))))


def patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """f array<int> and n: how many candidates of all documents have which features.

    At most 4 kinds x 3^6 votes x 21 x 7 rows, however many documents there are.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    each = lambda k: lambda s: _features(F.lit(k), s)
    base = F.concat(*(F.transform(_base(t, k), each(k)) for k in KINDS))
    wide = F.coalesce(F.transform(_candidates(t), lambda c: c["f"]), F.expr("cast(array() as array<array<int>>)"))
    return docs.select(F.explode(F.concat(base, wide)).alias("f")).groupBy("f").agg(F.count("*").alias("n"))


def reliabilities(votes: list[tuple[int, tuple[int, ...], int]], anchor: float = 0.1, rounds: int = 100) -> tuple[list[float], list[dict[int, float]]]:
    """Expectation-maximisation over (kind, votes, count): each kind's log odds, and each voter's log odds by its vote.

    Voters are independent given the truth; `anchor` is the weight, as a share of all
    candidates, of what VOTERS says of them, which keeps the two classes what they are
    called.
    """
    total = sum(n for _, _, n in votes)
    prior = [0.0] * len(KINDS)
    right = list(VOTERS.values())
    weight = [{1: math.log(r / (1 - r)), 0: 0.0, -1: -math.log(r / (1 - r))} for r in right]
    held = max(10.0, anchor * total)
    for _ in range(rounds):
        sums = [{(v, y): held * (0.4 if v == 0 else 0.6 * r if (v == 1) == y else 0.6 * (1 - r)) for v in (-1, 0, 1) for y in (False, True)} for r in right]
        shares = [[1.0, 2.0] for _ in KINDS]
        for kind, vote, n in votes:
            odds = prior[kind] + sum(w[v] for w, v in zip(weight, vote))
            yes = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            shares[kind][0] += n * yes
            shares[kind][1] += n
            for s, v in zip(sums, vote):
                s[v, True] += n * yes
                s[v, False] += n * (1 - yes)
        before = [*prior, *(w[v] for w in weight for v in (-1, 0, 1))]
        prior = [math.log(a / (b - a)) for a, b in shares]
        weight = []
        for s in sums:
            all_yes, all_no = (sum(s[v, y] for v in (-1, 0, 1)) for y in (True, False))
            weight.append({v: math.log(s[v, True] / all_yes) - math.log(s[v, False] / all_no) for v in (-1, 0, 1)})
        if max(abs(a - b) for a, b in zip(before, [*prior, *(w[v] for w in weight for v in (-1, 0, 1))])) < 1e-9:
            break
    return prior, weight


def train(docs: DataFrame, text: str = "text") -> list[float]:
    """The span classifier: a weight for each of FEATURES, and the last one without a feature.

    Fitted on all candidates of docs, as counts of feature patterns.  Without candidates
    all weights are 0 but the last, which is -1: nothing is added.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    table = keep(patterns(docs, text))
    first = len(KINDS)
    grouped = table.groupBy(F.slice("f", 1, first + len(VOTERS)).alias("f")).agg(F.sum("n").alias("n")).orderBy("f").collect()
    if not grouped:
        return [0.0] * len(FEATURES) + [-1.0]
    prior, weight = reliabilities([(list(r["f"][:first]).index(1), tuple(r["f"][first:]), r["n"]) for r in grouped])
    odds = sum((F.col("f")[k] * prior[k] for k in range(first)), F.lit(0.0))
    for i, by in enumerate(weight):
        odds = odds + F.when(F.col("f")[first + i] == 1, by[1]).when(F.col("f")[first + i] == -1, by[-1]).otherwise(by[0])
    yes = F.lit(1.0) / (1 + F.exp(-odds))
    rows = table.coalesce(1).sortWithinPartitions("f").select(array_to_vector(F.col("f").cast("array<double>")).alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (yes * F.col("n")).alias("w")), F.struct(F.lit(0.0).alias("label"), ((1 - yes) * F.col("n")).alias("w")))).alias("y"))
    model = LogisticRegression(weightCol="w", regParam=1e-4, maxIter=50).fit(rows.select("features", "y.label", "y.w"))
    return [*(float(x) for x in model.coefficients), float(model.intercept)]


def find_pii(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """docs' own columns, and _base and _spans, arrays of struct<kind int, start int, end int>.

    kind: the place in KINDS; start and end count code points, the end is exclusive.
    _base: what the patterns find, leftmost and not overlapping within a kind, by kind
    and start; _spans: these and the classifier's, sorted alike.  The classifier's lie
    where no base span is.  Null and empty texts have none; repeated rows are scanned one
    by one.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    plain = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.concat(*(F.transform(_base(t, name), plain(k)) for k, name in enumerate(KINDS)))
    score = lambda c: sum((c["f"][i] * F.lit(w) for i, w in enumerate(model[:-1])), F.lit(model[-1]))
    number = lambda c: F.array_position(F.array(*(F.lit(k) for k in KINDS)), c["kind"]).cast("int") - 1
    added = F.transform(F.filter(_candidates(t), lambda c: score(c) >= 0), lambda c: F.struct(number(c).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    found = docs.withColumns({"_base": base, "_added": added})
    every = F.array_sort(F.concat("_base", F.coalesce("_added", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)"))))
    return found.withColumn("_spans", every).drop("_added")


def spelled(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
