"""Source maps' mappings as tables: numbers, segments with running sums, and the spans that they cut a script into.

All in DataFrame operations.  A line of millions of segments is no group of its own:
sums run within blocks of BLOCK segments, and over the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscan.functions import hosts

BLOCK = 4096
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# One digit more: five bits to the number that has begun, which ends with a digit below 32.
# Numbers are 32 bits wide, the lowest one being the sign; a digit from the 36th bit on adds nothing.
_SIGNED = "if(w % 2 = 0, w div 2, -shiftright(w, 1))"
_WRAPPED = "if(a.s >= 30, (v + 2147483648) % 4294967296 - 2147483648, v)"
_GROWN = "a.v + if(a.s <= 30, (d % 32) * shiftleft(1L, a.s), 0L)"
_STEP = hosts.let(
    f"cast(instr('{_DIGITS}', c) - 1 as bigint)", "d",
    "if(a.bad or size(a.out) = 5, a, if(d < 0, named_struct('v', a.v, 's', a.s, 'out', a.out, 'bad', true), "
    + hosts.let(_GROWN, "v", "if(d >= 32, named_struct('v', v, 's', a.s + 5, 'out', a.out, 'bad', false), named_struct('v', 0L, 's', 0, 'out', concat(a.out, array(" + hosts.let(_WRAPPED, "w", _SIGNED) + ")), 'bad', false))")
    + "))",
)
_FOLD = f"aggregate(split(x, ''), named_struct('v', 0L, 's', 0, 'out', cast(array() as array<bigint>), 'bad', false), (a, c) -> {_STEP}, a -> named_struct('values', a.out, 'good', not a.bad and (size(a.out) = 5 or a.s = 0) and size(a.out) not in (0, 2, 3)))"
# Where every number is one digit, numbers are looked up.
_LOOK_UP = f"if(instr('{_DIGITS}', c) % 2 = 1, (instr('{_DIGITS}', c) - 1) div 2, -((instr('{_DIGITS}', c) - 2) div 2))"
_READ = f"x -> if(x rlike r'\\A[A-Za-f]+\\z', named_struct('values', transform(split(substr(x, 1, 5), ''), c -> {_LOOK_UP}), 'good', length(x) not in (2, 3)), {_FOLD})"
# One, four or five numbers, and what follows five.
_NUMBER = "[g-z0-9+/]*[A-Za-f]"
_GOOD = f"(?s)\\A({_NUMBER}|({_NUMBER}){{4}}|({_NUMBER}){{5}}.*)\\z"


def decoded(segment: Column) -> Column:
    """values array<long> and good: up to five numbers of a segment, and whether it is one.

    Numbers before the place where a segment breaks off are among values; segments of two
    or three numbers are broken ones.
    """
    return F.element_at(F.call_function("transform", F.array(segment), F.expr(_READ)), 1)


def segments(maps: DataFrame, key: str, mappings: str = "mappings") -> DataFrame:
    """key, gen_line, place, gen_col, src, src_line, src_col and name of every mapping; -1 for what is absent.

    A broken segment ends its line; its numbers count for what comes after.  Columns of
    the script begin anew with each line, all else runs on.  Null mappings have none; key
    should tell maps apart.
    """
    lines = maps.select(key, F.posexplode(F.split(mappings, ";")).alias("gen_line", "_line"))
    cut = lines.select(key, "gen_line", F.posexplode(F.filter(F.split("_line", ","), lambda s: s != "")).alias("place", "_segment"))
    told = cut.select(key, "gen_line", "place", F.floor(F.col("place") / BLOCK).alias("_block"), decoded(F.col("_segment")).alias("d"))
    value = lambda i: F.coalesce(F.get("d.values", F.lit(i)), F.lit(0))
    told = told.select(key, "gen_line", "place", "_block", F.size("d.values").alias("_n"), F.col("d.good").alias("_good"), *(value(i).alias(f"_{i}") for i in range(5)))
    # Of each line what comes up to its first broken segment.
    ends = cut.where(~F.col("_segment").rlike(_GOOD)).groupBy(key, "gen_line").agg(F.min("place").alias("_end"))
    told = told.join(ends, [key, "gen_line"], "left").where("_end is null or place <= _end").drop("_end")
    sums = told.groupBy(key, "gen_line", "_block").agg(*(F.sum(f"_{i}").alias(f"_s{i}") for i in range(5)))
    earlier = W.partitionBy(key).orderBy("gen_line", "_block").rowsBetween(W.unboundedPreceding, -1)
    in_line = W.partitionBy(key, "gen_line").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(key, "gen_line", "_block", *(F.coalesce(F.sum(f"_s{i}").over(in_line if i == 0 else earlier), F.lit(0)).alias(f"_b{i}") for i in range(5)))
    within = W.partitionBy(key, "gen_line", "_block").orderBy("place")
    at = told.join(bases, [key, "gen_line", "_block"]).select(key, "gen_line", "place", "_n", "_good", *((F.col(f"_b{i}") + F.sum(f"_{i}").over(within)).alias(f"_{i}") for i in range(5)))
    known = lambda i, n: F.when(F.col("_n") >= n, F.col(f"_{i}")).otherwise(F.lit(-1)).cast("int")
    return at.where("_good").select(key, "gen_line", "place", F.col("_0").cast("int").alias("gen_col"), known(1, 4).alias("src"), known(2, 4).alias("src_line"), known(3, 4).alias("src_col"), known(4, 5).alias("name"))


def rebuilt(maps: DataFrame, key: str, mappings: str = "mappings", minified: str = "minified") -> DataFrame:
    """key, src and content: the script as the mappings of each source cut it, from its begin to the last one's line.

    Each mapping's span goes to the next one of its source, over lines if need be; a span
    is joined with the lines that it has parts of.  Mappings of lines that the script
    hasn't got don't count.
    """
    texts = maps.select(key, F.posexplode(F.split(minified, "\n")).alias("line", "text"))
    sizes = maps.select(key, F.size(F.split(minified, "\n")).alias("_lines"))
    rows = segments(maps, key, mappings).join(sizes, key).where("gen_line < _lines").select(key, "src", "gen_line", "place", F.greatest("gen_col", F.lit(0)).alias("gen_col"))
    order = W.partitionBy(key, "src").orderBy("gen_line", "place")
    spans = rows.withColumns({"_to": F.lead("gen_line").over(order), "_col": F.lead("gen_col").over(order), "_first": F.row_number().over(order) == 1})
    # A piece: line, first column, end or null for the rest of the line, whether a line's end follows.
    piece = "named_struct('line', {}, 'a', {}, 'b', {}, 'nl', {})"
    whole = lambda low, high: f"if({high} > {low}, transform(sequence({low}, {high} - 1), l -> {piece.format('l', '0', 'cast(null as int)', 'true')}), array())"
    begin = f"if(_first, concat({whole('0', 'gen_line')}, array({piece.format('gen_line', '0', 'gen_col', 'false')})), array())"
    last = f"array({piece.format('gen_line', 'gen_col', 'cast(null as int)', 'false')})"
    same = f"array({piece.format('gen_line', 'gen_col', '_col', 'false')})"
    over = f"concat(array({piece.format('gen_line', 'gen_col', 'cast(null as int)', 'true')}), {whole('gen_line + 1', '_to')}, array({piece.format('_to', '0', '_col', 'false')}))"
    pieces = spans.select(key, "src", "gen_line", "place", F.posexplode(F.expr(f"concat({begin}, case when _to is null then {last} when _to = gen_line then {same} else {over} end)")).alias("_no", "p"))
    met = pieces.select(key, "src", "gen_line", "place", "_no", "p.*").join(texts, [key, "line"])
    size = F.coalesce("b", F.length("text")) - F.col("a")
    made = F.concat(F.substring("text", F.col("a") + 1, F.greatest(size, F.lit(0))), F.when(F.col("nl"), F.lit("\n")).otherwise(F.lit("")))
    joined = met.groupBy(key, "src").agg(F.array_sort(F.collect_list(F.struct("gen_line", "place", "_no", made.alias("t")))).alias("_parts"))
    return joined.select(key, "src", F.array_join(F.transform("_parts", lambda p: p["t"]), "").alias("content"))
