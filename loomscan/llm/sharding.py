"""K-d tree sharding in DataFrame operations.

Each document is a point of metadata dimensions that follow from its text, weighing its
bytes.  A node is split at the weighted median of the dimension in which it is widest,
until each leaf is a shard of the target size.  Medians come from histograms: a bounded
number of rows for each node, summed where the data are, so neither the data nor their
keys ever meet in one place.  Equal texts are one point; a split falls between points,
and divides the copies of a text only where they outweigh the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscan.llm.graph import keep

#: Steps of each dimension, and of each level of a tie-breaking hash.
STEPS = 4096


def dimensions(text: Column) -> dict[str, Column]:
    """Whole numbers below STEPS that follow from the text."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    chars = F.coalesce(F.char_length(text), F.lit(0))
    lines = chars - F.coalesce(F.char_length(F.translate(text, "\n", "")), F.lit(0))
    blanks = chars - F.coalesce(F.char_length(F.translate(text, " ", "")), F.lit(0))
    unit = lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(STEPS - 1)).cast("int")
    return {
        "length": unit(F.log2(size + F.lit(1.0)) * 128),
        "beyond_ascii": unit((size - chars) / F.greatest(size, F.lit(1)) * 8190),
        "word_length": unit(F.log2(chars / (blanks + 1) + F.lit(1.0)) * 256),
        "line_length": unit(F.log2(chars / (lines + 1) + F.lit(1.0)) * 200),
    }


def _part(level: int, source: str) -> Column:
    """Twelve bits of a 64-bit hash, the most significant ones first."""
    return F.shiftrightunsigned(F.col(source), 52 - 12 * level).bitwiseAND(F.lit(STEPS - 1)).cast("int")


#: After the dimension itself: what orders points of one step, level by level.
TIES = [*((k, "text_hash") for k in range(3)), *((k, "row_hash") for k in range(3))]


def _table(values: dict[int, object], kind: str) -> Column:
    """A constant map from nodes; its code has one size however many nodes there are."""
    pairs = [x for k, v in sorted(values.items()) for x in (F.lit(k), F.array(*(F.lit(e) for e in v)) if isinstance(v, list) else F.lit(v))]
    return F.create_map(*pairs).cast(f"map<int,{kind}>")


def _placed(splits: dict[int, str], levels: int) -> Column:
    """A point's place within its node: the node's dimension, then the first levels - 1 of TIES."""
    dims = sorted(set(splits.values()))
    which = F.try_element_at(_table({n: dims.index(d) + 1 for n, d in splits.items()}, "int"), F.col("node"))
    return F.array(F.try_element_at(F.array(*(F.col(d) for d in dims)), which), *(_part(*t) for t in TIES[: levels - 1]))


def _median(points: DataFrame, splits: dict[int, str], goal: dict[int, tuple[float, float]], slack: float) -> dict[int, list[int]]:
    """For each node the edge at which the bytes to its left come nearest to goal: points whose place is below it go left.

    splits: the dimension of each node; goal: node -> (bytes wanted on the left, bytes).
    Each round looks at one step of one level, for all nodes at once: at most
    len(splits) * STEPS rows come to the driver.
    """
    edges: dict[int, list[int]] = {n: [] for n in splits}
    left = {n: 0.0 for n in splits}
    live = set(splits)
    for level in range(1 + len(TIES)):
        if not live:
            break
        # Points that are still undecided: their place begins with their node's edge so far.
        at = points.withColumn("place", _placed({n: splits[n] for n in live}, level + 1)).where(F.col("node").isin(sorted(live)))
        if level:
            at = at.where(F.slice("place", 1, level) == F.try_element_at(_table({n: edges[n] for n in live}, "array<int>"), F.col("node")))
        rows = at.groupBy("node", F.get("place", F.lit(level)).alias("step")).agg(F.sum("size").alias("size")).collect()
        for n in sorted(live):
            steps = sorted((r.step, r.size) for r in rows if r.node == n)
            want, at = goal[n][0], None
            for step, size in steps:
                if left[n] + size > want or step == steps[-1][0]:
                    at = (step, size)
                    break
                left[n] += size
            if at is None:
                live.discard(n)
                continue
            step, size = at
            over, under = left[n] + size - want, want - left[n]
            if level == len(TIES) or min(over, under) <= slack:
                edges[n].append(step + 1 if over < under else step)
                live.discard(n)
            else:
                edges[n].append(step)
    return edges


def kd_shards(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = 16, tolerance: float = 0.01) -> DataFrame:
    """key, size, text_crc32, shard and slot for every document.

    size: the text's UTF-8 bytes and one more; text_crc32: of its UTF-8 bytes; null is
    the empty text.  Shards are numbered from 0 and have nearly equal bytes: every split
    comes within tolerance of a shard's target, or the largest document's size.  slot:
    a gapless number from 0 within the shard.  Equal texts stay together unless that
    would cost more than the tolerance.  Repeated rows count each for itself, a null key
    is passed on, an empty table gives no rows; fewer documents than shards leave some
    shards empty.  shards: any number from 1.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    dims = dimensions(body)
    points = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), F.xxhash64(body).alias("text_hash"), F.monotonically_increasing_id().alias("row"), *(c.alias(n) for n, c in dims.items()))
    points = keep(points.withColumn("row_hash", F.xxhash64(F.col("row") + 17)))
    total = points.agg(F.sum("size")).first()[0] or 0
    nodes = {0: (0, shards)}  # node -> first shard, shards
    placed, number = points.withColumn("node", F.lit(0)), 0
    slack = tolerance * total / shards
    while wide := {n: s for n, s in nodes.items() if s[1] > 1}:
        # The widest dimension of each node, by the spread of its weighted values.
        of = placed.where(F.col("node").isin(list(wide)))
        stats = of.groupBy("node").agg(F.sum("size").alias("size"), *(F.sum(F.col(d) * F.col("size").cast("double")).alias(f"s_{d}") for d in dims), *(F.sum(F.col(d) * F.col(d) * F.col("size").cast("double")).alias(f"q_{d}") for d in dims)).collect()
        dim, goal = {}, {}
        for r in stats:
            w = float(r["size"])
            spread = {d: r[f"q_{d}"] / w - (r[f"s_{d}"] / w) ** 2 for d in dims}
            dim[r.node] = max(sorted(spread), key=spread.get)
            first, n = wide[r.node]
            goal[r.node] = (w * (n // 2) / n, w)
        edges = _median(of, dim, goal, slack)
        children = {}
        for n, (first, count) in wide.items():
            a, b = number + 1, number + 2
            number += 2
            nodes |= {a: (first, count // 2), b: (first + count // 2, count - count // 2)}
            del nodes[n]
            children[n] = [a, b]
        if edges:
            # A place is compared with as much of the edge as there is; places are ordered as arrays are.
            edge = F.try_element_at(_table(edges, "array<int>"), F.col("node"))
            place = _placed(dim, max(map(len, edges.values())))
            left = F.slice(place, F.lit(1), F.greatest(F.size(edge), F.lit(1))) < edge
            child = F.try_element_at(_table({n: children[n] for n in edges}, "array<int>"), F.col("node"))
            placed = placed.withColumn("node", F.coalesce(F.get(child, F.when(left, 0).otherwise(1)), F.col("node")))
        if any(s[1] > 1 for s in nodes.values()):
            placed = keep(placed)  # a few numbers a row; the next level's plan starts from here
    placed = placed.withColumn("shard", F.try_element_at(_table({n: first for n, (first, _) in nodes.items()}, "int"), F.col("node")))
    return numbered(placed).select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def numbered(placed: DataFrame, rows_each: int = 100_000) -> DataFrame:
    """Adds slot, gapless from 0 within each shard, without gathering a shard in one task.

    Rows are numbered within buckets of about rows_each rows; a bucket's first slot is
    the number of rows in the shard's buckets before it.
    """
    n = placed.count()
    buckets = max(1, -(-n // rows_each))
    placed = placed.withColumn("bucket", F.pmod("row_hash", F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("before"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("row_hash", "row"))
    return placed.withColumn("within", within).join(offsets, ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("within") - 1).cast("long")).drop("within", "before", "bucket")
