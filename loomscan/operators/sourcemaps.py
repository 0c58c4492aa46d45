"""Source maps: which scripts have one, and the files they restore."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscan.functions import content, paths, url
from loomscan.operators import mappings
from loomscan.sources.shared import keep

NOT_MAPS = r"(?i)html|image/|text/css|font|text/plain"


def may_be_map(content_type: str):
    """Whether a media type may be that of a source map."""
    return ~F.coalesce(F.col(content_type), F.lit("")).rlike(NOT_MAPS)


def probe_maps(scripts: DataFrame, responses: DataFrame) -> DataFrame:
    """url, map_url, text for scripts beside which a valid map lies; scripts: url."""
    at = scripts.select("url", url.map_of(F.col("url")).alias("map_url"))
    r = responses.select(F.col("url").alias("map_url"), "status", "content_type", "text").where("status between 200 and 299")
    fit = may_be_map("content_type") & content.is_source_map(F.col("text"))
    return at.join(r, "map_url").where(fit).select("url", "map_url", "text")


def parse_maps(maps: DataFrame, text: str = "text") -> DataFrame:
    """maps' columns with version, file, root, sources, contents, mappings; invalid maps are left out.

    A source that isn't a string is empty, a missing version 0, missing mappings empty.
    """
    v = F.try_parse_json(F.col(text))
    texts = lambda a: F.transform(a, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    get = lambda p, t: F.try_variant_get(v, p, t)
    return maps.where(content.is_source_map(F.col(text))).select(
        *maps.columns,
        F.coalesce(get("$.version", "double"), F.lit(0.0)).alias("version"), get("$.file", "string").alias("file"), F.coalesce(get("$.sourceRoot", "string"), F.lit("")).alias("root"),
        F.transform(texts(get("$.sources", "array<variant>")), lambda s: F.coalesce(s, F.lit(""))).alias("sources"), texts(get("$.sourcesContent", "array<variant>")).alias("contents"), F.coalesce(get("$.mappings", "string"), F.lit("")).alias("mappings"),
    )


def has_contents(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("has_contents", F.coalesce(F.exists("contents", lambda c: F.coalesce(c, F.lit("")) != ""), F.lit(False)))


def restore(maps: DataFrame, columns: tuple[str, ...], text: str = "text", minified: str | None = None) -> DataFrame:
    """The columns, idx, path, content, mode for every file that a map restores.

    mode: sourcesContent, or mappings where only the minified script tells what a source
    was, as far as it can.  A source without either is left out.
    """
    parsed = parse_maps(maps, text)
    pick = F.transform("sources", lambda s, i: F.struct(s.alias("source"), F.coalesce(F.get("contents", i), F.lit("")).alias("content"), i.alias("idx")))
    rows = parsed.select(*columns, "root", F.explode(pick).alias("s")).select(*columns, "root", "s.*")
    files = rows.where("content <> ''").withColumn("mode", F.lit("sourcesContent"))
    if minified is not None:
        lacking = has_contents(parsed).where(F.exists("sources", lambda s: F.lit(True)) & (F.coalesce(F.length(minified), F.lit(0)) > 0))
        lacking = lacking.where(F.size(F.filter(F.coalesce("contents", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != "")) < F.size("sources"))
        # Most maps have all contents; only where some haven't are mappings read.
        lacking = keep(lacking.select(*columns, "root", "sources", "contents", "mappings", F.col(minified).alias("_minified")).withColumn("_map", F.monotonically_increasing_id()))
        if lacking.isEmpty():
            return _named(files, columns)
        made = mappings.rebuilt(lacking, "_map", minified="_minified").select("_map", F.col("src").alias("idx"), F.col("content").alias("made"))
        again = F.transform("sources", lambda s, i: F.struct(s.alias("source"), F.coalesce(F.get("contents", i), F.lit("")).alias("given"), i.alias("idx")))
        extra = lacking.select(*columns, "root", "_map", F.explode(again).alias("s")).select(*columns, "root", "_map", "s.*").where("given = ''").join(made.where("made <> ''"), ["_map", "idx"])
        note = F.concat(F.lit("/* Restored from source map mappings; not the complete source.\n   Original path: "), "source", F.lit(" */\n"))
        files = files.unionByName(extra.select(*columns, "root", "source", F.concat(note, "made").alias("content"), "idx", F.lit("mappings").alias("mode")))
    return _named(files, columns)


def _named(files: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    path = paths.source_path(F.col("source"), F.col("root"))
    return files.select(*columns, "idx", F.coalesce(F.nullif(path, F.lit("")), F.concat(F.lit("unnamed_"), "idx", F.lit(".js"))).alias("path"), "content", "mode")


def counted(files: DataFrame, by: str, limit: int = 2000) -> DataFrame:
    """by, total, kept, omitted: files for each key, of which the first `limit` of all are kept.

    The keys' totals are added up in the order of the keys, by ranges: every task adds up
    its own, and only the tasks' sums come together.
    """
    totals = keep(files.groupBy(by).agg(F.count("*").alias("total")).orderBy(by).withColumn("_task", F.spark_partition_id()))
    sums = sorted((r["_task"], r["n"]) for r in totals.groupBy("_task").agg(F.sum("total").alias("n")).collect())  # one row a task
    before, offsets = 0, []
    for task, n in sums:
        offsets += [F.lit(task), F.lit(before)]
        before += n
    base = F.create_map(*offsets)[F.col("_task")] if offsets else F.lit(0)
    upto = base + F.sum("total").over(W.partitionBy("_task").orderBy(by)) - F.col("total")
    kept = F.greatest(F.lit(0), F.least(F.col("total"), F.lit(limit) - upto)).cast("long")
    return totals.withColumn("kept", kept).select(by, "total", "kept", (F.col("total") - F.col("kept")).alias("omitted"))
