"""The queries of the operators over whole tables, and what SQL can say about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.llm import decontam, divergence, embed, jaccard, licenses, lm, packing, pii, runs, secrets, sharding, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of all documents under the counts of all documents."""
    return lm.stupid_backoff(_table(spark, sf_dir, "documents"))


def op1_stupid_backoff_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores, by two steps of backing off."""
    return lm.stupid_backoff(_table(spark, sf_dir, "documents"), order=3)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its candidates, its secrets, and a digest of the latter in order."""
    forest = secrets.train(secrets.labelled_findings(spark))
    found = secrets.scan(_table(spark, sf_dir, "documents"), forest)
    kept = F.transform(F.filter("_hits", lambda z: z["secret"]), lambda z: z["v"])
    return found.select("doc_id", F.size("_hits").cast("long").alias("n_candidates"), F.size(kept).cast("long").alias("n_secrets"), F.sha2(F.array_join(kept, "\n"), 256).alias("secrets_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def _licenses(found: DataFrame) -> DataFrame:
    words = F.transform("phrases", lambda p: p["word"])
    base = F.array_sort(F.array_distinct(F.transform("phrases", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform("blocks", lambda b: b["label"]))))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(best).alias("score"), F.size("blocks").cast("long").alias("n_blocks"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses by lines and by passages over line breaks."""
    return _licenses(licenses.scan_licenses(_table(spark, sf_dir, "documents"), wrapped=True))


def op4_license_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses by single lines, as its SQL has them."""
    return _licenses(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op6_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embed.near_vectors(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs, model)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_shards(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.train(pages)).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judged(decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by patterns, and by a classifier that is fitted to the labelers' votes on all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.train(docs))
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.spelled(F.col("_base")), 256).alias("base_sha256"), pii.spelled(F.col("_spans")).alias("spans"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


def _repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document by its id's checksum repeats a stretch of words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    given = docs.select("doc_id", "text", (F.floor(h / 10)).alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    given = given.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    given = given.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    changed = F.array_join(F.transform("w", lambda w, i: F.get("w", place(i))), " ")
    return given.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_repeating(_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.withColumn("m", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"), F.expr("1000 * m.length div -m.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_stupid_backoff, op2_secret_scan, op3_jaccard_join, op4_license_scan, op5_best_fit_packing, op6_vector_neardup, op7_toxicity, op8_kd_sharding, op9_url_filter, op10_decontamination, op11_pii, op12_source_divergence, op13_periodic_runs, op4_license_scan_lines, op1_stupid_backoff_trigrams)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SOLID = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op1_stupid_backoff": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
p AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS c FROM w),
c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w),
c2 AS (SELECT c, w, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY c, w HAVING count(*) >= 2),
s AS (SELECT p.r, p.c IS NOT NULL AND c2.n IS NULL AS backed, CAST(round(1e6 * CASE WHEN c2.n IS NOT NULL THEN ln(c2.n / k.n) ELSE ln(c1.n / (SELECT count(*) FROM w)) + CASE WHEN p.c IS NULL THEN 0 ELSE ln(0.4) END END) AS BIGINT) AS micro
  FROM p JOIN c1 USING (w) LEFT JOIN c2 ON c2.c = p.c AND c2.w = p.w LEFT JOIN c1 k ON k.w = p.c),
t AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE backed) AS b, CAST(sum(micro) AS BIGINT) AS m FROM s GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(b, 0) AS n_backoff, coalesce(m, 0) AS micro, m / 1e6 / n AS score FROM d LEFT JOIN t USING (r)""",
    "op1_stupid_backoff_trigrams": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
p AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS c, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS b FROM w),
c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w),
c2 AS (SELECT c, w, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY c, w HAVING count(*) >= 2),
c3 AS (SELECT b, c, w, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY b, c, w HAVING count(*) >= 2),
s AS (SELECT p.r, CASE WHEN p.c IS NULL THEN false WHEN p.b IS NULL THEN c2.n IS NULL ELSE c3.n IS NULL END AS backed,
    CAST(round(1e6 * CASE WHEN c3.n IS NOT NULL THEN ln(c3.n / k2.n)
      WHEN c2.n IS NOT NULL THEN ln(c2.n / k.n) + CASE WHEN p.b IS NULL THEN 0 ELSE ln(0.4) END
      ELSE ln(c1.n / (SELECT count(*) FROM w)) + CASE WHEN p.c IS NULL THEN 0 WHEN p.b IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END) AS BIGINT) AS micro
  FROM p JOIN c1 USING (w) LEFT JOIN c2 ON c2.c = p.c AND c2.w = p.w LEFT JOIN c1 k ON k.w = p.c LEFT JOIN c3 ON c3.b = p.b AND c3.c = p.c AND c3.w = p.w LEFT JOIN c2 k2 ON k2.c = p.b AND k2.w = p.c),
t AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE backed) AS b, CAST(sum(micro) AS BIGINT) AS m FROM s GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(b, 0) AS n_backoff, coalesce(m, 0) AS micro, m / 1e6 / n AS score FROM d LEFT JOIN t USING (r)""",
    "op3_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SOLID}) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(a, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.a WHERE c.c < e.b)
SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c.c) AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.a = doc_id GROUP BY doc_id""",
    "op4_license_scan_lines": f"""
WITH tp(label, t) AS (VALUES {", ".join(f"('{label}', '{t}')" for label, t in licenses.TEMPLATES)}),
ph(label, t) AS (VALUES {", ".join(f"('{label}', '{p}')" for p, label in licenses.PHRASES.items())}),
tw AS (SELECT label, list_distinct(regexp_extract_all({_LOW.replace("coalesce(text, '')", "t")}, {_ALNUM})) AS ws FROM tp),
d AS (SELECT row_number() OVER () AS r, doc_id, {_LOW} AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, {_ALNUM}) AS ws FROM d),
b AS (SELECT r, ph.label, i FROM (SELECT r, ws, unnest(generate_series(1, len(ws))) AS i FROM w), (SELECT label, t, len(string_split(t, ' ')) AS k FROM ph) ph WHERE array_to_string(ws[i : i + k - 1], ' ') = t),
bs AS (SELECT r, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY r),
li AS (SELECT r, regexp_extract_all(unnest(string_split(low, chr(10))), {_ALNUM}) AS ws FROM d),
m AS (SELECT r, label, len(list_intersect(list_distinct(li.ws), tw.ws)) / len(tw.ws) AS share FROM li, tw WHERE len(list_intersect(list_distinct(li.ws), tw.ws)) * 5 >= 4 * len(tw.ws)),
ms AS (SELECT r, count(*) AS n, max(share) AS share FROM m GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM m) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(bs.n, 0) AS n_base, f AS first_word, l AS last_word, coalesce(bs.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CASE WHEN bs.n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score, coalesce(ms.n, 0) AS n_blocks
FROM w LEFT JOIN bs USING (r) LEFT JOIN ms USING (r) LEFT JOIN a USING (r)""",
    "op6_vector_neardup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS s FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / a.s / b.s >= 0.95),
c(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.a WHERE c.c < e.b),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a), m AS (SELECT a, min(c) AS c FROM c GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, m.c AS component_id, vec_id = m.c AS kept FROM embeddings LEFT JOIN k ON k.a = vec_id JOIN m ON m.a = vec_id""",
    "op10_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[k : k + least(13, len(ws)) - 1], ' ') AS t FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS k FROM i WHERE len(ws) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, k, m, array_to_string(ws[k : k + m - 1], ' ') AS t FROM (SELECT r, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS k FROM d, ms WHERE len(ws) >= m)),
o AS (SELECT r, k, m, item_id FROM dw JOIN iw USING (m, t)),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(k, k + m - 1)) AS p FROM (SELECT DISTINCT r, k, m FROM o)) GROUP BY r),
s AS (SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM o) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)""",
    "op12_source_divergence": f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
kt AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(ws)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM kt GROUP BY lang),
w AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(ws) AS t FROM d) JOIN kt USING (lang, t) GROUP BY lang, source, t),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, sum(n)::BIGINT AS n FROM w GROUP BY lang, source),
gp AS (SELECT g.lang, g.source, kt.t, coalesce(w.n, 0) AS n, 1 + (1000000000 * (coalesce(w.n, 0) + 2)) // (coalesce(gn.n, 0) + 2 * v.v) AS p
  FROM g JOIN kt USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN w USING (lang, source, t)),
ln AS (SELECT lang, sum(n)::BIGINT AS n FROM w GROUP BY lang),
lp AS (SELECT kt.lang, kt.t, 1 + (1000000000 * (sum(w.n)::BIGINT + 2)) // (any_value(ln.n) + 2 * any_value(v.v)) AS q FROM kt JOIN v USING (lang) JOIN ln USING (lang) JOIN w USING (lang, t) GROUP BY kt.lang, kt.t),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pr AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pv ON pv.lang = g.lang AND pv.source = g.source AND pv.item = h.source),
te AS (SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q)) // (p + q) AS value FROM gp JOIN lp USING (lang, t) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM te) QUALIFY part = 'pair' OR rank <= 10""",
    "op13_periodic_runs": """
WITH h AS (SELECT row_number() OVER () AS r, doc_id, text, xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END, CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM documents),
w0 AS (SELECT r, doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM h),
w1 AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN g % len(ws) END AS a FROM w0),
w2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w1),
w AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM w2),
five AS (SELECT r, n, i, array_to_string(ws[i + 1 : i + 5], ' ') AS k FROM (SELECT r, n, ws, unnest(range(n - 4)) AS i FROM w WHERE n >= 6)),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM five x JOIN five y ON x.r = y.r AND x.k = y.k AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
part AS (SELECT r, q, min(i) AS start, max(i) - min(i) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM part WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
best AS (SELECT r, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length, first(period ORDER BY length DESC, start, period) AS period,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(t, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(ws) AS t, unnest(range(n)) AS i FROM w) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
}
