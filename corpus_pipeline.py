"""From raw documents to packed sequences, in five stages that each call one operator.

Each stage takes the documents that its predecessor kept; all but the last return the
columns they were given.  Rows without an id pass through stages that only judge texts.
Between stages the rows are a Parquet table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.llm import decontam, jaccard, packing, secrets, toxicity
from loomscan.llm.graph import shared_folder

#: The rows can't be had by SQL: stages 1, 4 and 5 fit models or pack. See tests/llm.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """text, and all other columns in one, so that names of theirs can't clash with an operator's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc"), "text")


def _whole(df: DataFrame, columns: list[str], text=None) -> DataFrame:
    return df.select(*((F.col("text") if text is None else text).alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(_apart(docs), model, keep=("doc", "text"))
    return _whole(scored.where("toxicity < 0.5"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of the least doc_id, and of its rows the first one read."""
    row = F.struct(F.col("doc.doc_id").alias("id"), F.nullif(F.monotonically_increasing_id(), F.lit(-1)).alias("row"))
    rows = _apart(docs).withColumn("key", F.when(F.col("doc.doc_id").isNotNull(), row))
    groups = jaccard.jaccard_groups(rows.select("key", "text"), key="key")
    return _whole(rows.join(groups.where("key <> component").select("key"), "key", "left_anti"), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lies in benchmark windows."""
    found = decontam.judged(decontam.decontaminate(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("doc", "text")))
    return _whole(found.where("not contaminated"), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret; all documents stay, and n_chars follows the new text."""
    forest = secrets.train(secrets.labelled_findings(spark))
    given = _apart(docs).withColumn("source", F.col("doc.source") if "source" in docs.columns else F.lit(""))
    changed = secrets.scan(given, forest).withColumn("new", F.when(F.exists("_hits", lambda z: z["secret"]), secrets.redacted()).otherwise(F.col("text")))
    out = _whole(changed, docs.columns, F.col("new"))
    if "n_chars" not in docs.columns:
        return out
    size = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their places in sequences."""
    return packing.best_fit_pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack)]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written in the shared folder and read again.

    A stage's table goes once the next one's is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                _remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
