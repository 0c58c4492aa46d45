"""Extraction from newly captured documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomscan.operators.extract import Registry, extract


def extract_arriving(docs: DataFrame, target: str, checkpoint: str, registry: Registry | None = None) -> StreamingQuery:
    """Appends the findings of each batch of a stream of documents to a Parquet table."""

    def batch(rows: DataFrame, number: int) -> None:
        extract(rows, registry).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
