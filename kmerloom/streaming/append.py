"""Incremental append: micro-batches of (kmer, genome_id) into a stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_batch(folder: str):
    """A foreachBatch function: one sorted part per batch, overwritten if the batch is retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("kmer", F.col("genome_id").cast("int").alias("genome_id")).where(F.col("kmer").isNotNull()).distinct()
        rows.sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def append_stream(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of (kmer, genome_id). Unions of colors commute and repeat harmlessly, so no watermark is needed."""
    return rows.writeStream.foreachBatch(append_batch(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_pairs(spark, folder: str) -> DataFrame:
    """The distinct pairs of all batches."""
    return spark.read.parquet(folder).select("kmer", "genome_id").distinct()
