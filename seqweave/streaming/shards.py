"""Working through shards as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators.graph import edges

GENES = "genome bigint, pos bigint, family string"


def stream_edges(spark: SparkSession, source: str, out: str, checkpoint: str):
    """Count adjacencies of every new gene shard and keep them per batch.

    A shard holds whole genomes. A batch that is run again writes the same
    partition again, so nothing is counted twice.
    """

    def keep(batch: DataFrame, number: int) -> None:
        edges(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    shards = spark.readStream.schema(GENES).option("maxFilesPerTrigger", 16).parquet(source)
    return (
        shards.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_edges(spark: SparkSession, out: str) -> DataFrame:
    """All batches together: genomes of different shards differ, so counts add up."""
    return spark.read.parquet(out).groupBy("prev", "family").agg(
        F.sum("n").alias("n"), F.sum("genomes").alias("genomes")
    )


def request_counts(requests: DataFrame, length: str = "10 minutes", step: str = "1 minute") -> DataFrame:
    """Requests per client in sliding windows, late ones within the watermark."""
    return (
        requests.withWatermark("ts", length)
        .groupBy(F.window("ts", length, step), "client")
        .agg(F.count(F.lit(1)).alias("requests"))
    )
