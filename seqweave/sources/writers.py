"""Writers: ranked CSV, window documents and tables written shard by shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ranked_csv(df: DataFrame, path: str, rank: str) -> None:
    """Files in rank order with a header."""
    df.orderBy(rank).write.mode("overwrite").csv(path, header=True)


def graph_documents(nodes: DataFrame, edges: DataFrame, key: str = "window") -> DataFrame:
    """One JSON document per window: key, document. A window is a bounded number of
    columns, so its nodes and edges fit one row; empty fields are left out."""
    packed = lambda df: F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != key])))
    n = nodes.groupBy(key).agg(packed(nodes).alias("nodes"))
    e = edges.groupBy(key).agg(packed(edges).alias("edges"))
    return n.join(e, key, "left").select(key, F.to_json(F.struct("nodes", "edges")).alias("document"))


def missing_shards(df: DataFrame, path: str, shard: str) -> DataFrame:
    """Rows of the shards the table at ``path`` does not hold yet; all of them when there is no such path."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return df
    done = spark.read.parquet(path).select(F.col(shard).cast(df.schema[shard].dataType)).distinct()
    return df.join(done, shard, "left_anti")


def write_missing(df: DataFrame, path: str, shard: str) -> None:
    """Append the missing shards, each in its own partition; a finished shard is never redone."""
    missing_shards(df, path, shard).write.mode("append").partitionBy(shard).parquet(path)
