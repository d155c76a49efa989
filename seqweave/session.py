"""Session construction and lineage control."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "seqweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` entries override the defaults."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_run: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This run's subfolder of the folder named by ``spark.checkpoint.dir``.

    Without that setting only a local master, whose tasks share the driver's
    disk, gets a folder of its own; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _run.setdefault("private", "file://" + tempfile.mkdtemp(prefix="seqweave-"))
    return f"{root.rstrip('/')}/seqweave-{_run.setdefault('id', uuid.uuid4().hex)}"


def close(spark: SparkSession) -> None:
    """Drop all tables that ``cut_lineage`` wrote in this run; frames built on them can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` wrote; frames built on it can't be read afterwards."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.split("/")[-2:-1] == [shared_folder(spark).rsplit("/", 1)[-1]]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from it.

    A stage that several later ones read is then computed once, survives lost
    executors, and comes back with its real size, so joins on it are planned
    from what it holds. Columns keep their names and types.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
