"""Session settings that jobs, tests and the bench share, and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with UTC times, adaptive execution and few shuffle partitions."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    builder = SparkSession.builder.master(f"local[{cores}]").appName("brontide")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir, which driver and executors can read and write.

    Where the setting is missing, a local session gets a temporary folder; on a
    cluster that would be each machine's own, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/brontide-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in a table that outlives executors, with known sizes."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``materialize`` in buckets: what joins or adds up by the keys reads rows where they lie. The session's catalog gets a name for the files."""
    spark = df.sparkSession
    path, n = shared_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    called = path.rpartition("/")[2].replace("-", "_")
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(called)
    return spark.table(called)


def remove_table(df: DataFrame) -> None:
    """Delete an intermediate table that ``materialize`` made and that nothing reads any more."""
    spark = df.sparkSession
    root = shared_root(spark)
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_intermediate(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; results that still read them must have been written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
