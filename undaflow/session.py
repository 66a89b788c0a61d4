"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("undaflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a session on one machine may do without: it gets a temporary folder, which
    the session remembers; anywhere else executors would write what others can't read, so that is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("undaflow.checkpoint.dir", None)
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="undaflow-")
        spark.conf.set("undaflow.checkpoint.dir", where)
    return where.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/undaflow-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files are on storage that all executors and the driver see, so a lost executor costs
    only the tasks that ran on it. ``clear`` removes them all."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; results that still read them must have been written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
