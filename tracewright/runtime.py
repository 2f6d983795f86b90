"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Setting: partitions of a scan before work that is heavy per row.
SCAN_PARTITIONS = "spark.tracewright.scan.partitions"


def local_session(cpus: int = 8, partitions: int | None = None, app: str = "tracewright") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TRACEWRIGHT_DRIVER_MEMORY", "8g"))
        .config(SCAN_PARTITIONS, str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the checkpoint folder of the context or of ``spark.checkpoint.dir``. Where neither is set, a
    temporary folder is made and set if the session is local, as in tests; on a cluster that is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    now = jsc.getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tracewright-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path for a written table or stream below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: computed once, read by several branches."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, over as many partitions as ``spark.tracewright.scan.partitions`` names; as it is where that is unset.

    For sessions over tables of few files, before work that is heavy per row.
    """
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df
