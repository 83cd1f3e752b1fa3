"""Session helpers: local sessions for tests, and lineage cutting that survives executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "fieldtrends", memory: str = "8g") -> SparkSession:
    """Small local session for tests and the benchmark; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and checkpoints.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder; a cluster without it is an error, because a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="fieldtrends-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table, for iterative jobs."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Write a table that one job reads several times, and read it back.

    Every later read prunes columns and pushes filters into Parquet, the plans stay small, sizes are
    known to the optimizer, and a lost executor costs nothing: the table is in shared storage.
    """
    path = f"{work_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
