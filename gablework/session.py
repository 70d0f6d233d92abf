"""Session helpers. On a cluster the caller's session is used as it is; these are for local runs and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gablework")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Generated methods above 8000 bytes are never compiled by the JVM; past that, unfused stages are faster.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, in local mode only, one fresh folder
    per application. The setting itself cannot be changed while a session runs."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        folder = _LOCAL_FOLDERS[context.applicationId]
    return folder


def cut_lineage(df):
    """Reliable checkpoint: survives the loss of executors, unlike cached or local blocks."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)


def written(df, compression: str = "snappy", options: dict[str, str] | None = None):
    """The rows as a table in the shared folder, read back: later plans know its true size, and it survives executors."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.options(compression=compression, **(options or {})).parquet(path)
    return spark.read.parquet(path)
