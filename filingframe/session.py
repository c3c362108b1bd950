"""Session helper for tests, benches and notebooks (clusters bring their own session)."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Set only when the session does not say otherwise.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, app: str = "filingframe", **conf: str) -> SparkSession:
    """A local session sized for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FILINGFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory used to cut lineage.

    A cluster names a shared folder in ``spark.checkpoint.dir``; a folder of our own is
    only made for a local master where that setting is absent, and removed when Python ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="filingframe-ckpt-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared checkpoint folder (a temporary one for a local master)."""
    folder = f"{ensure_checkpoint_dir(spark)}/filingframe-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return f"{folder}/{name}"


_MADE: list[str] = []  # scratch folders of this driver


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables made inside, on leaving: ``with scratch_scope(spark): query(spark, path).write.parquet(out)``.

    Results that still read them must be written before the end; folders that others have made below
    the shared one are left alone.
    """
    start = len(_MADE)
    try:
        yield
    finally:
        for folder in _MADE[start:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _MADE[start:]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and its size is known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
