"""Session helpers: a tuned local session, shared checkpoint folders, shipping the package to workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "waymark") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own configuration."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WAYMARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def _own_folder(prefix: str) -> str:
    """A temporary folder of this process, gone when it ends."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints: the cluster's ``spark.checkpoint.dir``, else one of our own.

    Without that setting a local session checkpoints to a temporary folder; any other session uses a
    folder beside its warehouse, which all executors share.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    chosen = spark.conf.get("spark.checkpoint.dir", None)
    if not chosen:
        local = sc.master.startswith("local[") or sc.master == "local"
        chosen = _own_folder("waymark-checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(chosen)
    return sc.getCheckpointDir() or chosen


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage by files that every executor can read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once per Spark context, wherever the driver imported it from."""
    sc = spark.sparkContext
    if getattr(sc, "_waymark_shipped", False):
        return
    target = Path(_own_folder("waymark-ship-")) / "waymark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, str(Path("waymark") / source.relative_to(_PACKAGE)))
    sc.addPyFile(str(target))
    sc._waymark_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
