"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture table; works for any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: int | None = None, app: str = "colonnade") -> SparkSession:
    """A local session for tests and the bench (a cluster brings its own)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "6g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the cluster's spark.checkpoint.dir if it names one; else, on a local master alone, a fresh folder that goes when Python ends.

    The folder must be shared by driver and executors, so a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


#: Folders made by scratch_folder and not yet dropped, with what deletes them.
_folders: dict[str, Callable[[], object]] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The name of a fresh folder in the shared place, for tables that are read again. It is dropped when Python ends, or by drop_folders."""
    shared_checkpoints(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(sc._jsc.hadoopConfiguration())
    if not _folders:
        atexit.register(_drop_all)
    _folders[path] = lambda: files.delete(place, True)
    return path


def scratch_folders() -> set[str]:
    """The scratch folders there are now."""
    return set(_folders)


def drop_folders(paths) -> None:
    """Deletes scratch folders; DataFrames that read them must be done with."""
    for p in paths:
        _folders.pop(p)()


def _drop_all() -> None:
    for drop in _folders.values():
        with contextlib.suppress(Exception):  # the JVM may be gone, and a file system with it
            drop()
    _folders.clear()


def shared_table(df: DataFrame) -> DataFrame:
    """Written to a scratch folder and read again, so that later work starts from files that outlive executors."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
