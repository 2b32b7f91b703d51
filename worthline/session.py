"""Session helpers: the shared work folder, and tables cut from their lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session that names none (as in tests) gets a temporary folder; elsewhere that is an
    error, as executors would each write to their own disks.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="worthline-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths that nobody has removed yet: those of the session, and on top of them those of every open ``scratch``.
_PATHS: list[list[str]] = [[]]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the work folder that no earlier run has used.

    What is written there belongs to the ``scratch`` that is open, and is removed with it; else it is
    removed when Python ends.
    """
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Removes on leaving every table that operators wrote to the work folder inside.

    Results are lazy and may read such tables, so they are to be consumed or written elsewhere before.
    """
    held: list[str] = []
    _PATHS.append(held)
    try:
        yield
    finally:
        _PATHS[:] = [paths for paths in _PATHS if paths is not held]
        _remove(spark, held)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    while paths:
        path = context._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _remove_rest() -> None:
    with suppress(Exception):  # the session may have ended already
        spark = SparkSession.getActiveSession()
        for paths in _PATHS if spark else ():
            _remove(spark, paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the work folder and read back.

    Later passes read the files, so a lost executor costs one re-read and values that depend on
    the physical layout (row stamps) can never change between passes.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parallel(spark: SparkSession, function: Callable, items: Sequence, threads: int) -> dict:
    """Run a fit per item from a few driver threads, so that small jobs overlap on the cluster."""
    with ThreadPoolExecutor(threads) as pool:
        jobs = {item: pool.submit(inheritable_thread_target(spark)(function), item) for item in items}
        return {item: job.result() for item, job in jobs.items()}
