"""Table access and lineage cuts in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``, or the one the session's checkpoints were set to.

    Only where the session names none and runs on one machine, a folder of our
    own below the temporary directory is set; a cluster without one is an error,
    as its executors would each write where the others cannot read.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/folioforge-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_KEPT: list[str] = []


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It cuts lineage, survives the loss of an executor and lets several
    consumers share one computation.  The files stay until :func:`forget`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


_SHARED: ContextVar[tuple[Lock, dict[str, Future]] | None] = ContextVar("shared", default=None)


@contextmanager
def sharing() -> Iterator[None]:
    """Within it, and in copies of its context in other threads, what :func:`once` names is kept and made once."""
    before = _SHARED.set((Lock(), {}))
    try:
        yield
    finally:
        _SHARED.reset(before)


def once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``; within :func:`sharing` the table kept as ``name``, which the first caller makes and others wait for."""
    held = _SHARED.get()
    if held is None:
        return make()
    lock, made = held
    with lock:
        first = name not in made
        future = made.setdefault(name, Future())
    if first:
        try:
            future.set_result(keep(make(), name))
        except BaseException as e:
            future.set_exception(e)
    return future.result()


def forget(spark: SparkSession) -> int:
    """Delete the tables kept by this process so far, once their results are
    written; the number of tables deleted."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _KEPT:
        path = jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done
