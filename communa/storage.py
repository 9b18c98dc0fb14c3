"""Materialised intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from typing import ParamSpec, TypeVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FACTOR, _CROSSED = "spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: What a byte of a table's files, and one that crossed a shuffle, counts for where Spark decides on a broadcast. A row of the written tables takes 1.1 to 6 bytes in a file, 16 to 32 in
#: a shuffle and about 50 on the driver; so by Spark's 10 MB about a million rows are broadcast, and under 3 million at worst.
INFLATED, CARRIED = 5, 8
_NAME = len("communa-") + 32
_TABLE = re.compile(r"communa-[0-9a-f]{32}")
#: The tables written in the scope that is open, by name: (session, path).
_SCOPE: ContextVar[dict[str, tuple[SparkSession, str]] | None] = ContextVar("communa_tables", default=None)

P, R = ParamSpec("P"), TypeVar("R")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where no folder is set and Spark runs on one machine (tests, laptops)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="communa-"))
        current = sc.getCheckpointDir()
    return current


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/communa-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The written path is kept on the returned DataFrame for :func:`drop`, and the scope that is open owns the table."""
    spark = df.sparkSession
    path = scratch(spark)
    if (mine := _SCOPE.get()) is not None:
        mine[path[-_NAME:]] = spark, path
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffle files of this write serve nothing after it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._communa_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that :func:`materialize` returned and nothing reads any more."""
    path = getattr(df, "_communa_path", None)
    if path:
        remove(df.sparkSession, path)
        if (mine := _SCOPE.get()) is not None:
            mine.pop(path[-_NAME:], None)


def hold(df: DataFrame) -> DataFrame:
    """Take a written table out of the scope that is open: what reads it is an RDD or a stream, which no plan of a result shows."""
    path = getattr(df, "_communa_path", None)
    if path and (mine := _SCOPE.get()) is not None:
        mine.pop(path[-_NAME:], None)
    return df


def tables_of(result: object) -> set[str]:
    """Names of the written tables that a result reads: a DataFrame, or DataFrames in a tuple, list or the fields of an object."""
    if isinstance(result, DataFrame):
        return {name for file in result.inputFiles() for name in _TABLE.findall(file)}
    if isinstance(result, (tuple, list)):
        return set().union(*map(tables_of, result))
    return set().union(*map(tables_of, vars(result).values())) if hasattr(result, "__dict__") else set()


@contextmanager
def scope() -> Iterator[Callable[[R], R]]:
    """Tables written inside are deleted at the end. The function that it gives hands those that a result reads to the scope around it, or, if there is
    none, to whoever has the result, for :func:`release`."""
    outer, mine = _SCOPE.get(), {}
    token = _SCOPE.set(mine)

    def passed(result: R) -> R:
        for name in tables_of(result) & mine.keys() if mine else ():
            held = mine.pop(name)
            if outer is not None:
                outer[name] = held
        return result

    try:
        yield passed
    finally:
        _SCOPE.reset(token)
        for spark, path in mine.values():
            remove(spark, path)


def owned(f: Callable[P, R]) -> Callable[P, R]:
    """f, of whose written tables only those stay that its result reads; none if it raises."""

    @wraps(f)
    def run(*args: P.args, **kwargs: P.kwargs) -> R:
        with scope() as passed:
            return passed(f(*args, **kwargs))

    return run


def sized(f: Callable[P, R]) -> Callable[P, R]:
    """f, in whose jobs a table is broadcast by what it takes in memory: Spark judges it by its files, and those of numbers are so well compressed that tables of millions of
    rows pass for small and go through the driver."""

    @wraps(f)
    def run(*args: P.args, **kwargs: P.kwargs) -> R:
        spark = SparkSession.getActiveSession()
        if spark is None:
            return f(*args, **kwargs)
        before = {c: spark.conf.get(c, None) for c in (_FACTOR, _CROSSED)}
        spark.conf.set(_FACTOR, str(max(float(before[_FACTOR] or 1), INFLATED)))
        if before[_CROSSED] is None:
            limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
            spark.conf.set(_CROSSED, str(limit if limit < 0 else limit // CARRIED))
        try:
            return f(*args, **kwargs)
        finally:
            for c, value in before.items():
                spark.conf.unset(c) if value is None else spark.conf.set(c, value)

    return run


def release(result: object, spark: SparkSession) -> None:
    """Delete the written tables that a result reads, once it is no longer needed."""
    for name in tables_of(result):
        remove(spark, f"{shared_dir(spark).rstrip('/')}/{name}")
