"""Shared helpers of the training-data operators: tables in the shared folder and batches of bounded size."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []
#: Folders of tables that open scratch() blocks will delete, the innermost last.
_scopes: list[list[str]] = []
#: Folders of this process's runs, with the file system that deletes them.
_runs: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; where none is set, a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="gritstone-"))
    return _own_dir[0]


def _run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables; it goes when the driver's process ends."""
    run = f"{shared_dir(spark)}/gritstone/{spark.sparkContext.applicationId}"
    if run not in _runs:
        if not _runs:
            atexit.register(_at_exit, os.getpid())
        path = spark._jvm.org.apache.hadoop.fs.Path(run)
        _runs[run] = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return run


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def _at_exit(pid: int) -> None:
    if os.getpid() == pid:
        from pyspark import SparkContext

        for run, files in _runs.items():
            with suppress(Exception):  # the JVM may be gone
                files.delete(SparkContext._jvm.org.apache.hadoop.fs.Path(run), True)


def clear(spark: SparkSession) -> None:
    """Delete the tables that operators of this application have stored. Results that read them must be written before."""
    _delete(spark, _run_dir(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside go at the end, but for those stored with keep=True."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def stored(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and survives lost executors.

    Inside scratch() the table goes with the block; keep=True hands it to the block outside.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    open_ = _scopes[:-1] if keep else _scopes
    if open_:
        open_[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df does not hold, in any case: the wanted ones, with underscores behind them where it does."""
    held, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about `budget` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(size + 16) - 1) // budget
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
