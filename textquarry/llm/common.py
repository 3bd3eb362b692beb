"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

import ctypes
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.session import BATCH_BYTES, bounded_batches, shared_dir, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: list[tuple[str, Callable[[], None]]] = []


def _trim() -> None:
    """Gives freed memory back to the system."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def holds_cache(owner: str, clear: Callable[[], None]) -> None:
    """Called in a Python worker by an operator that keeps a cache there: Spark reuses workers, so what another one keeps goes.

    ``clear`` is what frees the caller's cache in its turn.
    """
    if _held and _held[0][0] != owner:
        _held.pop()[1]()
        _trim()
    _held[:] = [(owner, clear)]


def release(clear: Callable[[], None]) -> None:
    """Called at the end of a task: a worker that then waits for others' work, or none, keeps no cache through later stages."""
    clear()
    _trim()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spans_string(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
