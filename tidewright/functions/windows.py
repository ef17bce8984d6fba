"""Windows over long streams: rows are cut into chunks, each with the rows before it that its frames reach."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 10_000


def chunked(rows: DataFrame, halo: int, after: int = 0, size: int = CHUNK, index: str = "i") -> DataFrame:
    """``rows`` with ``chunk`` and ``own``. The last ``halo`` rows of a chunk are there for the next one too (the first
    ``after`` for the one before), where ``own`` is false, so a symbol's stream is dealt over many tasks and bounded
    frames give what they would over the whole stream. A row may serve several chunks where ``halo`` exceeds ``size``."""
    first = F.floor((F.col(index) - after) / size) if after else F.floor(F.col(index) / size)
    last = F.floor((F.col(index) + halo) / size)
    chunk = F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("chunk")
    return rows.select("*", chunk).withColumn("own", F.floor(F.col(index) / size) == F.col("chunk"))


def own(rows: DataFrame) -> DataFrame:
    return rows.filter("own").drop("chunk", "own")


def stream(index: str = "i"):
    return Window.partitionBy("symbol", "chunk").orderBy(index)


def last(n: int, index: str = "i"):
    """The frame of the current row and the ``n - 1`` before it."""
    return stream(index).rowsBetween(-(n - 1), 0)


def frame(a: int, b: int, index: str = "i"):
    return stream(index).rowsBetween(a, b)


_gathered: dict[str, Column] | None = None


def shared(name: str, build: Callable[[], Column]) -> Column:
    """A window aggregate that several features use. While ``with_shared`` gathers features it is a column made once; Spark
    evaluates equal window expressions of one row as often as they are written."""
    if _gathered is None:
        return build()
    if name not in _gathered:
        _gathered[name] = build()
    return F.col(name)


def with_shared(rows: DataFrame, columns: dict[str, Callable[[], Column]]) -> DataFrame:
    """``rows`` with ``columns``, whose shared aggregates are made first and dropped last."""
    global _gathered
    _gathered = {}
    try:
        made, frames = {k: v() for k, v in columns.items()}, _gathered
    finally:
        _gathered = None
    return rows.withColumns(frames).withColumns(made).drop(*frames)


def agg(f: str, x: str, a: int, b: int = 0) -> Column:
    """The aggregate ``f`` of ``x`` from ``a`` rows on (negative: before) to ``b``, shared."""
    return shared(f"_{f}_{x}_{a}_{b}".replace("-", "m"), lambda: getattr(F, f)(x).over(frame(a, b)))


def back(x: str, k: int) -> Column:
    """``x`` of ``k`` rows before, shared."""
    return shared(f"_lag_{x}_{k}", lambda: F.lag(x, k).over(stream())) if k else F.col(x)


def over(a: Column, b: Column) -> Column:
    """``a / b``, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def js_round(x: Column) -> Column:
    """Rounds half towards plus infinity."""
    return F.floor(x + 0.5)


def rounded(rows: DataFrame, *keep: str, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison, negative zero made zero, other columns as they are."""
    return rows.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in rows.dtypes])


def rounded_array(x: np.ndarray, places: int) -> np.ndarray:
    """``x`` rounded half away from zero by scaling, as DuckDB does; what is too large to have so many places stays as it is."""
    scaled = np.abs(x) * 10.0**places
    return np.where(scaled < 2.0**52, np.copysign(np.floor(scaled + 0.5) / 10.0**places, x), x)
