"""Running values in two levels: within pieces of a long order first, then what the pieces before add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.shared import stored

from .windows import CHUNK

_BITS = 33


def ordered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` in global order, dealt over ``part``s of it and numbered ``at`` within each. Spark sorts by ranges; the
    result is written once, since ranges may be cut elsewhere when they are made again."""
    made = stored(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    return made.withColumn("part", F.shiftright("_m", _BITS).cast("int")).withColumn("at", F.col("_m").bitwiseAND((1 << _BITS) - 1)).drop("_m")


def running(rows: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums of each of ``keys`` up to and with the row. A part's sums are added up by part, of which a
    key has no more than there are partitions."""
    placed = ordered(rows, *keys, *order).withColumns({f"_{n}": c for n, c in sums.items()})
    each = placed.groupBy(*keys, "part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(*keys, "part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_0") for n in sums])
    within = Window.partitionBy(*keys, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(offsets, [*keys, "part"]).withColumns({n: F.col(f"_{n}_0") + F.sum(f"_{n}").over(within) for n in sums})
    return out.drop(*[f"_{n}" for n in sums], *[f"_{n}_0" for n in sums])


def numbered(rows: DataFrame, order: list, name: str = "rank", kind: str = "int") -> DataFrame:
    """``rows`` with their place in ``order``, from 1; ``kind`` is its type, long where rows may be billions."""
    placed = ordered(rows, *order)
    sizes = placed.groupBy("part").agg(F.count("*").alias("_n"))
    # a row for each partition of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(starts, "part").withColumn(name, (F.col("_first") + F.col("at") + 1).cast(kind)).drop("part", "at", "_first")


def least_after(rows: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """``rows`` with the least of ``value`` over the row and all that come after it in ``order``."""
    placed = ordered(rows.withColumn("_v", value), *order)
    each = placed.groupBy("part").agg(F.min("_v").alias("_v"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = each.select("part", F.min("_v").over(later).alias("_later"))
    within = Window.partitionBy("part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(carry, "part").withColumn(name, F.least(F.min("_v").over(within), F.col("_later"))).drop("part", "at", "_v", "_later")


def carried(rows: DataFrame, value: Column, name: str, index: str = "i", size: int = CHUNK, inclusive: bool = True) -> DataFrame:
    """``rows`` (symbol, ``index``) with the last ``value`` that isn't null at the row or before it (before it only, where
    not ``inclusive``), however far back: within chunks of a symbol, then from the ends of the chunks before."""
    return all_carried(rows, {name: value}, index, size, inclusive)


def all_carried(rows: DataFrame, values: dict[str, Column], index: str = "i", size: int = CHUNK, inclusive: bool = True) -> DataFrame:
    """As ``carried``, for several columns in one pass."""
    cut = rows.withColumn("_c", F.floor(F.col(index) / size)).withColumns({f"_v_{n}": c for n, c in values.items()})
    frame = Window.partitionBy("symbol", "_c").orderBy(index).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ends = cut.groupBy("symbol", "_c").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(index))).alias(f"_end_{n}") for n in values])
    before = Window.partitionBy("symbol").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("symbol", "_c", *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}") for n in values])
    out = cut.withColumns({f"_here_{n}": F.last(f"_v_{n}", ignorenulls=True).over(frame) for n in values}).join(carry, ["symbol", "_c"])
    return out.withColumns({n: F.coalesce(f"_here_{n}", f"_carry_{n}") for n in values}).drop("_c", *[f"_{k}_{n}" for n in values for k in ("v", "here", "carry")])


def counted(rows: DataFrame, hit: Column, name: str, index: str = "i", size: int = CHUNK) -> DataFrame:
    """``rows`` (symbol, ``index``) with how often ``hit`` held at the row or before it, by chunks as above."""
    cut = rows.withColumn("_c", F.floor(F.col(index) / size)).withColumn("_h", F.when(hit, 1).otherwise(0))
    frame = Window.partitionBy("symbol", "_c").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("symbol").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("symbol", "_c").agg(F.sum("_h").alias("_n"))
    starts = sums.select("symbol", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return cut.join(starts, ["symbol", "_c"]).withColumn(name, (F.col("_first") + F.sum("_h").over(frame)).cast("long")).drop("_c", "_h", "_first")
