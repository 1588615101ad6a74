"""Order-dependent steps over keys of any size.

A window over a whole key would put a key that holds a third of all rows into one task. Here a key's rows lie in slices of
time: each slice is a window of its own, and what a slice must know of the ones before it is aggregated to one row per
slice and carried on over those rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 1800.0


def _attached(cut: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """``cut`` with the columns that ``side`` has besides the keys; null keys are equal."""
    names = {k: f"_side_{i}" for i, k in enumerate(keys)}
    other = side.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(name)) for k, name in names.items()]
    return cut.join(other, same, "left").drop(*names.values())


def _sliced(df: DataFrame, at: str, width: float) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(at) / width))


def with_previous(df: DataFrame, keys: list[str], at: str, tie: str, columns: list[str], name: str = "prev", width: float = SLICE_SECONDS) -> DataFrame:
    """Add struct ``name`` with ``columns`` of the row before in the key, null for its first row."""
    cut = _sliced(df, at, width)
    row = F.struct(at, tie, *[c for c in columns if c not in (at, tie)])
    here = Window.partitionBy(*keys, "_slice").orderBy(at, tie)
    ends = cut.groupBy(*keys, "_slice").agg(F.max(row).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice"))).drop("_end")
    joined = _attached(cut, ends, [*keys, "_slice"])
    return joined.withColumn(name, F.coalesce(F.lag(row).over(here), F.col("_before"))).drop("_before", "_slice")


def carried(df: DataFrame, keys: list[str], at: str, tie: str, value: Column, name: str, *, current: bool, width: float = SLICE_SECONDS) -> DataFrame:
    """Add ``name``: the last value that is not null at or (without ``current``) before the row in its key."""
    cut = _sliced(df.withColumn("_value", value), at, width)
    marked = F.when(F.col("_value").isNotNull(), F.struct(F.col(at).alias("a"), F.col(tie).alias("t"), F.col("_value").alias("v")))
    ends = cut.groupBy(*keys, "_slice").agg(F.max(marked).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end.v", ignorenulls=True).over(before)).drop("_end")
    here = Window.partitionBy(*keys, "_slice").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    joined = _attached(cut, ends, [*keys, "_slice"])
    return joined.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(here), F.col("_before"))).drop("_before", "_slice", "_value")


def running_sum(df: DataFrame, keys: list[str], at: str, tie: str, value: Column, name: str, width: float = SLICE_SECONDS) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and with the row."""
    cut = _sliced(df.withColumn("_value", value), at, width)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    here = Window.partitionBy(*keys, "_slice").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    joined = _attached(cut, parts, [*keys, "_slice"])
    return joined.withColumn(name, F.coalesce(F.sum("_value").over(here), F.lit(0)) + F.col("_before")).drop("_before", "_slice", "_value")


def islands(df: DataFrame, keys: list[str], at: str, tie: str, starts: Callable[[Column], Column], columns: list[str] | None = None, width: float = SLICE_SECONDS) -> DataFrame:
    """Add ``island``, the tie value of its first row. ``starts`` tells from the row before whether a new one starts.

    One shuffle by key and slice. Inside a slice islands are found as if each slice began one; one row per slice then tells
    whether its first island goes on from the slice before, and where that began.
    """
    row = F.struct(at, tie, *[c for c in columns or [] if c not in (at, tie)])
    here = Window.partitionBy(*keys, "_slice").orderBy(at, tie)
    seen = _sliced(df, at, width).withColumn("_row", row).withColumn("_prev", F.lag("_row").over(here))
    first = F.when(F.col("_prev").isNull() | F.coalesce(starts(F.col("_prev")), F.lit(False)), F.col(tie))
    cut = seen.withColumn("_start", first).withColumn("island", F.last("_start", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))).drop("_start", "_prev")
    ends = cut.groupBy(*keys, "_slice").agg(F.min_by("island", "_row").alias("_first"), F.max_by("island", "_row").alias("_last"), F.min("_row").alias("_head"), F.max("_row").alias("_end"))
    slices = Window.partitionBy(*keys).orderBy("_slice")
    # ``starts`` reads the later row by its column names
    joint = ends.withColumn("_before_row", F.lag("_end").over(slices)).select(*keys, "_slice", "_first", "_last", "_before_row", *[F.col("_head")[c].alias(c) for c in dict.fromkeys([at, tie, *(columns or [])]) if c not in keys])
    joint = joint.withColumn("_goes_on", F.col("_before_row").isNotNull() & ~F.coalesce(starts(F.col("_before_row")), F.lit(False)))
    own = F.when(F.col("_last") != F.col("_first"), F.col("_last")).when(~F.col("_goes_on"), F.col("_first"))
    carried_ = joint.withColumn("_own", own).withColumn("_from", F.last("_own", ignorenulls=True).over(slices.rowsBetween(Window.unboundedPreceding, -1)))
    moved = carried_.where("_goes_on").select(*keys, "_slice", "_first", "_from")
    joined = _attached(cut, moved, [*keys, "_slice"])
    return joined.withColumn("island", F.when(F.col("island") == F.col("_first"), F.col("_from")).otherwise(F.col("island"))).drop("_first", "_from", "_slice", "_row")
