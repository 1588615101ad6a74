"""Numbering rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import materialise


def number_within(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name`` = 1, 2, ... within each group by the order given (nulls last); without a group over all rows.

    Rows are range-partitioned by group and order, so a group with a third of all rows lies in many partitions; each
    partition numbers its own part and adds the rows of the group that lie before it.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    placed = materialise(df.repartitionByRange(*[F.col(c) for c in group], *by).withColumn("_part", F.spark_partition_id()), "ordered")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, "_part"]
    parts = placed.groupBy(*keys).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    side = {k: f"_side_{i}" for i, k in enumerate(keys)}
    own = placed.withColumn("_own", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*by)))
    joined = own.join(parts.withColumnsRenamed(side), [F.col(k).eqNullSafe(F.col(name_)) for k, name_ in side.items()], "left")
    return joined.select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))
