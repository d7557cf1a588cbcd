"""Places of rows in an order, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.sources.files import settled


def places(rows: DataFrame, group: list[str], *order: Column | str, name: str = "place") -> DataFrame:
    """Append each row's place from 1 in its group (none: among all rows) by ``order``; rows of equal order stand as they come.

    Rows are range-partitioned by group and order and written once with their place in their partition; what stands in the
    partitions before is added from a table of one row for each group and partition. Nulls of the group's columns are one group.
    """
    columns = rows.columns
    by = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    held = settled(sorted_rows).withColumn("_part", F.shiftright("_at", 33))
    held = held.withColumn("_g", F.struct(*[F.struct(F.col(g).isNull(), F.coalesce(F.col(g).cast("string"), F.lit(""))) for g in group], F.lit(0)).cast("string")) if group else held.withColumn("_g", F.lit(""))
    runs = held.groupBy("_g", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = settled(runs.select("_g", "_part", (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_shift")))
    return held.join(starts, ["_g", "_part"]).select(*columns, (F.col("_at") + F.col("_shift")).alias(name))
