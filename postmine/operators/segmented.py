"""Exact ranks inside groups of any size, without a window over a whole group.

Rows are range-partitioned and sorted by (group, order), so a large group lies in several neighbouring
partitions and a small one shares a partition with others. A row's rank is its place among its group's rows
in its partition plus the group's rows in earlier partitions (segmented prefix sums over one count per
group and partition). The sorted rows are written once, so places never change when a task is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def segment_rank(df: DataFrame, keys: list[str], order: list[Column], rank_col: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add ``rank_col``: 1-based place of each row in its group by ``order``. Null keys are a group. Rows of equal
    order have consecutive ranks."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    t = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    t = materialize(t).withColumn("_part", F.shiftright("_row", 33))
    counts = t.groupBy("_part", *keys).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a group's partitions
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    starts = starts.withColumnsRenamed({c: f"_s{i}" for i, c in enumerate(["_part", *keys])})
    same = F.col("_part") == F.col("_s0")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_s{i + 1}"))
    x = t.join(starts, same)
    return x.select(*df.columns, (F.col("_row") - F.col("_first") + F.col("_before") + 1).cast("int").alias(rank_col))
