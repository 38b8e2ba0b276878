"""Row numbers over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresift.scratch import keep


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place, from 1, in ``order`` (a total one).

    Rows are sorted over range partitions and written with their partition and
    their place in it; only the partitions' counts are summed in one task.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = keep(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", within), "numbered-rows")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = placed.join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_at") + 1).cast("int"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], name)
