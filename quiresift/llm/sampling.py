"""A bounded sample of labelled rows, for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresift.scratch import keep

#: Buckets of the draw.
SPAN = 1 << 30


def sample_ids(rows: DataFrame, per_class: int) -> DataFrame:
    """About ``per_class`` rows (id, label) of each label, drawn by id; ids are distinct in ``rows``."""
    rates = rates_of(rows, per_class)
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.lit(SPAN)) / F.lit(float(SPAN))
    return rows.join(rates, F.col("label") == F.col("of")).where(drawn < F.col("rate")).select("id", "label")


def rates_of(rows: DataFrame, per_class: int) -> DataFrame:
    """(of, rate): for each label the share of its rows that are ``per_class``, from counts of all rows; a table, so that its size says how it is joined."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return keep(counts.select(F.col("label").alias("of"), F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("n")).alias("rate")), "sample-rates")


def sample_rows(rows: DataFrame, per_class: int) -> DataFrame:
    """About ``per_class`` distinct rows (id, label, text) of each label, drawn by id and text; the same in every run.

    The counts that set the drawing rates cover all rows; a label with fewer
    rows gives all of them. No label is left out.
    """
    drawn = F.pmod(F.xxhash64(F.col("id"), F.col("text"), F.lit(7)), F.lit(SPAN)) / F.lit(float(SPAN))
    found = rows.withColumn("drawn", drawn).join(rates_of(rows, per_class), F.col("label") == F.col("of")).where("drawn < rate").select("id", "label", "text")
    return found.dropDuplicates(["id", "label", "text"])
