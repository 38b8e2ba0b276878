"""Mixing of sources to target weights along a time-varying curriculum.

Each source gets a target of words by its weight. Its documents, in an order
drawn from their ids, form a stream that is passed through again until the
target is met. Training time runs from 0 to 1; the demand of a source at time t
is its weight schedule, linear in t, integrated from 0 to t. A document's
position is the time at which the source's cumulative demand reaches the
document's first word: the inverse of that integral. The result is sorted by
position over range partitions.

Prefix sums are taken in buckets of about ``bucket_rows`` documents of one
source, and these on shelves, so that no task holds a whole source, however
large. Rows alike in source, id and size are one until their positions are
given out, so that an id on many rows does not fill a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresift.llm.columns import word_count
from quiresift.llm.sizes import small
from quiresift.scratch import keep

#: 15 hexadecimal digits of a digest: the order of a source's documents.
ORDER_SPAN = float(16**15)
#: Rows of the table of sources up to which it is broadcast, if its bytes are few; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Buckets of a source whose sums one task orders.
SHELF = 1024


def draw(doc_id: Column) -> Column:
    """A number from 0 to 16**15 - 1 that orders the documents of a source; the same in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(per_source: DataFrame, weights: Sequence[float], share: float, max_repeats: float) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size).

    Sources take ``weights`` in turn, by code point, null last. A target is
    ``level * weight`` but no more than ``max_repeats`` times the source's
    size; the level is such that targets sum to ``share`` of all words. With
    sources ordered by the level at which they fill up, the level that holds if
    exactly the sources before one are full is largest at the right one.
    The window orders one row a source, no documents.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    filling = Window.orderBy("full_at", F.asc_nulls_last("source"))
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        per_source.withColumn("weight", turn)
        .withColumn("most", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("target", F.least("most", F.max("level").over(everything) * F.col("weight")))
        .select("source", "source_size", "n_docs", "turn_no", "weight", "target")
    )


def when_reached(portion: Column, slope: Column) -> Column:
    """Time at which a schedule 1 + slope * (2 t - 1) has met ``portion`` (0 to 1) of its demand.

    The integral is (1 - slope) t + slope t^2; this form of its inverse also holds for slope 0.
    """
    rest = F.lit(1.0) - slope
    return F.when(portion <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * portion / (rest + F.sqrt(rest * rest + F.lit(4.0) * slope * portion)))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    slopes: Sequence[float] = (-0.5, 0.0, 0.5),
    share: float = 1.5,
    max_repeats: int = 2,
    bucket_rows: int = 1024,
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, copies, position, positions; sorted by position.

    taken: words that the mix takes, repeats counted; a source's sum to its
    target without the fraction, as the last document of the stream is cut.
    copies: passes that take any of it. position: 0 to 1, null if nothing is
    taken. positions: one for each pass that takes words, the first as position.
    slopes (-1 to 1): how a source's weight changes, in turn as weights.

    Null ids, texts and sources are values like others (size 0, one source of
    null); rows that repeat an id are documents of their own; empty tables give
    no rows. Other columns of ``docs`` play no part.
    """
    if not (len(slopes) and all(-1 <= a <= 1 for a in slopes) and all(w > 0 for w in weights)):
        raise ValueError("weights are positive, slopes from -1 to 1")
    column = lambda c: F.col(f"`{c}`")
    sized = keep(docs.select(column(id_col).alias("doc_id"), column(source_col).alias("source"), word_count(column(text_col)).alias("size")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per_source = per_source.withColumn("turn_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    slope = F.element_at(F.array(*[F.lit(float(a)) for a in slopes]), (F.col("turn_no") % len(slopes) + 1).cast("int"))
    sources = targets(per_source, weights, share, max_repeats).withColumn("slope", slope).withColumn("buckets", F.ceil(F.col("n_docs") / F.lit(float(bucket_rows))))
    sources = small(keep(sources, "mix-sources"), BROADCAST_SOURCES)

    rows = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("alike"))
    rows = rows.join(sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    rows = rows.withColumn("drawn", draw(F.col("doc_id"))).withColumn("bucket", F.floor(F.col("drawn") / F.lit(ORDER_SPAN) * F.col("buckets")))
    words = F.col("size") * F.col("alike")
    sums = keep(rows.groupBy("source", "bucket").agg(F.sum(words).alias("words")).withColumn("shelf", F.floor(F.col("bucket") / F.lit(SHELF))), "mix-buckets")
    until = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    shelves = sums.groupBy("source", "shelf").agg(F.sum("words").alias("words"))
    shelves = shelves.select(F.col("source").alias("on_source"), F.col("shelf").alias("on"), F.coalesce(F.sum("words").over(until("source", "shelf")), F.lit(0)).alias("shelf_start"))
    starts = sums.withColumn("shelf_sum", F.coalesce(F.sum("words").over(until("source", "shelf", "bucket")), F.lit(0))).join(shelves, F.col("source").eqNullSafe(F.col("on_source")) & (F.col("shelf") == F.col("on")))
    starts = starts.select(F.col("source").alias("named"), F.col("bucket").alias("of"), (F.col("shelf_start") + F.col("shelf_sum")).alias("bucket_start"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("named")) & (F.col("bucket") == F.col("of")))
    inside = Window.partitionBy("source", "bucket").orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("bucket_start") + F.coalesce(F.sum(words).over(inside), F.lit(0)))
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1))).withColumn("start", F.col("start") + F.col("size") * F.col("turn"))

    wanted = F.floor("target")
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), wanted - (F.col("start") + F.col("source_size") * e))) for e in range(max_repeats)]
    at = lambda e: F.round(when_reached((F.col("start") + F.col("source_size") * e) / F.col("target"), F.col("slope")), 9)
    return (
        rows.withColumn("taken", sum(passes[1:], passes[0]).cast("long"))
        .withColumn("copies", sum([F.when(p > 0, 1).otherwise(0) for p in passes[1:]], F.when(passes[0] > 0, 1).otherwise(0)).cast("int"))
        .withColumn("position", F.when(F.col("taken") > 0, at(0)))
        .withColumn("positions", F.array_compact(F.array(*[F.when(p > 0, at(e)) for e, p in enumerate(passes)])))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position", "positions")
        .orderBy(F.asc_nulls_last("position"), "doc_id")
    )
