"""A store of page features that scans add to: what is new, upserts, maintenance and audits.

Tables are immutable DataFrames here: an upsert returns the table after it, to
be written beside the old one and swapped in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresift.functions.text import normal_path

#: What tells whether a stored book is still the one at hand; sampling is part of it.
KEY = ["path", "size", "mtime", "feat_ver", "crop_mode", "sampling"]


def delta(found: DataFrame, stored: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Books of ``found`` that no row of ``stored`` has, whatever its status: errors are not tried again."""
    return found.join(stored.select(*key).distinct(), key, "left_anti")


def hits(found: DataFrame, stored: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``found`` with the stored status and error of those that are there."""
    return found.join(stored.select(*key, "status", "error").dropDuplicates(key), key)


def upsert(stored: DataFrame, new: DataFrame, key: str = "path", order: str = "scanned_at") -> DataFrame:
    """``stored`` with ``new``: of each ``key`` the row last in ``order``, new rows before old ones that tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def touch(stored: DataFrame, seen: DataFrame, when: Column, key: str = "path") -> DataFrame:
    """``stored`` with the rows whose ``key`` is in ``seen`` marked as scanned ``when``."""
    marks = seen.select(F.col(key).alias("_seen")).distinct()
    marked = stored.join(marks, F.col(key) == F.col("_seen"), "left")
    return marked.withColumn("scanned_at", F.when(F.col("_seen").isNotNull(), when).otherwise(F.col("scanned_at"))).drop("_seen")


def upsert_pages(stored: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Pages after a scan: those of scanned books are replaced whole."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def usable(pages: DataFrame, books: DataFrame, feat_ver: str) -> DataFrame:
    """Pages that comparisons read: not blank, of sound books of this version."""
    sound = books.where((F.col("status") == "ok") & (F.col("feat_ver") == feat_ver)).select("path")
    return pages.where("NOT blank").join(sound, "path", "left_semi")


def for_books(pages: DataFrame, wanted: DataFrame, key: str = "path") -> DataFrame:
    """Pages of the books of ``wanted``; wide columns are read for these alone."""
    return pages.join(wanted.select(key).distinct(), key, "left_semi")


def purge(books: DataFrame, feat_ver: str) -> DataFrame:
    """Books without those of other versions."""
    return books.where(F.col("feat_ver") == feat_ver)


def remove(table: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def clear(table: DataFrame, keep_features: bool = False) -> DataFrame:
    return table if keep_features else table.limit(0)


def merge_paths(books: DataFrame, shares: dict[str, str] | None = None) -> DataFrame:
    """One row for each path in its normal form: the one scanned last; ``path`` is that form, ``was`` what it was."""
    normal = books.withColumn("was", F.col("path")).withColumn("path", normal_path(F.col("path"), shares))
    rank = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy(F.desc("scanned_at"), F.desc("was")))
    return normal.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def audit(books: DataFrame, pages: DataFrame, key: str = "path", idx: str = "idx", said: str = "sampled") -> DataFrame:
    """(check, subject, n): pages without a book, pages that stand twice, books whose pages are not as many as they say."""
    counted = pages.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    orphans = counted.join(books.select(key), key, "left_anti").select(F.lit("orphan pages").alias("check"), F.col(key).cast("string").alias("subject"), "n")
    twice = pages.groupBy(key, idx).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("double page").alias("check"), F.concat_ws("#", F.col(key).cast("string"), F.col(idx).cast("string")).alias("subject"), "n")
    differ = books.select(key, said).join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") != F.col(said)).select(F.lit("page count").alias("check"), F.col(key).cast("string").alias("subject"), "n")
    return orphans.unionByName(twice).unionByName(differ)


def stats(books: DataFrame, feat_ver: str) -> DataFrame:
    """One row: books, pages, sampled pages and bad books of this version."""
    own = F.col("feat_ver") == feat_ver
    return books.agg(
        F.count(F.when(own, 1)).alias("books"),
        F.coalesce(F.sum(F.when(own, F.col("pages"))), F.lit(0)).alias("pages"),
        F.coalesce(F.sum(F.when(own, F.col("sampled"))), F.lit(0)).alias("sampled"),
        F.count(F.when(own & (F.col("status") != "ok"), 1)).alias("bad"),
    )
