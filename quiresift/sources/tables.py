"""The given tables as collections of ordered items: books with pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiresift.functions.vectors import item_hash

#: Shorter lines count as blank pages.
LEAST_LINE = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` over tasks of about ``rows`` rows by ``key``, for work that files of few bytes would leave to few cores; a core has 16 at most."""
    return df.repartition(max(1, min(-(-df.count() // rows), 16 * df.sparkSession.sparkContext.defaultParallelism)), key)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, idx from 0, line, blank): documents as books, lines as pages."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "line"))
    return docs.withColumn("blank", F.length(F.trim("line")) < LEAST_LINE)


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, idx, item) of lines that are not blank."""
    return document_lines(spark, sf_dir).where("NOT blank").select("book", "idx", item_hash(F.col("line")).alias("item"))


def document_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, path, kind, fmt, size, pages, usable, px); in one pass over each text, without a shuffle."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    usable = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) >= LEAST_LINE))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("book"),
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, " (copy).txt").otherwise(".txt"))).alias("path"),
        F.col("source").alias("kind"),
        F.col("lang").alias("fmt"),
        F.col("n_chars").alias("size"),
        F.size(lines).alias("pages"),
        usable.alias("usable"),
        F.coalesce("n_chars", F.lit(0)).alias("px"),
    )


def embedding_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, idx, vector): labels as books, vectors as pages."""
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("book"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, item, and all that tells lines apart): orders as books, parts as pages."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_partkey").alias("item"), "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")


def in_order(lines: DataFrame) -> DataFrame:
    """(book, idx, item) of order_lines(), in the order of all that tells lines apart."""
    by_line = Window.partitionBy("book").orderBy("l_linenumber", "item", "l_suppkey", "l_shipdate", "l_extendedprice")
    return lines.select("book", (F.row_number().over(by_line) - 1).alias("idx"), "item")


def turn_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, idx, item): conversations as books, turns as pages."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").cast("int").alias("idx"), item_hash(F.coalesce("text", F.lit(""))).alias("item"))
