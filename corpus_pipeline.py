"""A corpus pipeline over documents: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents. Null and repeated rows
pass as the operators' docstrings say; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresift.llm import curriculum, decontam, hyperminhash, linededup, quality
from quiresift.llm.queries import fold, table
from quiresift.scratch import keep

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject; it is fitted outside the held-out fold."""
    machine = quality.fit_on(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return docs.where(quality.score_column(machine, F.col("text"), spark) >= LEAST_QUALITY)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand earlier, n_chars to match; documents of which nothing stays go."""
    cut = linededup.drop_repeated_chunks(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")))
    cut = cut.where("size(kept) > 0").select("document", (F.size("kept") < F.size("lines")).alias("less"), F.array_join("kept", "\n").alias("rest"))
    new = {"text": F.col("rest"), "n_chars": F.length("rest").cast("long")}
    old = lambda c: F.col("document")[c]
    return cut.select(*[F.when(F.col("less"), new[c]).otherwise(old(c)).alias(c) if c in new else old(c).alias(c) for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies: five words a shingle, similarity 0.8."""
    kept = hyperminhash.near_duplicates(docs, shingle=5, percent=80).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    judged = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    bad = keep(judged.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("bad_hash"))
    return docs.join(decontam.small(bad), same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the curriculum takes of each document, by training position."""
    return curriculum.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: The classifier has no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
