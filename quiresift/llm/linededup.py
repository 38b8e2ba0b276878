"""Removal of multi-line chunks that stand in several places.

A rolling hash over the hashes of neighbouring lines chooses where a chunk
begins, so a passage is cut alike wherever it stands and whatever precedes it.
Chunks of two lines and more that occur again, byte for byte, are removed
except where they stand first: in the smallest document id, then line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiresift.llm.columns import let
from quiresift.scratch import keep

#: Factor of the rolling hash.
FACTOR = 31


def line_hash(line: Column) -> Column:
    """32 bits of a line's digest."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_starts(hashes: Column, divisor: int, window: int) -> Column:
    """Indexes (from 0) at which a chunk begins: 0, and where the rolling hash of the last ``window`` lines divides."""

    def begins(i: Column) -> Column:
        rolled = F.get(hashes, i)
        for back in range(1, window):
            rolled = rolled + F.get(hashes, i - back) * F.lit(FACTOR**back)
        return (i == 0) | ((i >= window - 1) & (rolled % divisor == 0))

    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), begins)


def chunks(text: Column, divisor: int = 3, window: int = 2, min_lines: int = 2) -> Column:
    """Chunks of at least ``min_lines`` lines: array of (start, stop, hash, digest); stop is exclusive."""

    def of(lines: Column) -> Column:
        def cut(starts: Column) -> Column:
            spans = F.transform(starts, lambda s, k: F.struct(s.alias("start"), F.coalesce(F.get(starts, k + 1), F.size(lines)).alias("stop")))
            long = F.filter(spans, lambda c: c["stop"] - c["start"] >= min_lines)
            body = lambda c: F.array_join(F.slice(lines, c["start"] + 1, c["stop"] - c["start"]), "\n")
            return F.transform(long, lambda c: let(body(c), lambda b: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.xxhash64(b).alias("hash"), F.md5(b).alias("digest"))))

        return let(let(F.transform(lines, line_hash), lambda h: chunk_starts(h, divisor, window)), cut)

    return let(F.split(text, "\n"), of)


def repeated_spans(docs: DataFrame, divisor: int = 3, window: int = 2, min_lines: int = 2) -> DataFrame:
    """(doc_id, text_hash, spans): line spans to remove, of ``docs`` (doc_id, text, text_hash)."""
    found = docs.select("doc_id", "text_hash", F.explode(chunks(F.col("text"), divisor, window, min_lines)).alias("c"))
    found = keep(found.select("doc_id", "text_hash", "c.*"), "line-chunks")
    # Tables of keys: a join of rows with them can be split where one key has many.
    again = keep(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated-hashes")
    suspects = found.join(again, "hash", "left_semi")

    # The bytes of suspects only; equal bytes of one map task meet before the shuffle.
    places = suspects.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop", "hash", "digest")).alias("places"))
    with_text = docs.join(places.withColumnsRenamed({"doc_id": "at_id", "text_hash": "at_hash"}), F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_hash") == F.col("at_hash")))
    body = let(F.split("text", "\n"), lambda lines: F.transform("places", lambda c: F.struct(*[c[n].alias(n) for n in ("start", "stop", "hash", "digest")], F.array_join(F.slice(lines, c["start"] + 1, c["stop"] - c["start"]), "\n").alias("body"))))
    bodies = with_text.select("doc_id", "text_hash", F.explode(body).alias("c")).select("doc_id", "text_hash", "c.*")
    compared = bodies.groupBy("hash", "digest", "body").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    first = keep(compared.groupBy("hash", "digest").agg(F.count(F.lit(1)).alias("bodies"), F.min("first").alias("first")), "first-places")

    elsewhere = ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.start") == F.col("start")))
    later = suspects.join(first.where("bodies = 1").select("hash", "digest", "first"), ["hash", "digest"]).where(elsewhere).select("doc_id", "text_hash", "start", "stop")
    mixed = first.where("bodies > 1").select("hash", "digest")
    if not mixed.isEmpty():  # different bytes under one hash and digest are told apart by the bytes
        odd = bodies.join(mixed, ["hash", "digest"])
        firsts = odd.groupBy("hash", "digest", "body").agg(F.min(F.struct("doc_id", "start")).alias("first"))
        later = later.union(odd.join(firsts, ["hash", "digest", "body"]).where(elsewhere).select("doc_id", "text_hash", "start", "stop"))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def drop_repeated_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", divisor: int = 3, window: int = 2, min_lines: int = 2) -> DataFrame:
    """``docs`` with the columns ``lines`` (array, all lines) and ``kept`` (array, lines that stay) added.

    Where ``docs`` has a column of such a name, that column stays and the added
    one has as many underscores after its name as it takes. Null texts have one empty line; nothing is removed from them. Rows of equal
    id and text count as one place. Null ids stand before all others. Lines
    alone, and chunks that never begin alike, stay. Empty tables give no rows.
    """
    inner = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])) if set(docs.columns) - {id_col, text_col} else docs
    rest = ["__row"] if "__row" in inner.columns else []
    base = inner.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *rest)
    base = base.withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(base.drop("__row"), divisor, window, min_lines)
    spans = spans.withColumnsRenamed({"doc_id": "at_id", "text_hash": "at_hash"})
    out = base.join(spans, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_hash") == F.col("at_hash")), "left")
    gone = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1)))
    stay = let(gone, lambda g: F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), g), lambda i: F.get("lines", i)))
    out = out.withColumn("lines", F.split("text", "\n"))
    out = out.withColumn("kept", F.when(F.col("spans").isNull(), F.col("lines")).otherwise(stay))
    columns = [F.col("__row")[c].alias(c) for c in docs.columns] if rest else [F.col("doc_id").alias(id_col), F.col("text").alias(text_col)]
    return out.select(*columns, *[F.col(c).alias(free_name(c, docs.columns)) for c in ("lines", "kept")])


def free_name(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
