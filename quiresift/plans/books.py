"""From a folder of books to groups of duplicates: scan, compare, group, report."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresift.config import PRESETS, Sampling, Thresholds
from quiresift.functions import image, vectors
from quiresift.operators import groups, pairs, report, similarity
from quiresift.scratch import keep
from quiresift.sources import library, store

#: Side of the template that is sought in a tile. Fixed value.
TEMPLATE = 48


@dataclass
class Shelf:
    """Scanned books (path, kind, fmt, size, mtime, pages, sampled, blanks, feat_ver, crop_mode, sampling, status, error, scanned_at, thumb) and pages (FEATURES)."""

    books: DataFrame
    pages: DataFrame


def scan(spark: SparkSession, root: str, before: Shelf | None = None, sampling: Sampling = PRESETS["standard"], crop: str = "bed", straighten: bool = True, most_books: int | None = None) -> Shelf:
    """The shelf after looking at ``root``: books that ``before`` has, unchanged, are not read again, nor are those that failed."""
    how = F.lit(f"{sampling.blocks},{sampling.half},{sampling.most},{straighten}")
    found = library.discover(spark, root).drop("error").withColumn("feat_ver", F.lit(image.FEATURES)).withColumn("crop_mode", F.lit(crop)).withColumn("sampling", how)
    if most_books is not None:
        found = found.orderBy("path").limit(most_books)
    new = keep(store.delta(found, before.books) if before else found, "new-books")
    only = {kind: new.where(F.col("kind") == kind) for kind in ("folder", "archive")}
    read = library.folder_pages(spark, root, sampling, only["folder"]).unionByName(library.archive_pages(spark, root, sampling, only["archive"]))
    read = keep(read, "new-pages")
    features = keep(library.page_features(read, crop, straighten), "new-features")
    told = read.groupBy("path").agg(F.max("page_count").alias("n"), F.max("error").alias("said"))
    good = features.groupBy("path").agg(F.count(F.when(F.col("error") == "", 1)).alias("sampled"), F.count(F.when(F.col("blank"), 1)).alias("blanks"))
    rows = new.join(told, "path", "left").join(good, "path", "left").join(library.thumbnails(read), "path", "left")
    sampled = F.coalesce("sampled", F.lit(0))
    status = F.when(sampled > 0, "ok").when(F.coalesce("said", F.lit("no images")) == "no images", "empty").otherwise("error")
    books = rows.select(
        "path", "kind", "fmt", "size", "mtime", F.coalesce("n", "pages", F.lit(0)).alias("pages"), sampled.alias("sampled"), F.coalesce("blanks", F.lit(0)).alias("blanks"),
        "feat_ver", "crop_mode", "sampling", status.alias("status"), F.when(status == "ok", "").otherwise(F.coalesce(F.when(F.col("said") != "", F.col("said")), F.lit("no page could be read"))).alias("error"),
        F.unix_timestamp().cast("double").alias("scanned_at"), "thumb",
    )
    pages = features.where("error = ''")
    if before:
        return Shelf(keep(store.upsert(before.books, books), "shelf-books"), keep(store.upsert_pages(before.pages, pages.join(books.select("path"), "path", "left_semi")), "shelf-pages"))
    return Shelf(keep(books, "shelf-books"), keep(pages, "shelf-pages"))


def exact_cells(candidates: DataFrame, pages: DataFrame, limits: Thresholds) -> DataFrame:
    """(a, b, cells) of ``candidates`` (a, b): page scores of at least limits.page. pages: (book, idx, phash, tile)."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["own"] == 0].sort_values("idx"), pdf[pdf["own"] == 1].sort_values("idx")
        side = image.TILE
        tiles = lambda x: np.stack([np.frombuffer(t, np.uint8) for t in x["tile"]]).reshape(-1, side, side).astype(np.float32)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "cells": []})
        left, right = tiles(a), tiles(b)
        off = (side - TEMPLATE) // 2
        t = right[:, off : off + TEMPLATE, off : off + TEMPLATE].reshape(len(right), -1)
        t = t - t.mean(1, keepdims=True)
        t_norm = np.sqrt((t * t).sum(1))
        ha, hb = a["phash"].to_numpy(np.int64), b["phash"].to_numpy(np.int64)
        area, cells = TEMPLATE * TEMPLATE, []
        for i, page in enumerate(left):
            if page.std() < 1e-3:
                continue
            views = np.lib.stride_tricks.sliding_window_view(page, (TEMPLATE, TEMPLATE)).reshape(-1, area)
            spread = np.sqrt(np.maximum((views.astype(np.float64) ** 2).sum(1) - views.sum(1, dtype=np.float64) ** 2 / area, 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                fit = np.nan_to_num((views @ t.T) / (spread[:, None] * t_norm[None, :]), nan=0.0, posinf=0.0, neginf=0.0).max(0)
            fit = np.where(t_norm / np.sqrt(area) < 1e-3, 0.0, np.maximum(fit, 0.0))
            distance = np.array([(int(ha[i]) ^ int(h)).bit_count() for h in hb])
            score = np.where(fit > vectors.LEAST_ALIGNED, vectors.ALIGNED_WEIGHT * fit + vectors.HASH_WEIGHT * np.maximum(0.0, 1 - distance / vectors.HASH_SPAN), 0.0)
            cells += [{"a_idx": int(a["idx"].iloc[i]), "b_idx": int(b["idx"].iloc[j]), "score": float(score[j])} for j in np.flatnonzero(score >= limits.page)]
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "cells": [cells]})

    side = lambda key, n: candidates.join(pages.withColumnRenamed("book", key), key).select("a", "b", F.lit(n).alias("own"), "idx", "phash", "tile")
    rows = side("a", 0).unionByName(side("b", 1))
    return rows.groupBy("a", "b").applyInPandas(compare, "a long, b long, cells array<struct<a_idx: int, b_idx: int, score: double>>").where("size(cells) > 0")


def self_test(spark: SparkSession, folder: str) -> dict[str, bool]:
    """Whether a small library, drawn into ``folder`` (shared with the executors, local to the driver), is scanned and grouped as it should be."""
    import io
    import zipfile
    from pathlib import Path

    def drawn(seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        page = np.full((240, 170), 245.0)
        for y, x, h, w, level in zip(rng.integers(5, 190, 14), rng.integers(5, 120, 14), rng.integers(8, 45, 14), rng.integers(8, 45, 14), rng.integers(0, 120, 14), strict=True):
            page[y : y + h, x : x + w] = level
        return page

    for name, seeds in (("one.cbz", range(10)), ("two.zip", range(10)), ("other.cbz", range(50, 60))):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for i, seed in enumerate(seeds):
                z.writestr(f"{i}.png", image.write_png(drawn(seed)))
        Path(folder, name).write_bytes(data.getvalue())
    shelf = scan(spark, folder, sampling=PRESETS["all"])
    found = group(shelf).members.collect()
    return {
        "all books are read": shelf.books.where("status = 'ok'").count() == 3,
        "all pages have features": shelf.pages.count() == 30,
        "copies are a group": sorted(r.path.rsplit("/", 1)[-1] for r in found) == ["one.cbz", "two.zip"],
        "one copy is kept": sum(r.kept for r in found) == 1,
    }


@dataclass
class Grouping:
    members: DataFrame
    groups: DataFrame
    pairs: DataFrame
    books: DataFrame


def group(shelf: Shelf, limits: Thresholds = Thresholds()) -> Grouping:
    """Duplicate groups of a shelf: vectors, first pass, exact scores, decision, guarded merge, reports."""
    usable = store.usable(shelf.pages, shelf.books, image.FEATURES).withColumn("book", F.xxhash64("path"))
    counted = usable.groupBy("book").agg(F.count(F.lit(1)).cast("int").alias("usable"), F.median("px").cast("long").alias("px"))
    books = keep(shelf.books.withColumn("book", F.xxhash64("path")).join(counted, "book", "left").na.fill(0, ["usable", "px"]), "grouped-books")

    @F.pandas_udf("array<float>")
    def small(maps: pd.Series) -> pd.Series:
        return maps.map(lambda m: np.frombuffer(m, np.uint8).astype(np.float32))

    found = similarity.similar_vectors(usable.select("book", "idx", small("map16").alias("vector")), limits.coarse)
    cells = found.groupBy(F.col("a_book").alias("a"), F.col("b_book").alias("b")).agg(F.collect_list(F.struct("a_idx", "b_idx", "score")).alias("cells"))
    candidates = keep(pairs.first_pass(cells, books, limits).select("a", "b"), "book-candidates")
    wanted = candidates.select(F.col("a").alias("book")).union(candidates.select("b")).distinct()
    tiles = store.for_books(usable.select("book", "idx", "phash", "tile"), wanted, "book")
    accepted = keep(pairs.accepted(exact_cells(candidates, tiles, limits), books, limits), "book-pairs")
    merged = groups.guarded_groups(accepted, books.select("book", "path", "size"), limits)
    rows = report.with_keep(report.members(merged, accepted, books.select("book", "path", "size", "px")))
    told = report.group_report(rows)
    rows = rows.join(told.select("grp", "gid"), "grp").join(books.select("book", "kind", "fmt", "pages", "sampled"), "book")
    return Grouping(keep(rows, "group-members"), told, accepted, books)
