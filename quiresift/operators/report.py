"""Reports on groups: members, the copy to keep, groups by what they waste, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresift.functions.text import basename, suspects
from quiresift.operators.numbering import numbered

#: A copy's resolution counts as the best from this share of the group's best. Fixed value.
PX_SHARE = 0.85
#: Most items of one removal. Fixed value.
MOST_REMOVED = 500


def relations(pairs: DataFrame) -> DataFrame:
    """Each pair from either side: (book, peer, chain, n_match, ratio, score, relation, matches (own_idx, peer_idx, score))."""
    rest = ["chain", "n_match", "ratio", "score", "relation"]
    turn = lambda own, peer: F.transform("matches", lambda m: F.struct(m[own].alias("own_idx"), m[peer].alias("peer_idx"), m["score"].alias("score")))
    one = pairs.select(F.col("a").alias("book"), F.col("b").alias("peer"), *rest, turn("a_idx", "b_idx").alias("matches"))
    two = pairs.select(F.col("b").alias("book"), F.col("a").alias("peer"), *rest, turn("b_idx", "a_idx").alias("matches"))
    return one.unionByName(two)


def members(groups: DataFrame, pairs: DataFrame, books: DataFrame) -> DataFrame:
    """Books of each group with their greatest score, chain and ratio, the best relation's peer and label, and place in the group.

    books: (book, path, size, px). Place: by falling score, then lower-case path.
    """
    placed = groups.select("book", "grp")
    peers = placed.withColumnsRenamed({"book": "peer", "grp": "peer_grp"})
    inside = relations(pairs).join(placed, "book").join(peers, "peer").where("grp = peer_grp")
    best = F.max_by(F.struct("peer", "relation"), F.struct("score", (-F.col("peer")).alias("back")))
    told = inside.groupBy("book").agg(F.max("score").alias("score"), F.max("chain").alias("matched"), F.max("ratio").alias("ratio"), best.alias("best"))
    rows = placed.join(books, "book").join(told, "book", "left")
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), F.lower("path"), "book"))
    return rows.select("grp", "book", "path", "size", "px", "score", "matched", "ratio", F.col("best.peer").alias("peer"), F.col("best.relation").alias("relation"), place.alias("place"))


def keep_first() -> list[Column]:
    """Order in a group by which copy is best kept; needs columns path, size, px and px_best."""
    near_best = F.when((F.col("px_best") <= 0) | (F.col("px") >= F.col("px_best") * PX_SHARE), 0).otherwise(1)
    return [suspects(basename(F.col("path"))), near_best, F.length("path"), F.desc("size"), F.desc(F.lower("path")), F.asc("book")]


def with_keep(rows: DataFrame) -> DataFrame:
    """``rows`` of members() with ``kept``: true for one copy of each group."""
    best = rows.withColumn("px_best", F.max("px").over(Window.partitionBy("grp")))
    return best.withColumn("kept", F.row_number().over(Window.partitionBy("grp").orderBy(*keep_first())) == 1).drop("px_best")


def group_report(rows: DataFrame) -> DataFrame:
    """One row a group: members, total and wasted size, greatest score and chain; numbered from the most wasted.

    rows: with_keep(). Groups are numbered over range partitions.
    """
    told = rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("size").alias("total_size"),
        F.sum(F.when(F.col("kept"), 0).otherwise(F.col("size"))).alias("wasted"),
        F.max("score").alias("score"),
        F.max("matched").alias("matched"),
        F.max(F.when(F.col("kept"), F.col("book"))).alias("keep_book"),
    )
    return numbered(told, [F.desc("wasted"), F.desc("score"), F.asc("grp")], "gid")


def named(rows: DataFrame, part: str) -> DataFrame:
    """All members of groups of which one's path holds ``part``, in any case."""
    hit = rows.where(F.lower("path").contains(part.lower())).select("grp").distinct()
    return rows.join(hit, "grp", "left_semi")


def keep_override(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` of with_keep() with the books of ``chosen`` (book) kept in their groups instead."""
    picked = rows.join(chosen.select("book").distinct(), "book", "left_semi").groupBy("grp").agg(F.min("book").alias("pick"))
    return rows.join(picked, "grp", "left").withColumn("kept", F.when(F.col("pick").isNotNull(), F.col("book") == F.col("pick")).otherwise(F.col("kept"))).drop("pick")


def removal_plan(rows: DataFrame, recycle: str, chosen: DataFrame | None = None, most: int = MOST_REMOVED) -> DataFrame:
    """(turn, book, path, target): copies to move, nothing is moved yet; at most ``most``, by group and path.

    chosen: (book); without it, all copies that are not kept. A name that
    is taken earlier in the plan gets __1, __2 and so on before its extension.
    """
    wanted = rows.where(~F.col("kept"))
    if chosen is not None:
        wanted = rows.join(chosen.select("book").distinct(), "book", "left_semi")
    first = wanted.orderBy("grp", "path", "book").limit(most)
    name = basename(F.col("path"))
    stem, ending = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    again = F.row_number().over(Window.partitionBy(name).orderBy("grp", "path", "book")) - 1
    target = F.concat(F.lit(recycle.rstrip("/") + "/"), F.when(again == 0, name).otherwise(F.concat(stem, F.lit("__"), again.cast("string"), ending)))
    return first.select(F.row_number().over(Window.orderBy("grp", "path", "book")).alias("turn"), "book", "path", target.alias("target"))


def summary(books: DataFrame, items: DataFrame, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: books, pages, pairs, groups, books in groups, wasted size."""
    one = lambda df, **aggs: df.agg(*[v.alias(k) for k, v in aggs.items()]).withColumn("one", F.lit(1))
    out = one(books, books=F.count(F.lit(1))).join(one(items, pages=F.count(F.lit(1))), "one").join(one(pairs, pair_hits=F.count(F.lit(1))), "one")
    out = out.join(one(rows, groups=F.countDistinct("grp"), dup_books=F.count(F.lit(1)), wasted=F.coalesce(F.sum(F.when(F.col("kept"), 0).otherwise(F.col("size"))), F.lit(0))), "one")
    return out.drop("one")
