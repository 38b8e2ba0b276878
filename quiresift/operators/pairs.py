"""Pairs of books from pages they share: candidates, first pass, decision.

Books are rows of ``books`` (book, pages, usable) and ``items`` (book, idx,
item); an item stands for a page, and equal items score 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresift.config import Thresholds
from quiresift.functions.sequence import greedy_match, longest_chain
from quiresift.functions.text import relation
from quiresift.scratch import keep


#: Books of an item beyond which it finds candidates only together with another.
CROWDED = 64
#: Items of a book up to which every two of them are a key in sharing_two().
SHORT = 64
#: Books that of_books() sends to all executors; more are joined by a shuffle.
FEW_BOOKS = 1_000_000


def overlapping(items: DataFrame, least: int) -> DataFrame:
    """(a, b), a < b: books that share at least ``least`` items, one to one.

    Exact by prefixes: of a book's items from the rarest to the most frequent,
    all but the last ``least - 1`` find candidates, since a pair that shares
    ``least`` of them shares one of those. So the most frequent items of books
    join nothing. The k-th occurrence of an item in a book is an item of its own.
    An item on many books finds candidates only with the next one that a pair may share.
    Keys are 64-bit hashes; what they find is counted by items.
    """
    turn = F.row_number().over(Window.partitionBy("book", "item").orderBy("idx"))
    tokens = items.select("book", "item", turn.alias("turn"))
    frequency = tokens.groupBy("item", "turn").agg(F.count(F.lit(1)).alias("books")).where("books > 1")
    shared = tokens.join(frequency, ["item", "turn"])
    by_rarity = Window.partitionBy("book").orderBy("books", "item", "turn")
    placed = shared.select("book", "item", "turn", "books", F.row_number().over(by_rarity).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("book")).alias("n")).where(f"n >= {least}")
    leads = placed.where(F.col("place") <= F.col("n") - (least - 1))
    if least == 1:
        a, b = (leads.select(F.col("book").alias(k), "item", "turn") for k in "ab")
        return a.join(b, ["item", "turn"]).where("a < b").select("a", "b").distinct()
    keys = leads.where(F.col("books") <= CROWDED).select("book", F.xxhash64("item", "turn").alias("key"))
    second = placed.where(F.col("place") <= F.col("n") - (least - 2)).select("book", F.col("item").alias("item_2"), F.col("turn").alias("turn_2"), F.col("place").alias("place_2"))
    crowded = leads.where(F.col("books") > CROWDED).join(second, "book").where("place_2 > place")
    keys = keys.union(crowded.select("book", F.xxhash64("item", "turn", "item_2", "turn_2").alias("key")))
    a, b = (keys.withColumnRenamed("book", k) for k in "ab")
    asked = a.join(b, "key").where("a < b").select("a", "b").distinct()
    own = placed.select("book", "item", "turn")
    left = asked.join(own.withColumnRenamed("book", "a"), "a")
    both = left.join(own.withColumnRenamed("book", "b"), ["b", "item", "turn"])
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(f"shared >= {least}").select("a", "b")


def of_books(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` of books that are in ``pairs`` (a, b), a table that can be read twice."""
    books = pairs.select(F.col("a").alias("book")).union(pairs.select("b")).distinct()
    few = pairs.count() * 2 <= FEW_BOOKS
    return rows.join(F.broadcast(books) if few else books, "book", "left_semi")


def sharing_two(items: DataFrame) -> DataFrame:
    """(a, b), a < b: as overlapping(items, 2), for many short books whose items are on many books each.

    items: (book, item). Every two items of a book are a key, so a pair is found
    only by what it shares, not by one frequent item; keys of one book alone go
    before books meet. A book of more than SHORT items meets the others by single
    items instead, counted by pairs. Moved are the items once and the keys once.
    """
    items = items.where("book IS NOT NULL AND item IS NOT NULL").select("book", "item")
    held = keep(items.repartition("book").groupBy("book").agg(F.sort_array(F.collect_list("item")).alias("held")).where("size(held) > 1"), "books-held")
    turn = lambda at, item: F.expr(f"{at} - array_position(held, {item}) + 2")  # noqa: E731  of equal items, which follow one another
    one = held.where(F.size("held") <= SHORT).select("book", "held", F.posexplode("held").alias("at", "item"))
    two = one.select("book", "held", "at", "item", F.posexplode(F.expr("slice(held, at + 2, size(held))")).alias("after", "other"))
    keys = two.select("book", F.xxhash64("item", turn("at", "item"), "other", turn("at + 1 + after", "other")).alias("key"))
    met = keep(keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").select("book", "key"), "books-met")
    a, b = (met.withColumnRenamed("book", k) for k in "ab")
    asked = keep(a.join(b, "key").where("a < b").select("a", "b").distinct(), "books-asked")
    tokens = lambda df: df.select("book", "held", F.posexplode("held").alias("at", "item")).select("book", "item", turn("at", "item").alias("turn"))
    side = lambda df, k: tokens(df).withColumnRenamed("book", k)
    own = keep(of_books(held, asked), "books-own")
    both = asked.join(side(own, "a"), "a").join(side(own, "b"), ["b", "item", "turn"])
    long = keep(held.where(F.size("held") > SHORT), "books-long")
    if not long.isEmpty():
        all_, few = side(held, "x"), side(long, "y")
        longs = long.select(F.col("book").alias("x"), F.lit(True).alias("also"))
        # Two long books meet once, from the lesser.
        crossed = all_.join(few, ["item", "turn"]).join(longs, "x", "left").where("x <> y AND (also IS NULL OR x < y)")
        both = both.select("a", "b").unionAll(crossed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2").select("a", "b")


def worth_asking(items: DataFrame, books: DataFrame, limits: Thresholds) -> DataFrame:
    """(a, b), a < b: books that share enough items, one to one, for first_pass(): pre_min, or pre_ratio of the shorter book.

    Exact by prefixes as overlapping(). What a pair needs is the lesser need of
    its books, so a book has leads for each need up to its own.
    """
    need = F.greatest(F.lit(1), F.least(F.lit(limits.pre_min), F.ceil(F.lit(limits.pre_ratio) * F.col("usable") - F.lit(1e-9)))).cast("int")
    turn = F.row_number().over(Window.partitionBy("book", "item").orderBy("idx"))
    tokens = items.select("book", "item", turn.alias("turn"))
    frequency = tokens.groupBy("item", "turn").agg(F.count(F.lit(1)).alias("books")).where("books > 1")
    by_rarity = Window.partitionBy("book").orderBy("books", "item", "turn")
    placed = tokens.join(frequency, ["item", "turn"]).join(books.select("book", need.alias("need")), "book")
    placed = placed.select("book", "item", "turn", "need", F.row_number().over(by_rarity).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("book")).alias("n"))
    leads = placed.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("need")))).where("place <= n - (k - 1)").select("book", "item", "turn", "k", "need")
    a, b = (leads.withColumnsRenamed({"book": s, "need": f"need_{s}"}) for s in "ab")
    asked = a.join(b, ["item", "turn", "k"]).where("a < b AND least(need_a, need_b) = k").select("a", "b", "k").distinct()
    own = placed.select("book", "item", "turn")
    both = asked.where("k > 1").join(own.withColumnRenamed("book", "a"), "a").join(own.withColumnRenamed("book", "b"), ["b", "item", "turn"])
    enough = both.groupBy("a", "b", "k").agg(F.count(F.lit(1)).alias("shared")).where("shared >= k")
    return asked.where("k = 1").select("a", "b").union(enough.select("a", "b"))


def equal_cells(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cells, rough): for each of ``pairs`` the places (a_idx, b_idx, score 1) of equal items, one to one; rough: how many places are equal at all.

    The k-th occurrence of an item in one book goes with the k-th in the other,
    which is what a greedy match of all equal places takes; so a line that two
    books repeat thousands of times gives thousands of cells, not millions.
    """
    turn = F.row_number().over(Window.partitionBy("book", "item").orderBy("idx"))
    placed = items.select("book", "item", "idx", turn.alias("turn"))
    side = lambda k: placed.select(F.col("book").alias(k), F.col("idx").alias(f"{k}_idx"), "item", "turn")
    cells = pairs.join(side("a"), "a").join(side("b"), ["b", "item", "turn"]).groupBy("a", "b").agg(F.collect_list(F.struct("a_idx", "b_idx", F.lit(1.0).alias("score"))).alias("cells"))
    times = items.groupBy("book", "item").agg(F.count(F.lit(1)).alias("times"))
    of = lambda k: times.select(F.col("book").alias(k), "item", F.col("times").alias(f"{k}_times"))
    rough = pairs.join(of("a"), "a").join(of("b"), ["b", "item"]).groupBy("a", "b").agg(F.sum(F.col("a_times") * F.col("b_times")).alias("rough"))
    return cells.join(rough, ["a", "b"])


def matches_of(cells: DataFrame, least: float) -> Column:
    """The greedy matches of ``cells``; those of equal_cells() are one to one as they are."""
    if "rough" not in cells.columns:
        return greedy_match(F.col("cells"), least)
    return F.array_sort(F.transform(F.filter("cells", lambda c: c["score"] >= least), lambda c: F.struct(c["a_idx"].cast("int").alias("a_idx"), c["b_idx"].cast("int").alias("b_idx"), c["score"].cast("double").alias("score"))))


def first_pass(cells: DataFrame, books: DataFrame, limits: Thresholds) -> DataFrame:
    """Pairs worth an exact look: enough cells, then enough matches and a long enough chain, in number or in share."""
    sized = with_sizes(cells, books)
    enough = lambda n: (n >= limits.pre_min) | (n >= F.lit(limits.pre_ratio) * F.col("span"))
    if "rough" not in cells.columns:
        sized = sized.withColumn("rough", F.size(F.filter("cells", lambda c: c["score"] >= limits.coarse)))
    matched = sized.where(enough(F.col("rough"))).withColumn("matches", matches_of(cells, limits.coarse))
    chained = matched.withColumn("n_match", F.size("matches")).withColumn("chain", longest_chain(F.col("matches")))
    return chained.where(enough(F.col("n_match")) & enough(F.col("chain"))).select("a", "b", "rough", "n_match", "chain")


def with_sizes(pairs: DataFrame, books: DataFrame) -> DataFrame:
    side = lambda k: books.select(F.col("book").alias(k), F.col("usable").alias(f"usable_{k}"), F.col("pages").alias(f"pages_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("span", F.least("usable_a", "usable_b"))


def scored(cells: DataFrame, books: DataFrame, limits: Thresholds) -> DataFrame:
    """Every pair's matches, n_match, chain, ratio, score, pages_agree and relation."""
    out = with_sizes(cells, books).withColumn("matches", matches_of(cells, limits.page)).withColumn("n_match", F.size("matches"))
    out = out.withColumn("chain", longest_chain(F.col("matches"))).withColumn("ratio", F.col("chain") / F.col("span"))
    total = F.aggregate("matches", F.lit(0.0), lambda s, m: s + m["score"])
    out = out.withColumn("score", F.when(F.col("n_match") > 0, total / F.col("n_match"))).withColumn("pages_agree", F.forall("matches", lambda m: m["a_idx"] == m["b_idx"]))
    return out.withColumn("relation", relation(F.col("pages_agree"), F.col("pages_a") == F.col("pages_b")))


def same_book(limits: Thresholds) -> Column:
    """Condition on scored() that holds for accepted pairs."""
    n, chain = F.col("n_match"), F.col("chain")
    long = F.lit(False) if limits.chain_floor <= 0 else chain >= limits.chain_floor
    return (n >= limits.min_pages) & (chain >= limits.min_pages) & ((F.col("ratio") >= limits.ratio) | long) & (chain >= F.lit(limits.in_order) * n)


def accepted(cells: DataFrame, books: DataFrame, limits: Thresholds) -> DataFrame:
    """(a, b, chain, n_match, ratio, score, relation, matches) of pairs that are the same book."""
    return scored(cells, books, limits).where(same_book(limits)).select("a", "b", "chain", "n_match", "ratio", "score", "relation", "matches")


def frequent_items(items: DataFrame, least_books: int) -> DataFrame:
    """(item, books, places): items on pages of at least ``least_books`` books."""
    return items.groupBy("item").agg(F.countDistinct("book").alias("books"), F.count(F.lit(1)).alias("places")).where(F.col("books") >= least_books)
