"""Benchmark decontamination by a positional inverted index.

The index has a row for each word of each training document (term, document,
position), sorted by term within the part of the documents that a task has
read, and a row at position 0 with each document's length. Texts are cut into
words once, for the index; all counts and searches read the index.

The windows of the items are sought from their rarest terms: an entry of a
posting list at position p that is word q of an item lies on the diagonal p - q;
a window stands in a document if the lists of its rarest terms all have an
entry on one diagonal. Windows that several items share are sought once. A
diagonal is followed in stretches of an item, so that a row holds a set of
places as bits. What is left is compared word by word with the document.

Terms are 64-bit hashes of words with A-Z, and no other letters, in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiresift.llm import sizes
from quiresift.llm.columns import let, lower_ascii, words_between
from quiresift.scratch import freed, keep

#: What stands between words: all of ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of query-side tables (terms, places) up to which they are broadcast, if their bytes are few; beyond, they are shuffled.
BROADCAST_ROWS = 200_000
#: Window starts of an item that one row follows on a diagonal; a set of places is 64 bits.
STRETCH = 32
#: Rarest terms of an item that a proximity match needs, and how many words from the rarest one they may be.
NEAR_TERMS, NEAR_WORDS = 5, 20


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if its rows and bytes are few enough."""
    return sizes.small(df, BROADCAST_ROWS)


def rule_words(text: Column) -> Column:
    return words_between(lower_ascii(text), SEPARATORS)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text); rows of equal id and text are one document to the index."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return base.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def build_index(docs: DataFrame) -> DataFrame:
    """Postings (term, doc_id, text_hash, position from 1) of all words of ``docs``, and a row at position 0 with n_words for each document."""
    words = docs.select("doc_id", "text_hash", rule_words(F.col("text")).alias("words"))
    rows = words.select("doc_id", "text_hash", (F.size("words") - 2).alias("n_words"), F.posexplode("words").alias("position", "word"))
    rows = rows.where("position <= n_words")
    length = F.when(F.col("position") == 0, F.col("n_words")).alias("n_words")
    return rows.select(F.xxhash64("word").alias("term"), "doc_id", "text_hash", "position", length).sortWithinPartitions("term")


def count_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all texts of ``terms`` (distinct); those that occur."""
    return index.where("position > 0").select("term").join(small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def entries_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(entry, item_id, words) of items with an id and words; an entry is a row."""
    worded = items.select(F.col(f"`{id_col}`").alias("item_id"), rule_words(F.col(f"`{text_col}`")).alias("words")).where("item_id IS NOT NULL AND size(words) > 2")
    return worded.select(F.monotonically_increasing_id().alias("entry"), "item_id", F.slice("words", 2, F.size("words") - 2).alias("words"))


def windows_of(entries: DataFrame, window: int) -> DataFrame:
    """(phrase, item_id, entry, start, n): each run of ``window`` words of an entry, or all words of a shorter one."""
    n = F.least(F.size("words"), F.lit(window)).alias("n")
    runs = entries.select("entry", "item_id", "words", n, F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("start"))
    return runs.select(F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ").alias("phrase"), "item_id", "entry", "start", "n")


def sought(windows: DataFrame, entries: DataFrame, counts: DataFrame, rarest: int) -> DataFrame:
    """(entry, start, n, phrase, slots): each distinct window at one place where it stands, with the (place, term) of its ``rarest`` terms; none with a term that no document has."""
    once = windows.groupBy("phrase").agg(F.min(F.struct("entry", "start", "n")).alias("at")).select("phrase", "at.*")
    placed = entries.select("entry", F.posexplode("words").alias("place", "word")).select("entry", "place", F.xxhash64("word").alias("term"))
    rated = placed.join(small(counts), "term", "left").groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("seen"), "term"))).alias("placed"))
    by_count = F.sort_array(F.transform(F.slice("placed", F.col("start") + 1, F.col("n")), lambda p: F.struct(p["seen"].alias("seen"), p["place"].alias("place"), p["term"].alias("term"))))
    rated = once.join(rated, "entry").withColumn("slots", F.slice(by_count, 1, rarest)).where(F.get("slots", F.lit(0))["seen"] > 0)
    return rated.select("entry", "start", "n", "phrase", F.transform("slots", lambda s: F.struct(s["place"].alias("place"), s["term"].alias("term"))).alias("slots"))


def bit(place: Column, stretch: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place - stretch * STRETCH, F.lit(64)).cast("int"))


def candidates(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, entry, start, n, phrase, at): where the rarest terms of a window all stand as in it. windows: as from sought(); ``at`` counts words from 1."""
    stretch = F.floor(F.col("start") / F.lit(STRETCH)).cast("int")
    windows = windows.withColumn("stretch", stretch)
    needed = F.aggregate("slots", F.lit(0).cast("long"), lambda bits, s: bits.bitwiseOR(bit(s["place"], F.col("stretch"))))
    held = windows.select("entry", "stretch", F.struct("start", "n", "phrase", needed.alias("needed")).alias("w"), F.size("slots").alias("count"))
    held = keep(held.groupBy("entry", "stretch").agg(F.collect_list("w").alias("windows"), F.min("count").alias("least")), "window-stretches")
    slots = windows.select("entry", "stretch", F.explode("slots").alias("s")).select("s.term", "entry", "stretch", "s.place", bit(F.col("s.place"), F.col("stretch")).alias("bit")).distinct()
    slots = keep(slots.join(held.select("entry", "stretch", "least"), ["entry", "stretch"]), "window-slots")
    postings = index.where("position > 0").join(small(slots), "term").select("doc_id", "text_hash", "entry", "stretch", (F.col("position") - F.col("place")).alias("diagonal"), "bit", "least")
    met = postings.groupBy("doc_id", "text_hash", "entry", "stretch", "diagonal").agg(F.bit_or("bit").alias("bits"), F.max("least").alias("least")).where(F.bit_count("bits") >= F.col("least"))
    met = met.drop("least").join(held, ["entry", "stretch"])
    whole = F.filter("windows", lambda w: F.col("bits").bitwiseAND(w["needed"]) == w["needed"])
    found = met.select("doc_id", "text_hash", "entry", "diagonal", F.explode(whole).alias("w"))
    return found.select("doc_id", "text_hash", "entry", "w.start", "w.n", "w.phrase", (F.col("diagonal") + F.col("w.start")).alias("at")).where("at >= 1")


def window_matches(docs: DataFrame, index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, entry, start, at, n): every exact occurrence of ``windows`` in ``docs``, as from keyed(); ``at`` counts words from 1."""
    found = candidates(index, windows)
    places = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("entry", "start", "at", "n", "phrase")).alias("places"))
    places = keep(places.withColumnsRenamed({"doc_id": "at_id", "text_hash": "at_hash"}), "window-places")
    at = small(places.select("at_id", "at_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_hash") == F.col("at_hash"))
    texts = docs.join(at, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).join(places, same)
    body = lambda words, p: F.array_join(F.slice(words, p["at"] + 1, p["n"]), " ")
    true = let(rule_words(F.col("text")), lambda words: F.filter("places", lambda p: body(words, p) == p["phrase"]))
    return texts.select("doc_id", "text_hash", F.explode(true).alias("p")).select("doc_id", "text_hash", "p.entry", "p.start", "p.at", "p.n")


def near_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(query_id, doc_id, text_hash, at): places of a query's rarest term with all its other terms at most ``slop`` words away.

    queries: (query_id, terms array of words as the index has them). Lists are
    met block by block of ``slop`` positions, so the cost of a document follows
    its postings near the rarest term.
    """
    words = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("word"))
    terms = words.select("query_id", "word", F.xxhash64("word").alias("term"))
    postings = index.where("position > 0").select("term", "doc_id", "text_hash", "position")
    counts = keep(count_terms(index, terms.select("term").distinct()), "near-counts")
    rated = terms.join(small(counts), "term", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "term"))).alias("by_count"))
    first = F.get("by_count", F.lit(0))
    rated = keep(rated.select("query_id", F.size("by_count").alias("needed"), first["term"].alias("term"), first["n"].alias("least")).where("least > 0"), "near-rarest")
    pivots = postings.join(small(rated), "term").select("query_id", "needed", "doc_id", "text_hash", F.col("position").alias("at"))
    block = lambda c: F.floor(c / F.lit(slop)).cast("long")
    pivots = pivots.withColumn("block", F.explode(F.array(block(F.col("at")) - 1, block(F.col("at")), block(F.col("at")) + 1)))
    sought_ = keep(terms.join(rated.select("query_id"), "query_id", "left_semi").select("query_id", "term"), "near-terms")
    others = postings.join(small(sought_), "term").withColumn("block", block(F.col("position"))).withColumnsRenamed({"doc_id": "o_id", "text_hash": "o_hash", "query_id": "o_query", "block": "o_block"})
    met = pivots.join(others, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_hash") == F.col("o_hash")) & (F.col("query_id") == F.col("o_query")) & (F.col("block") == F.col("o_block")))
    met = met.where(F.abs(F.col("position") - F.col("at")) <= slop)
    return met.groupBy("query_id", "doc_id", "text_hash", "at").agg(F.size(F.collect_set("term")).alias("met"), F.max("needed").alias("needed")).where("met = needed").drop("met", "needed")


def near_items(index: DataFrame, entries: DataFrame, counts: DataFrame, terms: int, slop: int) -> DataFrame:
    """(doc_id, text_hash, near): items, as strings and sorted, whose ``terms`` rarest words stand within ``slop`` words of the rarest one."""
    words = entries.select("entry", F.explode(F.array_distinct("words")).alias("word")).withColumn("term", F.xxhash64("word"))
    rarest = words.join(small(counts), "term", "left").groupBy("entry").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))), 1, terms).alias("rarest"))
    rarest = keep(rarest.where(F.get("rarest", F.lit(0))["n"] > 0).select(F.col("entry").alias("query_id"), F.col("rarest.word").alias("terms")), "near-queries")
    found = near_matches(index, rarest, slop).select("doc_id", "text_hash", F.col("query_id").alias("entry")).distinct()
    return found.join(entries.select("entry", "item_id"), "entry").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("near"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    rarest: int = 3,
    near: bool = False,
    near_terms: int = NEAR_TERMS,
    near_words: int = NEAR_WORDS,
) -> DataFrame:
    """One row a row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items (array of strings, sorted), contaminated; with ``near``, near (the same) of proximity matches.

    A document word is hit if an occurrence of an item's window covers it; a
    document is contaminated if a twentieth of its words and more are hit. A
    proximity match has an item's ``near_terms`` rarest words (all, if it has
    fewer), in any order, at most ``near_words`` words from the rarest one;
    ties go to the smaller word.
    Null texts have no words; items without words or with a null id match
    nothing; rows that repeat an item or a document change no result, but for
    the counts that say which words are rare; null document ids are ids like
    others. An empty table of items hits nothing. Other columns play no part.
    """
    base = keyed(docs, id_col, text_col)
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_hash") == F.col("at_hash"))
    with freed():
        index = keep(build_index(base), "postings")
        lengths = keep(index.where("position = 0").select("doc_id", "text_hash", "n_words"), "text-lengths", lasting=True)
        entries = keep(entries_of(items, item_col, item_text_col), "entries")
        windows = keep(windows_of(entries, window), "windows")
        counts = keep(count_terms(index, entries.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("term")).distinct()), "term-counts")
        found = window_matches(base, index, keep(sought(windows, entries, counts, rarest), "windows-sought"))

        named = windows.groupBy("phrase").agg(F.min(F.struct("entry", "start")).alias("at"), F.collect_set(F.col("item_id").cast("string")).alias("named"))
        found = found.join(named.select("at.*", "named"), ["entry", "start"])
        per_doc = found.groupBy("doc_id", "text_hash").agg(
            F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("stop")))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("named")))).alias("items"),
        )
        covered = F.aggregate(
            "spans",
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
            lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["at"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["stop"]).alias("upto")),
        )
        hits = keep(per_doc.select(F.col("doc_id").alias("at_id"), F.col("text_hash").alias("at_hash"), covered["n"].alias("hit"), "items"), "text-hits", lasting=True)
        out = lengths.join(hits, same, "left").drop("at_id", "at_hash")
        if near:
            close = near_items(index, entries, counts, near_terms, near_words).withColumnsRenamed({"doc_id": "at_id", "text_hash": "at_hash"})
            out = out.join(keep(close, "near-items", lasting=True), same, "left")
    nothing = F.array().cast("array<string>")
    hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", nothing).alias("items"),
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
        *([F.coalesce("near", nothing).alias("near")] if near else []),
    )
