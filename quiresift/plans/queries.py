"""A query for each operator, over the given tables, and its SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiresift.config import PRESETS, Thresholds
from quiresift.functions import image, vectors
from quiresift.functions.sampling import sample_pages
from quiresift.functions.sequence import longest_chain
from quiresift.functions.text import human_size, natural_key, normal_path, suspects, title_volume
from quiresift.operators import evaluate, groups, overlap, pairs, report, similarity
from quiresift.scratch import keep
from quiresift.sources import sinks, store, tables
from quiresift.streaming.ingest import run_to_table, windows_to_table

LIMITS = Thresholds()
#: The first pass of documents: fewer lines than a book has pages.
FIRST = Thresholds(pre_min=3)
#: Pages drawn by a task: some seconds' work, whatever the files.
PAGES_A_TASK = 128
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Sources, projections, names ------------------------------------------------

LINES = """
l AS (
  SELECT doc_id AS book, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS idx
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), usable AS (
  SELECT book, idx, ('0x' || substr(md5(line), 1, 15))::BIGINT AS item FROM l WHERE length(trim(line)) >= 20
), books AS (
  SELECT book, count(*) AS pages, count(*) FILTER (length(trim(line)) >= 20) AS usable FROM l GROUP BY book
)"""


@query(f"WITH {LINES} SELECT b.book, pages::INT AS pages, (pages - usable)::INT AS blanks, d.n_chars AS size FROM books b JOIN documents d ON d.doc_id = b.book")
def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = tables.document_books(spark, sf_dir)
    return books.select("book", "pages", (F.col("pages") - F.col("usable")).alias("blanks"), "size")


@query(f"WITH {LINES} SELECT book, idx::INT AS idx, ('0x' || substr(md5(line), 1, 15))::BIGINT AS item, length(trim(line)) < 20 AS blank FROM l")
def item_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.document_lines(spark, sf_dir).select("book", "idx", vectors.item_hash(F.col("line")).alias("item"), "blank")


@query(
    r"""
WITH n AS (
  SELECT page_id, regexp_replace(split_part(coalesce(url, ''), '/', 3), '^(www|m|blog)\.', '') AS host, lower(regexp_replace(coalesce(url, ''), '^.*/', '')) AS base FROM pages
), k AS (
  SELECT *, list_transform(regexp_extract_all(base, '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(length(regexp_replace(p, '^0+(\d)', '\1'))::VARCHAR, 4, '0') || regexp_replace(p, '^0+(\d)', '\1') ELSE p END) AS parts FROM n
)
SELECT page_id, host, (row_number() OVER (PARTITION BY host ORDER BY CASE WHEN regexp_matches(base, '^\d') THEN list_concat([''], parts) ELSE parts END, page_id) - 1)::INT AS idx FROM k
"""
)
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: names that are empty stand first, pages without a URL are of the host ''."""
    url = F.coalesce("url", F.lit(""))
    host = F.regexp_replace(F.coalesce(F.get(F.split(url, "/"), 2), F.lit("")), r"^(www|m|blog)\.", "")
    pages = tables.read(spark, sf_dir, "pages").select("page_id", host.alias("host"), natural_key(url).alias("key"))
    return pages.select("page_id", "host", (F.row_number().over(Window.partitionBy("host").orderBy("key", "page_id")) - 1).alias("idx"))


@query(
    r"""
WITH n AS (
  SELECT page_id, regexp_replace(translate(regexp_replace(url, '^https?:|[?#].*$', '', 'g'), '/', '\'), '^\\\\(www|m|blog)\.', '\\\\') AS s FROM pages
), m AS (
  SELECT page_id, CASE WHEN lower(s[1:20]) = '\\tionsh.example.net' AND (length(s) = 20 OR s[21:21] = '\') THEN 'M:' || s[21:] ELSE s END AS p FROM n
), t AS (
  SELECT page_id, CASE WHEN length(p) > 3 THEN rtrim(p, '\') ELSE p END AS path FROM m
)
SELECT path, page_id, copies FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY page_id DESC) AS r, count(*) OVER (PARTITION BY lower(path)) AS copies FROM t) WHERE r = 1
"""
)
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.translate(F.regexp_replace("url", r"^https?:|[?#].*$", ""), "/", "\\"), r"^\\\\(www|m|blog)\.", r"\\\\")
    paths = tables.read(spark, sf_dir, "pages").select("page_id", normal_path(bare, {"\\\\tionsh.example.net": "M:"}).alias("path"))
    same = Window.partitionBy(F.lower("path"))
    ranked = paths.withColumn("r", F.row_number().over(same.orderBy(F.desc("page_id")))).withColumn("copies", F.count(F.lit(1)).over(same))
    return ranked.where("r = 1").select("path", "page_id", "copies")


@query(
    r"""
WITH n AS (
  SELECT p_partkey, '[' || p_brand || '] ' || p_name || CASE p_partkey % 5 WHEN 0 THEN ' Vol.0' || (p_partkey % 30) WHEN 1 THEN '_第' || (p_partkey % 30) || '卷' WHEN 2 THEN ' 上册' WHEN 3 THEN ' Ch ' || (p_partkey % 9) ELSE '-0' || (p_partkey % 99) END || '.zip' AS name FROM part
), s AS (
  SELECT p_partkey, trim(regexp_replace(translate(regexp_replace(regexp_replace(name, '\.zip$', ''), '[\[\(（【][^\[\]\(\)（）【】]*[\]\)）】]', ' ', 'g'), '_　', '  '), '\s+', ' ', 'g')) AS s FROM n
), v AS (
  SELECT *, CASE WHEN contains(s, '上册') THEN '上册' WHEN regexp_matches(s, '第\s*(\d+)\s*[卷巻册]') THEN regexp_extract(s, '第\s*(\d+)\s*[卷巻册]', 1) WHEN regexp_matches(s, '[Vv]ol(?:ume)?\.?\s*(\d+)') THEN regexp_extract(s, '[Vv]ol(?:ume)?\.?\s*(\d+)', 1)
    WHEN regexp_matches(s, '\bCh(?:apter)?\.?\s*(\d+)') THEN regexp_extract(s, '\bCh(?:apter)?\.?\s*(\d+)', 1) WHEN regexp_matches(s, '[_\-\s](\d{1,3})\s*$') THEN regexp_extract(s, '[_\-\s](\d{1,3})\s*$', 1) ELSE '' END AS v,
    CASE WHEN contains(s, '上册') THEN replace(s, '上册', ' ') WHEN regexp_matches(s, '第\s*(\d+)\s*[卷巻册]') THEN regexp_replace(s, '第\s*(\d+)\s*[卷巻册]', ' ') WHEN regexp_matches(s, '[Vv]ol(?:ume)?\.?\s*(\d+)') THEN regexp_replace(s, '[Vv]ol(?:ume)?\.?\s*(\d+)', ' ')
    WHEN regexp_matches(s, '\bCh(?:apter)?\.?\s*(\d+)') THEN regexp_replace(s, '\bCh(?:apter)?\.?\s*(\d+)', ' ') WHEN regexp_matches(s, '[_\-\s](\d{1,3})\s*$') THEN regexp_replace(s, '[_\-\s](\d{1,3})\s*$', ' ') ELSE s END AS t FROM s
)
SELECT lower(trim(regexp_replace(t, '[\s\-–—~〜+＋、,，。.:：!！?？''"]+', ' ', 'g'))) AS title, regexp_replace(v, '^0+(\d)', '\1') AS volume, count(*) AS books, min(p_partkey) AS first FROM v GROUP BY ALL HAVING count(*) >= 2
"""
)
def title_volume_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, number = F.col("p_partkey"), lambda m: (F.col("p_partkey") % m).cast("string")
    ending = (
        F.when(key % 5 == 0, F.concat(F.lit(" Vol.0"), number(30)))
        .when(key % 5 == 1, F.concat(F.lit("_第"), number(30), F.lit("卷")))
        .when(key % 5 == 2, F.lit(" 上册"))
        .when(key % 5 == 3, F.concat(F.lit(" Ch "), number(9)))
        .otherwise(F.concat(F.lit("-0"), number(99)))
    )
    named = tables.read(spark, sf_dir, "part").select(key.alias("book"), title_volume(F.concat(F.lit("["), "p_brand", F.lit("] "), "p_name", ending, F.lit(".zip"))).alias("k"))
    return named.groupBy("k.title", "k.volume").agg(F.count(F.lit(1)).alias("books"), F.min("book").alias("first")).where("books >= 2")


@query(
    """
WITH n AS (SELECT doc_id, n_chars, 'doc' || doc_id || CASE doc_id % 5 WHEN 0 THEN ' copy (1)' WHEN 1 THEN ' OLD 扫描' WHEN 2 THEN '.tmp' ELSE '' END || '.txt' AS name FROM documents)
SELECT doc_id, (CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END)::INT AS suspects,
  CASE WHEN n_chars IS NULL THEN '-' WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.2f KB', n_chars / 1024.0) END AS size FROM n
"""
)
def name_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 5 == 0, " copy (1)").when(F.col("doc_id") % 5 == 1, " OLD 扫描").when(F.col("doc_id") % 5 == 2, ".tmp").otherwise("")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), tail, F.lit(".txt"))
    return tables.read(spark, sf_dir, "documents").select("doc_id", suspects(name).alias("suspects"), human_size(F.col("n_chars")).alias("size"))


SAMPLED = f"""
WITH {LINES}, presets(preset, blocks, half, most) AS (VALUES ('quick', 3, 3, 21), ('standard', 4, 6, 52), ('thorough', 6, 8, 102), ('all', 0, 0, 0)
), plan AS (
  SELECT book, preset, most, pages, CASE WHEN pages = 1 THEN [0] WHEN pages <= 3 THEN range(1, pages::BIGINT) WHEN blocks = 0 THEN range(0, pages::BIGINT)
    ELSE list_sort(list_distinct(list_filter(flatten(list_transform(range(0, blocks::BIGINT), lambda k: range((1 + round_even((k + 0.5) * (pages - 1) / blocks, 0))::BIGINT - half, (1 + round_even((k + 0.5) * (pages - 1) / blocks, 0))::BIGINT + half + 1))), lambda i: i >= 1 AND i < pages))) END AS found
  FROM books, presets
), thinned AS (
  SELECT book, preset, CASE WHEN most > 0 AND len(found) > most THEN list_sort(list_distinct(list_transform(range(0, most::BIGINT), lambda i: found[least(len(found) - 1, floor(i * (len(found) / most::DOUBLE))::BIGINT) + 1]))) ELSE found END AS found FROM plan
), sampled AS (
  SELECT book, preset, unnest(found)::INT AS idx FROM thinned
)"""


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = tables.document_books(spark, sf_dir).select("book", "pages")
    every = F.array(*[F.struct(F.lit(k).alias("preset"), F.lit(s.blocks).alias("blocks"), F.lit(s.half).alias("half"), F.lit(s.most).alias("most")) for k, s in PRESETS.items()])
    return books.withColumn("s", F.explode(every)).select("book", "s.preset", F.explode(sample_pages(F.col("pages"), F.col("s.blocks"), F.col("s.half"), F.col("s.most"))).alias("idx"))


@query(f"{SAMPLED} SELECT * FROM sampled")
def sample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir)


@query(
    f"""{SAMPLED}, marked AS (SELECT *, CASE WHEN idx - lag(idx) OVER w > 1 THEN 1 ELSE 0 END AS gap FROM sampled WINDOW w AS (PARTITION BY book, preset ORDER BY idx)
), blocks AS (SELECT *, sum(gap) OVER (PARTITION BY book, preset ORDER BY idx) AS block FROM marked)
SELECT book, preset, block::BIGINT AS block, min(idx) AS first, max(idx) AS last, count(*) AS pages FROM blocks GROUP BY ALL"""
)
def sample_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_page = Window.partitionBy("book", "preset").orderBy("idx")
    marked = sampled(spark, sf_dir).withColumn("gap", F.when(F.col("idx") - F.lag("idx").over(by_page) > 1, 1).otherwise(0))
    return marked.withColumn("block", F.sum("gap").over(by_page)).groupBy("book", "preset", "block").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("pages"))


@query(f"WITH {LINES} SELECT d.lang, sum(b.pages)::BIGINT AS pages, sum(b.usable)::BIGINT AS usable, count(*) FILTER (b.usable = 0) AS blank_books FROM books b JOIN documents d ON d.doc_id = b.book GROUP BY d.lang")
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = tables.document_books(spark, sf_dir)
    return books.groupBy(F.col("fmt").alias("lang")).agg(F.sum("pages").alias("pages"), F.sum("usable").alias("usable"), F.count(F.when(F.col("usable") == 0, 1)).alias("blank_books"))


# Hashes and vectors ---------------------------------------------------------

PHASH = """
p AS (
  SELECT label, vec_id, list_reduce(list_transform(range(0, 63), lambda i: CASE WHEN v[i + 1] > list_sort(v)[32] THEN (1::BIGINT << i::INT) ELSE 0::BIGINT END), lambda a, x: a + x) AS hash
  FROM (SELECT label, vec_id, embedding[2:64]::DOUBLE[] AS v FROM embeddings)
)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.embedding_pages(spark, sf_dir).select("book", "idx", vectors.perceptual_hash(F.col("vector")).alias("hash"))


@query(f"WITH {PHASH} SELECT vec_id, hash AS phash FROM p")
def phash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes(spark, sf_dir).select(F.col("idx").alias("vec_id"), F.col("hash").alias("phash"))


@query(
    """
WITH g AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), s AS (
  SELECT vec_id, list_transform(range(0, 8), lambda r: list_reduce(v[r * 8 + 1:r * 8 + 8], lambda a, x: a + x, 0.0::DOUBLE)) AS rows,
    list_transform(range(0, 8), lambda c: list_reduce(list_transform(range(0, 8), lambda r: v[r * 8 + c + 1]), lambda a, x: a + x, 0.0::DOUBLE)) AS cols FROM g
), f AS (
  SELECT vec_id, list_concat(list_transform(rows, lambda x: x > (list_sort(rows)[4] + list_sort(rows)[5]) / 2), list_transform(cols, lambda x: x > (list_sort(cols)[4] + list_sort(cols)[5]) / 2)) AS flags FROM s
)
SELECT vec_id, list_reduce(list_transform(range(0, 16), lambda i: CASE WHEN flags[i + 1] THEN (1::BIGINT << i::INT) ELSE 0::BIGINT END), lambda a, x: a + x) AS profile FROM f
"""
)
def profile_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.embedding_pages(spark, sf_dir).select(F.col("idx").alias("vec_id"), vectors.profile_hash(F.col("vector"), 8).alias("profile"))


@query(
    f"""WITH {PHASH} SELECT a.label AS a_book, a.vec_id AS a_idx, b.label AS b_book, b.vec_id AS b_idx, bit_count(xor(a.hash, b.hash))::INT AS distance,
  greatest(0.0::DOUBLE, 1.0::DOUBLE - bit_count(xor(a.hash, b.hash)) / 32.0::DOUBLE) AS similarity FROM p a JOIN p b ON a.label < b.label WHERE bit_count(xor(a.hash, b.hash)) <= 17"""
)
def hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = similarity.close_hashes(hashes(spark, sf_dir), 17)
    return close.withColumn("similarity", vectors.hash_similarity(F.col("distance")))


COSINE = """
u AS (
  SELECT label, vec_id, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS v
  FROM (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x - list_avg(embedding::DOUBLE[])) AS c FROM embeddings)
), hits AS (
  SELECT a.label AS a_book, a.vec_id AS a_idx, b.label AS b_book, b.vec_id AS b_idx, list_inner_product(a.v, b.v) AS score FROM u a JOIN u b ON a.label < b.label WHERE list_inner_product(a.v, b.v) >= 0.3
)"""


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_vectors(tables.embedding_pages(spark, sf_dir), 0.3)


@query(f"WITH {COSINE} SELECT a_book, b_book, count(*) AS rough, round(max(score), 6) AS best FROM hits GROUP BY ALL")
def coarse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark, sf_dir).groupBy("a_book", "b_book").agg(F.count(F.lit(1)).alias("rough"), F.round(F.max("score"), 6).alias("best"))


@query(
    f"""WITH {PHASH}, {COSINE}
SELECT a_idx, b_idx, round(0.75 * score + 0.25 * greatest(0.0::DOUBLE, 1.0::DOUBLE - bit_count(xor(a.hash, b.hash)) / 32.0::DOUBLE), 6) AS fused FROM hits JOIN p a ON a.vec_id = a_idx JOIN p b ON b.vec_id = b_idx"""
)
def fused_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, h = similar(spark, sf_dir), hashes(spark, sf_dir)
    both = found.join(h.select(F.col("idx").alias("a_idx"), F.col("hash").alias("ha")), "a_idx").join(h.select(F.col("idx").alias("b_idx"), F.col("hash").alias("hb")), "b_idx")
    score = vectors.page_score(F.col("score"), vectors.hash_similarity(vectors.hamming(F.col("ha"), F.col("hb"))))
    return both.select("a_idx", "b_idx", F.round(score, 6).alias("fused"))


GREEDY = "list_reduce(list_transform({cells}, lambda c: [c]), lambda t, x: CASE WHEN len(list_filter(t, lambda m: m.a_idx = x[1].a_idx OR m.b_idx = x[1].b_idx)) > 0 THEN t ELSE list_concat(t, x) END)"
CHAIN = "len(list_reduce(list_transform({ordered}, lambda b: [b]), lambda t, x: list_concat(list_filter(t, lambda v: v < x[1]), x, t[len(list_filter(t, lambda v: v < x[1])) + 2:])))"


@query(
    f"""WITH {COSINE}, cells AS (SELECT a_book, b_book, list({{'a_idx': a_idx, 'b_idx': b_idx}} ORDER BY round(score, 9) DESC, a_idx, b_idx) AS cells FROM hits GROUP BY ALL
), m AS (SELECT a_book, b_book, {GREEDY.format(cells='cells')} AS m FROM cells), o AS (SELECT *, list_transform(list_sort(list_transform(m, lambda c: [c.a_idx, c.b_idx])), lambda p: p[2]) AS o FROM m)
SELECT a_book, b_book, len(m) AS n_match, {CHAIN.format(ordered='o')} AS chain FROM o"""
)
def greedy_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.matched_books(tables.embedding_pages(spark, sf_dir), 0.3, 9)


@query(f"WITH {COSINE} SELECT a_book, b_book, count(*) AS votes FROM hits WHERE score >= 0.35 GROUP BY ALL HAVING count(*) >= 3")
def voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.votes(similar(spark, sf_dir), 0.35, 3)


@query(
    """
WITH u AS (
  SELECT label, vec_id, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS v
  FROM (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x - list_avg(embedding::DOUBLE[])) AS c FROM embeddings)
), s AS (
  SELECT CASE WHEN a.label = b.label THEN 'same' ELSE 'different' END AS kind, list_inner_product(a.v, b.v) AS score FROM u a JOIN u b ON a.vec_id < b.vec_id
)
SELECT kind, count(*) AS n, round(min(score), 6) AS least, round(quantile_cont(score, 0.05), 6) AS p5, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.99), 6) AS p99, round(max(score), 6) AS greatest FROM s GROUP BY kind
"""
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every pair of vectors."""
    told = similarity.score_percentiles(tables.embedding_pages(spark, sf_dir), {"p5": 0.05, "median": 0.5, "p99": 0.99})
    return told.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("least", "p5", "median", "p99", "greatest")])


@query(
    f"""
WITH {COSINE}, pairs AS (SELECT a_idx, b_idx, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM hits JOIN embeddings a ON a.vec_id = a_idx JOIN embeddings b ON b.vec_id = b_idx
), t AS (
  SELECT a_idx, b_idx, x, list_transform(range(0, 36), lambda i: y[((i // 6) + 1) * 8 + (i % 6) + 2]) AS t FROM pairs
), w AS (
  SELECT a_idx, b_idx, list_transform(t, lambda v: v - list_avg(t)) AS t, unnest(list_transform(range(0, 9), lambda s: list_transform(range(0, 36), lambda i: x[((i // 6) + (s // 3)) * 8 + (i % 6) + (s % 3) + 1]))) AS w FROM t
), r AS (
  SELECT a_idx, b_idx, list_inner_product(w, t) / sqrt((list_inner_product(w, w) - list_sum(w) * list_sum(w) / 36) * list_inner_product(t, t)) AS r FROM w
)
SELECT a_idx, b_idx, round(greatest(0.0::DOUBLE, max(r)), 6) AS aligned FROM r GROUP BY ALL
"""
)
def aligned_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned score of all pairs that the coarse one finds."""
    pages = tables.embedding_pages(spark, sf_dir).select("idx", "vector")
    side = lambda k: pages.select(F.col("idx").alias(f"{k}_idx"), F.col("vector").alias(k))
    found = similar(spark, sf_dir).select("a_idx", "b_idx").join(side("a"), "a_idx").join(side("b"), "b_idx")

    @F.pandas_udf("double")
    def best(x: pd.Series, y: pd.Series) -> pd.Series:
        grids = [np.stack([np.asarray(v, np.float64) for v in side_]).reshape(-1, 8, 8) if len(side_) else np.zeros((0, 8, 8)) for side_ in (x, y)]
        return pd.Series(similarity.aligned_all(*grids, 6))

    return found.select("a_idx", "b_idx", F.round(best("a", "b"), 6).alias("aligned"))


# Pairs ----------------------------------------------------------------------

OVERLAP = f"""{LINES}, tok AS (SELECT book, item, row_number() OVER (PARTITION BY book, item ORDER BY idx) AS k FROM usable
), ov AS (SELECT a.book AS a, b.book AS b, count(*) AS shared FROM tok a JOIN tok b ON a.item = b.item AND a.k = b.k AND a.book < b.book GROUP BY ALL HAVING count(*) >= 3
), cells AS (SELECT a, b, list({{'a_idx': x.idx, 'b_idx': y.idx}} ORDER BY x.idx, y.idx) AS cells FROM ov JOIN usable x ON x.book = a JOIN usable y ON y.book = b AND x.item = y.item GROUP BY a, b
), m AS (SELECT a, b, len(cells) AS rough, {GREEDY.format(cells='cells')} AS m FROM cells
), sc AS (
  SELECT a, b, rough, m, len(m) AS n_match, {CHAIN.format(ordered='list_transform(list_sort(list_transform(m, lambda c: [c.a_idx, c.b_idx])), lambda p: p[2])')} AS chain, x.pages AS pages_a, y.pages AS pages_b, least(x.usable, y.usable) AS span
  FROM m JOIN books x ON x.book = a JOIN books y ON y.book = b
), ok AS (
  SELECT a, b, n_match, chain, chain / span AS ratio, 1.0::DOUBLE AS score, pages_a, pages_b,
    CASE WHEN len(list_filter(m, lambda c: c.a_idx <> c.b_idx)) = 0 AND pages_a = pages_b THEN '完全相同' WHEN len(list_filter(m, lambda c: c.a_idx <> c.b_idx)) = 0 THEN '页码对齐·两版页数不同' WHEN pages_a = pages_b THEN '有页码偏移' ELSE '有页码偏移·两版页数不同' END AS relation
  FROM sc WHERE n_match >= 3 AND chain >= 3 AND (chain / span >= 0.25 OR chain >= 8) AND chain >= 0.6 * n_match
)"""


def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.document_items(spark, sf_dir)
    return pairs.equal_cells(items, pairs.overlapping(items, LIMITS.min_pages))


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.accepted(document_cells(spark, sf_dir), tables.document_books(spark, sf_dir), LIMITS)


@query(f"WITH {OVERLAP} SELECT a, b, n_match, chain FROM sc")
def greedy_match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = pairs.scored(document_cells(spark, sf_dir), tables.document_books(spark, sf_dir), LIMITS)
    return told.select("a", "b", F.col("n_match").cast("long").alias("n_match"), F.col("chain").cast("long").alias("chain"))


ANY_OVERLAP = OVERLAP.replace(" HAVING count(*) >= 3", "")


@query(f"WITH {ANY_OVERLAP} SELECT a, b, rough, n_match, chain FROM sc WHERE (rough >= 3 OR rough >= 0.2 * span) AND (n_match >= 3 OR n_match >= 0.2 * span) AND (chain >= 3 OR chain >= 0.2 * span)")
def prefilter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all pairs: short documents pass by their share of one or two lines."""
    return overlap.first_pass(tables.document_items(spark, sf_dir), tables.document_books(spark, sf_dir), FIRST)


@query(f"WITH {OVERLAP} SELECT a, b, n_match, chain, round(ratio, 6) AS ratio, score FROM ok")
def pair_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_pairs(spark, sf_dir)
    return found.select("a", "b", F.col("n_match").cast("long").alias("n_match"), F.col("chain").cast("long").alias("chain"), F.round("ratio", 6).alias("ratio"), "score")


@query(f"WITH {OVERLAP} SELECT a, b, relation FROM ok")
def relation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pairs(spark, sf_dir).select("a", "b", "relation")


@query(f"WITH {LINES} SELECT item, count(DISTINCT book) AS books, count(*) AS places FROM usable GROUP BY item HAVING count(DISTINCT book) >= 5")
def burst_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.frequent_items(tables.document_items(spark, sf_dir), 5)


@query(
    f"""WITH o AS (SELECT l_orderkey AS book, l_partkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS idx FROM lineitem
), tok AS (SELECT book, item, row_number() OVER (PARTITION BY book, item ORDER BY idx) AS k FROM o
), ov AS (SELECT a.book AS a, b.book AS b FROM tok a JOIN tok b ON a.item = b.item AND a.k = b.k AND a.book < b.book GROUP BY ALL HAVING count(*) >= 2
), cells AS (SELECT a, b, list({{'a_idx': x.idx, 'b_idx': y.idx}} ORDER BY x.idx, y.idx) AS cells FROM ov JOIN o x ON x.book = a JOIN o y ON y.book = b AND x.item = y.item GROUP BY a, b
), m AS (SELECT a, b, {GREEDY.format(cells='cells')} AS m FROM cells)
SELECT a, b, len(m) AS n_match, {CHAIN.format(ordered='list_transform(list_sort(list_transform(m, lambda c: [c.a_idx, c.b_idx])), lambda p: p[2])')} AS chain FROM m"""
)
def shared_order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.order_lines(spark, sf_dir)
    found = keep(pairs.sharing_two(lines.select("book", "item")), "order-pairs")
    items = keep(tables.in_order(pairs.of_books(lines, found)), "order-items")
    cells = pairs.equal_cells(items, found)
    cells = cells.withColumn("m", pairs.matches_of(cells, 0.0))
    return cells.select("a", "b", F.size("m").cast("long").alias("n_match"), longest_chain(F.col("m")).cast("long").alias("chain"))


# Groups and reports ---------------------------------------------------------

GROUPS = f"""{OVERLAP}, edges AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok
), reach AS (SELECT a AS node, a AS grp FROM edges UNION SELECT e.b, r.grp FROM reach r JOIN edges e ON e.a = r.node WHERE r.grp < e.b
), grp AS (SELECT node AS book, min(grp) AS grp FROM reach GROUP BY node
), info AS (
  SELECT doc_id AS book, source || '/' || lang || '/doc' || doc_id || CASE WHEN doc_id % 7 = 0 THEN ' (copy).txt' ELSE '.txt' END AS path, n_chars AS size, n_chars AS px, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS suspects FROM documents
), rel AS (SELECT a AS book, b AS peer, * EXCLUDE (a, b) FROM ok UNION ALL SELECT b, a, * EXCLUDE (a, b) FROM ok
), told AS (SELECT book, max(score) AS score, max(chain) AS matched, max(ratio) AS ratio, min(peer) AS peer FROM rel GROUP BY book
), mem AS (
  SELECT g.grp, g.book, i.path, i.size, i.px, i.suspects, t.score, t.matched, t.ratio, t.peer, (SELECT relation FROM rel r WHERE r.book = g.book AND r.peer = t.peer) AS relation, max(i.px) OVER (PARTITION BY g.grp) AS px_best,
    row_number() OVER (PARTITION BY g.grp ORDER BY t.score DESC, lower(i.path), g.book) AS place FROM grp g JOIN info i ON i.book = g.book JOIN told t ON t.book = g.book
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY suspects, CASE WHEN px_best <= 0 OR px >= px_best * 0.85::DOUBLE THEN 0 ELSE 1 END, length(path), size DESC, lower(path) DESC, book) = 1 AS kept FROM mem
), rep AS (
  SELECT grp, count(*) AS members, sum(size)::BIGINT AS total_size, sum(CASE WHEN kept THEN 0 ELSE size END)::BIGINT AS wasted, max(score) AS score, max(matched) AS matched, max(CASE WHEN kept THEN book END) AS keep_book FROM kept GROUP BY grp
), ranked AS (SELECT *, row_number() OVER (ORDER BY wasted DESC, score DESC, grp) AS gid FROM rep)"""
RECURSIVE = f"WITH RECURSIVE {GROUPS}"


def document_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members with the copy to keep, accepted pairs, books)."""
    found = keep(document_pairs(spark, sf_dir), "document-pairs")
    books = tables.document_books(spark, sf_dir)
    return report.with_keep(report.members(groups.plain_groups(found), found, books.select("book", "path", "size", "px"))), found, books


@query(f"{RECURSIVE} SELECT book, grp FROM grp")
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.plain_groups(document_pairs(spark, sf_dir))


@query()
def guarded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keep(document_pairs(spark, sf_dir), "document-pairs")
    return groups.guarded_groups(found, tables.document_books(spark, sf_dir), LIMITS)


@query(f"{RECURSIVE} SELECT grp, book, path, kept FROM kept")
def keep_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_members(spark, sf_dir)[0].select("grp", "book", "path", "kept")


@query(f"{RECURSIVE} SELECT grp, book, score, matched, round(ratio, 6) AS ratio, peer, relation, place::INT AS place FROM kept")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_members(spark, sf_dir)[0]
    return rows.select("grp", "book", "score", F.col("matched").cast("long").alias("matched"), F.round("ratio", 6).alias("ratio"), "peer", "relation", "place")


@query(f"{RECURSIVE} SELECT gid::INT AS gid, grp, members, total_size, wasted, score, matched, keep_book FROM ranked")
def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = report.group_report(document_members(spark, sf_dir)[0])
    return told.select("gid", "grp", "members", "total_size", "wasted", "score", F.col("matched").cast("long").alias("matched"), "keep_book")


@query(f"{RECURSIVE} SELECT gid::INT AS gid, members, wasted FROM ranked WHERE gid <= 20")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.group_report(document_members(spark, sf_dir)[0]).orderBy("gid").limit(20).select("gid", "members", "wasted")


@query(f"{RECURSIVE} SELECT grp, book FROM kept WHERE grp IN (SELECT grp FROM kept WHERE contains(lower(path), '(copy)'))")
def group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.named(document_members(spark, sf_dir)[0], "(COPY)").select("grp", "book")


@query(f"{RECURSIVE} SELECT row_number() OVER (ORDER BY grp, path, book)::INT AS turn, book, path FROM (SELECT * FROM kept WHERE NOT kept ORDER BY grp, path, book LIMIT 500)")
def removal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.removal_plan(document_members(spark, sf_dir)[0], "/recycle").select("turn", "book", "path")


@query(
    f"""{RECURSIVE} SELECT gid::INT AS "组号", CASE WHEN kept.kept THEN '★保留' ELSE '' END AS "建议保留", regexp_replace(path, '^.*/', '') AS "单行本名称", '压缩包' AS "载体", d.lang AS "格式", size AS "文件大小(字节)",
  CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.2f KB', round_even(size / 1024.0::DOUBLE, 2)) ELSE printf('%.2f MB', round_even(size / 1048576.0::DOUBLE, 2)) END AS "文件大小",
  b.pages::INT AS "图片总页数", b.usable::INT AS "抽样页数", printf('%.3f', kept.score) AS "组内相似度", kept.matched AS "成链页数", printf('%.2f', kept.ratio) AS "命中率", relation AS "关系", path AS "完整路径", place::INT AS place
FROM kept JOIN ranked USING (grp) JOIN books b ON b.book = kept.book JOIN documents d ON d.doc_id = kept.book"""
)
def duplicate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, books = document_members(spark, sf_dir)
    told = rows.join(report.group_report(rows).select("grp", "gid"), "grp").join(books.select("book", "kind", "fmt", "pages", F.col("usable").alias("sampled")), "book")
    listed = sinks.duplicate_list(told.withColumn("matched", F.col("matched").cast("long")))
    return listed.join(told.select(F.col("path").alias("完整路径"), "place"), "完整路径")


@query(
    f"""{RECURSIVE} SELECT (SELECT count(*) FROM books) AS books, (SELECT count(*) FROM usable) AS pages, (SELECT count(*) FROM ok) AS pair_hits, (SELECT count(*) FROM rep) AS groups, (SELECT count(*) FROM kept) AS dup_books, (SELECT sum(wasted)::BIGINT FROM rep) AS wasted"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found, books = document_members(spark, sf_dir)
    return report.summary(books, tables.document_items(spark, sf_dir), found, rows)


# Store, audits, evaluation, stream ------------------------------------------

@query("SELECT doc_id AS path, source AS kind, n_chars AS size FROM documents WHERE doc_id % 4 = 1 OR (doc_id % 4 = 2 AND n_chars % 2 = 0)")
def cache_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a store that lacks some and has others at another size."""
    found = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("kind"), F.col("n_chars").alias("size"))
    stale = found.where("path % 4 <> 1").withColumn("size", F.when((F.col("path") % 4 == 2) & (F.col("size") % 2 == 0), F.col("size") + 1).otherwise(F.col("size")))
    return store.delta(found, stale, ["path", "size"])


@query(
    """
WITH e AS (SELECT user_id AS path, ts, event_id, event_type AS status, epoch_us(ts) AS t FROM events
), s AS (SELECT min(t) AS lo, max(t) AS hi FROM e
), a AS (SELECT e.*, 0 AS n FROM e, s WHERE 5 * (t - lo) <= 3 * (hi - lo) UNION ALL SELECT e.*, 1 FROM e, s WHERE 5 * (t - lo) >= 2 * (hi - lo))
SELECT path, ts, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC, n DESC) AS r FROM a) WHERE r = 1
"""
)
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last events: a store of the first three fifths of the time, and a scan of the last three."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.struct("ts", "event_id").alias("scanned_at"), F.col("event_type").alias("status"), t.alias("t"))
    span = rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    stored = rows.where(5 * (F.col("t") - lo) <= 3 * (hi - lo)).drop("t")
    new = rows.where(5 * (F.col("t") - lo) >= 2 * (hi - lo)).drop("t")
    return store.upsert(stored, new).select("path", "scanned_at.ts", "scanned_at.event_id", "status")


@query(
    """
WITH c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'orphan pages' AS "check", k::VARCHAR AS subject, n FROM c WHERE k NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'double page', l_orderkey || '#' || l_linenumber, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'page count', o_orderkey::VARCHAR, coalesce(n, 0) FROM orders LEFT JOIN c ON k = o_orderkey WHERE coalesce(n, 0) <> o_custkey % 7
"""
)
def store_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 7).alias("sampled"))
    lines = tables.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("idx"))
    return store.audit(orders, lines)


@query("SELECT count(*) AS books, coalesce(sum(n_chars), 0)::BIGINT AS pages, coalesce(sum(n_chars // 2), 0)::BIGINT AS sampled, count(*) FILTER (l.quality IS NULL) AS bad FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang = 'en'")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").join(tables.read(spark, sf_dir, "labels"), "doc_id", "left")
    books = docs.select(F.col("lang").alias("feat_ver"), F.col("n_chars").alias("pages"), F.floor(F.col("n_chars") / 2).alias("sampled"), F.when(F.col("quality").isNull(), "error").otherwise("ok").alias("status"))
    return store.stats(books, "en")


@query(
    f"""WITH {OVERLAP}, truth AS (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.lang = y.lang AND x.n_chars = y.n_chars AND x.text = y.text AND x.doc_id < y.doc_id
), joined AS (SELECT t.a IS NOT NULL AS t, o.a IS NOT NULL AS f FROM truth t FULL JOIN (SELECT a, b FROM ok) o ON t.a = o.a AND t.b = o.b)
SELECT count(*) FILTER (t) AS expected, count(*) FILTER (f) AS found, count(*) FILTER (t AND f) AS hit, count(*) FILTER (t AND NOT f) AS missed, count(*) FILTER (f AND NOT t) AS unsupported,
  round(count(*) FILTER (t AND f) / nullif(count(*) FILTER (t), 0), 6) AS recall, round(count(*) FILTER (t AND f) / nullif(count(*) FILTER (f), 0), 6) AS support FROM joined"""
)
def proxy_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth is equal texts, by a digest of all of them."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("digest"))
    told = evaluate.recall(evaluate.pairs_of(docs, "doc_id", ["lang", "n_chars", "digest"]), document_pairs(spark, sf_dir))
    return told.select("expected", "found", "hit", "missed", "unsupported", F.round("recall", 6).alias("recall"), F.round("support", 6).alias("support"))


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def event_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_table(spark, sf_dir, "events.parquet", "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a stream with a watermark."""
    told = windows_to_table(spark, sf_dir, "events.parquet", "event-windows", "ts", "event_type", "value", "1 hour", "10 minutes")
    return told.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query()
def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of pages drawn from vectors: each as a clean page and as a scan with a dark lid and a tilt."""
    pages = tables.dealt(tables.embedding_pages(spark, sf_dir).select("idx", "vector"), "idx", PAGES_A_TASK)

    def run(batches):
        image.hold_memory()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                grid = np.asarray(r.vector, np.float64).reshape(8, 8)
                drawn = np.kron(np.where(grid > np.median(grid), 230.0, 40.0), np.ones((30, 24)))
                page = np.pad(drawn, 20, constant_values=250.0)
                scan = np.pad(image.turned(page * 0.9, 1.0, grow=False), 14, constant_values=20.0)
                for kind, held in (("clean", page), ("scan", scan)):
                    found = image.features(image.read_png(image.write_png(held)))
                    rows.append((r.idx, kind, found["phash"], found["bhash32"], found["px"], found["blank"], round(found["ink"], 6)))
            yield pd.DataFrame(rows, columns=["idx", "kind", "phash", "bhash32", "px", "blank", "ink"])

    return pages.mapInPandas(run, "idx long, kind string, phash long, bhash32 long, px long, blank boolean, ink double")
