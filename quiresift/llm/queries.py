"""Queries over the given tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresift.llm import curriculum, decontam, hyperminhash, langid, linededup, media, quality, substring, template, tokencounts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents"))
    return media.read_back(stored)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=True)
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM phrases
), runs AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)
), hits AS (
  SELECT r.doc_id, p.item_id, r.s, r.n FROM runs r JOIN phrases p ON r.phrase = p.phrase AND r.n = p.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
), seen AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), told AS (
  SELECT DISTINCT item_id, unnest(w) AS word FROM b
), counts AS (
  SELECT word, count(*) AS n FROM seen WHERE word IN (SELECT word FROM told) GROUP BY word
), rare AS (
  SELECT * FROM (
    SELECT t.item_id, t.word, row_number() OVER (PARTITION BY t.item_id ORDER BY coalesce(c.n, 0), t.word) AS k FROM told t LEFT JOIN counts c ON t.word = c.word
  ) WHERE k <= 5
), needed AS (
  SELECT item_id, count(*) AS n FROM rare GROUP BY item_id
), places AS (
  SELECT r.item_id, r.k, s.doc_id, s.pos FROM rare r JOIN seen s ON r.word = s.word
), nears AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT p.doc_id, p.item_id, p.pos FROM places p JOIN places o ON p.doc_id = o.doc_id AND p.item_id = o.item_id AND abs(o.pos - p.pos) <= 20 JOIN needed n ON n.item_id = p.item_id
    WHERE p.k = 1 GROUP BY p.doc_id, p.item_id, p.pos, n.n HAVING count(DISTINCT o.k) = n.n
  ) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated, coalesce(e.n_near, 0) AS n_near
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id LEFT JOIN nears e ON d.doc_id = e.doc_id
"""


def fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_on(docs.where(fold(4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS body FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS place FROM runs) WHERE place > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS body, count(*) AS n FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    scores = tokencounts.pieces_of(f"{tokenizers}/piece_bpe_32k.model")
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), scores).withColumnRenamed("n_tokens", "n_tokens_by_rank")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


OP6_SQL = """
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), h AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS lh FROM l
), b AS (
  SELECT *, CASE WHEN i = 0 THEN 1 WHEN (lh + 31 * lag(lh) OVER (PARTITION BY doc_id ORDER BY i)) % 3 = 0 THEN 1 ELSE 0 END AS begins FROM h
), c AS (
  SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM b
), bodies AS (
  SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body, min(i) AS start, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS place FROM bodies
), kept AS (
  SELECT c.doc_id, c.i, c.line, coalesce(r.place, 1) > 1 AS gone FROM c LEFT JOIN ranked r ON c.doc_id = r.doc_id AND c.chunk = r.chunk
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), rated AS (
  SELECT s.doc_id, s.x, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.f, s.x) AS k
  FROM s JOIN n ON s.doc_id = n.doc_id JOIN (SELECT x, count(*) AS f FROM s GROUP BY x) f ON s.x = f.x
), prefix AS (
  SELECT * FROM rated WHERE k <= n - ceil(0.8 * n) + 1
), cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
), links AS (
  SELECT c.a, c.b FROM cand c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND x.x = y.x GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= 80 * (c.na + c.nb - count(*))
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b
), roots AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.root AS component_id, d.doc_id = r.root AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN roots r ON r.node = d.doc_id
"""


def quality_machine(spark: SparkSession, sf_dir: str) -> quality.Machine:
    """Fitted on labelled rows outside the held-out fold."""
    return quality.fit_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(fold(5) != 0))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = quality_machine(spark, sf_dir)
    scored = table(spark, sf_dir, "documents").select("doc_id", quality.score_column(machine, F.col("text"), spark).alias("score"))
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS drawn
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(turn % 3 + 1)::INT] AS weight, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][(turn % 3 + 1)::INT] AS slope,
    source_size * 2.0::DOUBLE AS most FROM per
), filled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), aimed AS (
  SELECT *, least(most, max(level) OVER () * weight) AS target FROM filled
), streams AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, a.slope, floor(a.target)::BIGINT AS wanted,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY drawn, doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
), taking AS (
  SELECT *, greatest(0, least(size, wanted - start)) AS one, greatest(0, least(size, wanted - (start + source_size))) AS two FROM streams
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (one + two)::BIGINT AS taken, ((one > 0)::INT + (two > 0)::INT)::INT AS copies,
  CASE WHEN one + two > 0 THEN round(CASE WHEN start <= 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (start / target)
    / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * (start / target))) END, 9) END AS position
FROM taking
"""

QUERIES = {
    "op1_transport_streams": op1_transport_streams,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_main_text": op7_main_text,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality": op9_quality,
    "op10_curriculum_mix": op10_curriculum_mix,
}
SQL = {
    "op2_decontaminate": OP2_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op10_curriculum_mix": OP10_SQL,
}
