"""The main functions under SQL names, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

CELLS = "ARRAY<STRUCT<a_idx: INT, b_idx: INT, score: DOUBLE>>"
FUNCTIONS = {
    "natural_key(name STRING) RETURNS ARRAY<STRING>": r"""
        concat(CASE WHEN lower(element_at(split(translate(name, '\\', '/'), '/'), -1)) RLIKE '^[0-9]' THEN array('') ELSE cast(array() AS ARRAY<STRING>) END,
          transform(regexp_extract_all(lower(element_at(split(translate(name, '\\', '/'), '/'), -1)), '[0-9]+|[^0-9]+', 0),
            p -> CASE WHEN p RLIKE '^[0-9]' THEN lpad(cast(length(regexp_replace(p, '^0+(?=[0-9])', '')) AS STRING), 4, '0') || regexp_replace(p, '^0+(?=[0-9])', '') ELSE p END))""",
    "hamming_sim(a BIGINT, b BIGINT) RETURNS DOUBLE": "greatest(0.0D, 1.0D - bit_count(a ^ b) / 32.0D)",
    "lis_length(places ARRAY<INT>) RETURNS INT": "size(aggregate(places, cast(array() AS ARRAY<INT>), (t, b) -> concat(filter(t, v -> v < b), array(b), slice(t, size(filter(t, v -> v < b)) + 2, size(t)))))",
    f"greedy_match(cells {CELLS}, least DOUBLE) RETURNS {CELLS}": f"""
        aggregate(array_sort(transform(filter(cells, c -> c.score >= least), c -> struct(-c.score AS down, c.a_idx AS a_idx, c.b_idx AS b_idx))), cast(array() AS {CELLS}),
          (t, c) -> CASE WHEN exists(t, m -> m.a_idx = c.a_idx OR m.b_idx = c.b_idx) THEN t ELSE concat(t, cast(array(struct(c.a_idx AS a_idx, c.b_idx AS b_idx, -c.down AS score)) AS {CELLS})) END)""",
    "sample_indices(pages INT, blocks INT, half INT, most INT) RETURNS ARRAY<INT>": """
        CASE WHEN pages <= 0 THEN cast(array() AS ARRAY<INT>) WHEN pages = 1 THEN array(0) WHEN pages <= 3 THEN sequence(1, greatest(pages - 1, 1)) WHEN blocks <= 0 THEN sequence(0, greatest(pages - 1, 0))
        ELSE element_at(transform(array(array_sort(array_distinct(filter(flatten(transform(sequence(0, greatest(blocks, 1) - 1),
            k -> sequence(CASE WHEN blocks = 1 THEN 1 + cast(floor((pages - 1) / 2) AS INT) ELSE 1 + cast(bround((k + 0.5D) * (pages - 1) / blocks, 0) AS INT) END - half,
                          CASE WHEN blocks = 1 THEN 1 + cast(floor((pages - 1) / 2) AS INT) ELSE 1 + cast(bround((k + 0.5D) * (pages - 1) / blocks, 0) AS INT) END + half))), i -> i >= 1 AND i < pages)))),
          f -> CASE WHEN most > 0 AND size(f) > most THEN array_distinct(transform(sequence(0, greatest(most, 1) - 1), i -> element_at(f, 1 + least(size(f) - 1, cast(floor(i * (size(f) / cast(most AS DOUBLE))) AS INT))))) ELSE f END), 1) END""",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions for this session and returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
