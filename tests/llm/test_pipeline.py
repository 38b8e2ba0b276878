import math
from collections import defaultdict

import corpus_pipeline
import duckdb
import pytest
from cases import SPACED, as_rows, frame, rows, sentence
from pyspark.sql import functions as F
from test_llm_operators import contamination, line_cut, near

from quiresift.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()


def test_queries_and_sql_have_the_same_names():
    assert set(queries.SQL) <= set(queries.QUERIES) and [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda x: None if x != x else round(float(x), 6) if isinstance(x, float) else x
    as_tuples = lambda df: sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    assert as_tuples(got) == as_tuples(want)


def folder(tmp_path, spark, docs, items, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, tmp_path):
    import random

    rng = random.Random(12)
    data = rows(5, 80)
    item = sentence(rng, 30, 10_000)
    data += [(200 + i, f"{sentence(rng, 20)} {item}", "en", "b", None) for i in range(3)]
    sf_dir = folder(tmp_path, spark, frame(spark, data), [(1, item), (2, None)], [(i, int(i % 9 != 0), 0) for i in range(0, 80)])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    good = stages["quality"](spark, docs, sf_dir)
    assert good.columns == docs.columns and 0 < good.count() <= len(data)

    cut = stages["line_dedup"](spark, docs, sf_dir)
    assert cut.columns == docs.columns and dict(cut.dtypes) == dict(docs.dtypes)
    want = [(i, t) for i, n, t in line_cut(data) if t or n <= 1 or t.count("\n")]
    got = sorted([(r.doc_id, r.text or "") for r in cut.collect()], key=str)
    left = {(i, t) for i, _, t in line_cut(data)}
    assert set(got) <= left and {i for i, _ in got} >= {i for i, t in want if t}
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in cut.collect())

    one = stages["near_dedup"](spark, docs, sf_dir)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in near(data, 5) if r[3])

    clean = stages["decontamination"](spark, docs, sf_dir)
    bad = {r[0] for r in contamination(data, [(1, item)]) if r[-1]}
    assert clean.columns == docs.columns and bad == {200, 201, 202}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in data if r[0] not in bad)

    mixed = corpus_pipeline.run(spark, sf_dir).collect()
    sizes = defaultdict(int)
    for r in mixed:
        sizes[r.source] += r.size
    taken = sum(r.taken for r in mixed)
    assert mixed and not bad & {r.doc_id for r in mixed} and abs(taken - 1.5 * sum(sizes.values())) <= len(sizes) + 1
    again = corpus_pipeline.run(spark, sf_dir)
    assert as_rows(again) == sorted(map(tuple, mixed), key=str)
    assert sum(len(SPACED.findall("")) for _ in mixed) == 0 and math.isfinite(taken)


def test_stages_with_odd_tables(spark, tmp_path):
    docs = frame(spark, rows(2, 20), True)
    sf_dir = folder(tmp_path, spark, docs, [], [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns
        found.collect()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert as_rows(corpus_pipeline.STAGES[1][1](spark, docs.where(F.col("text").isNull()), sf_dir).select("text").distinct()) == [(None,)]
