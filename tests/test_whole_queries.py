"""Queries do the whole job."""

import bisect
import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from quiresift.config import Thresholds
from quiresift.operators import overlap, pairs, similarity
from quiresift.plans import queries


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_first_pass_asks_short_books(spark, seed):
    rng = random.Random(seed)
    items = [(b, i, min(int(rng.expovariate(0.1)), 60)) for b in range(50) for i in range(rng.randrange(1, 20))]
    held = defaultdict(Counter)
    for b, _, x in items:
        held[b][x] += 1
    size = {b: sum(c.values()) for b, c in held.items()}
    shared = {(a, b): sum((held[a] & held[b]).values()) for a, b in combinations(sorted(held), 2)}
    want = [p for p, n in shared.items() if n and (n >= 3 or n >= 0.2 * min(size[x] for x in p))]
    assert any(shared[p] < 3 for p in want)
    books = spark.createDataFrame([(b, n, n) for b, n in size.items()], "book long, pages int, usable int")
    got = pairs.worth_asking(spark.createDataFrame(items, "book long, idx int, item long"), books, Thresholds(pre_min=3))
    assert rows(got) == sorted(want, key=str)


@pytest.mark.parametrize(("block", "cells", "together"), [(7, 20, 3), (1000, 10**6, 24)])
def test_first_pass_in_blocks(spark, monkeypatch, block, cells, together):
    """As by cells of asked pairs: items that repeat, short and long books, some with no item, cells over any cut."""
    monkeypatch.setattr(overlap, "CELLS", cells)
    monkeypatch.setattr(overlap, "TOGETHER", together)
    rng = random.Random(block)
    items = [(b * 3 - 50, i, min(int(rng.expovariate(0.1)), 60)) for b in range(70) for i in range(rng.choice([0, 1, 3, 8, 25]))]
    copied = [x for _, _, x in items[:40]]
    items += [(1000 + k, i, x) for k in range(3) for i, x in enumerate(copied if k else copied[::-1])] + [(None, 0, 1), (2000, 0, None)]
    sizes = Counter(b for b, _, _ in items if b is not None)
    books = spark.createDataFrame([(b, n, n) for b, n in [*sizes.items(), (3000, 0)]], "book long, pages int, usable int")
    df = spark.createDataFrame(items, "book long, idx int, item long")
    limits = Thresholds(pre_min=3)
    want = pairs.first_pass(pairs.equal_cells(df, pairs.worth_asking(df, books, limits)), books, limits).select("a", "b", "rough", "n_match", "chain")
    got = rows(overlap.first_pass(df, books, limits, block))
    assert got == rows(want) and max(r[4] for r in got) > together


def test_first_pass_lists_no_pairs_between_tasks(spark, tmp_path):
    """A line on 400 short documents gives 79,800 rows; the shuffled rows are as many as documents."""
    line = "the same line of more than twenty characters"
    spark.createDataFrame([(i, line, "en", "s", len(line)) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.prefilter_pairs(spark, str(tmp_path))
    assert found.count() == 400 * 399 // 2
    assert found.agg({"rough": "max", "chain": "min"}).first()[:] == (1, 1)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_upsert_reads_all_events(spark, tmp_path):
    rng = random.Random(3)
    events = [(5000 + i, rng.randrange(10**6), rng.randrange(40), rng.choice("abc")) for i in range(600)]
    df = spark.createDataFrame(events, "event_id long, s long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type")
    df.write.parquet(f"{tmp_path}/events.parquet")
    last = {}
    for e, s, u, kind in events:
        last[u] = max(last.get(u, (0, 0, "")), (s, e, kind))
    got = {r.path: (int(r.ts.timestamp()), r.event_id, r.status) for r in queries.store_upsert(spark, str(tmp_path)).selectExpr("path", "ts", "event_id", "status").collect()}
    assert {u: x[1:] for u, x in got.items()} == {u: x[1:] for u, x in last.items()}


@pytest.mark.parametrize("block", [16, 1000])
def test_percentiles_of_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    vectors = rng.normal(size=(60, 8))
    data = [(int(i % 4), 3 * i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "book int, idx long, vector array<double>")
    got = {r.kind: r for r in similarity.score_percentiles(df, {"p5": 0.05, "median": 0.5}, block, 50).collect()}
    v = vectors - vectors.mean(1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for kind in ("same", "different"):
        want = [v[i] @ v[j] for i in range(60) for j in range(i) if (i % 4 == j % 4) == (kind == "same")]
        assert got[kind].n == len(want)
        assert np.allclose(got[kind][2:], [min(want), *np.percentile(want, [5, 50]), max(want)])


def test_order_has_every_page(spark, tmp_path):
    data = [(1, "http://a.example/p10"), (2, "http://www.a.example/p9"), (3, "http://a.example/x/"), (4, "http://a.example/"), (5, None), (6, "nothing")]
    spark.createDataFrame(data, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.natural_order(spark, str(tmp_path))
    assert rows(got) == [(1, "a.example", 3), (2, "a.example", 2), (3, "a.example", 0), (4, "a.example", 1), (5, "", 0), (6, "", 1)]


def test_truth_is_whole_texts(spark, tmp_path):
    begin = "the same forty characters at the beginning of all: "
    texts = [begin + "one", begin + "two", begin + "one"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.proxy_recall(spark, str(tmp_path)).first().expected == 1


def test_pages_of_one_file_go_to_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=64).tolist(), i % 3) for i in range(300)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.image_features(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 3
    assert rows(found.select("idx", "kind")) == sorted([(i, k) for i in range(300) for k in ("clean", "scan")], key=str)


def test_many_alike_pages_are_matched_in_time(spark, tmp_path):
    """Two books of 1,200 pages alike: 1,440,000 cells of one pair, each looked at once."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    pages = [(i, (base + 0.3 * rng.normal(size=64)).tolist(), i % 2) for i in range(2400)]
    spark.createDataFrame(pages, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    began = time.time()
    found = queries.greedy_vectors(spark, str(tmp_path)).collect()
    assert time.time() - began < 60
    v = np.array([np.array(x, np.float32) for _, x, _ in pages], np.float64)
    v -= v.mean(1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(v[0::2] @ v[1::2].T, 9)
    n, b_of = 0, {}
    while (best := score.max()) >= 0.3:
        i, j = np.unravel_index(np.argmax(score), score.shape)  # of equals the first row, then column
        b_of[i], n = j, n + 1
        score[i], score[:, j] = -1, -1
    tails = []
    for i in sorted(b_of):
        at = bisect.bisect_left(tails, b_of[i])
        tails[at : at + 1] = [b_of[i]]
    assert [tuple(r) for r in found] == [(0, 1, n, len(tails))]
