import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiresift.config import Thresholds
from quiresift.operators import evaluate, groups, pairs, report, similarity
from quiresift.operators.components import components
from quiresift.scratch import keep


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def reach(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()))
    assert got == reach([e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("crowded", [1, 64])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_overlapping(spark, monkeypatch, least, crowded):
    monkeypatch.setattr(pairs, "CROWDED", crowded)
    rng = random.Random(least)
    items = [(b, i, min(int(rng.expovariate(0.15)), 40)) for b in range(40) for i in range(rng.randrange(0, 9))]
    held = defaultdict(Counter)
    for b, _, x in items:
        held[b][x] += 1
    want = [(a, b) for a, b in itertools.combinations(sorted(held), 2) if sum((held[a] & held[b]).values()) >= least]
    got = pairs.overlapping(spark.createDataFrame(items, "book long, idx int, item long"), least)
    assert rows(got) == sorted(want, key=str)


@pytest.mark.parametrize("short", [1, 5, 64])
def test_sharing_two(spark, monkeypatch, short):
    monkeypatch.setattr(pairs, "SHORT", short)
    rng = random.Random(short)
    items = [(b, min(int(rng.expovariate(0.15)), 40)) for b in range(60) for _ in range(rng.randrange(0, 9))] + [(90, 1), (None, 2), (None, 3), (91, None)]
    held = defaultdict(Counter)
    for b, x in items:
        if b is not None and x is not None:
            held[b][x] += 1
    want = [(a, b) for a, b in itertools.combinations(sorted(held), 2) if sum((held[a] & held[b]).values()) >= 2]
    assert any(len(held[a] & held[b]) == 1 for a, b in want)  # by one item twice
    assert rows(pairs.sharing_two(spark.createDataFrame(items, "book long, item long"))) == sorted(want, key=str)


def test_books_that_share_one_item_do_not_meet(spark, monkeypatch):
    """A part on every order: orders meet only by what two of them share besides."""
    kept = {}
    monkeypatch.setattr(pairs, "keep", lambda df, label: kept.setdefault(label, keep(df, label)))
    items = [(b, x) for b in range(300) for x in (0, 1000 + b, 2000 + b // 2 if b < 20 else 3000 + b)]
    found = pairs.sharing_two(spark.createDataFrame(items, "book long, item long"))
    assert rows(found) == sorted(((b, b + 1) for b in range(0, 20, 2)), key=str)
    assert kept["books-met"].count() == 20 and kept["books-asked"].count() == 10


def test_cells_of_items_that_repeat(spark):
    """One to one cells are what a greedy match of all equal places takes; the same item thousands of times is no problem."""
    rng = random.Random(8)
    items = [(book, i, rng.choice("abbbccd")) for book in range(6) for i in range(rng.randrange(5, 15))]
    df = spark.createDataFrame(items, "book long, idx int, item string")
    asked = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    got = {(r.a, r.b): r for r in pairs.equal_cells(df, spark.createDataFrame(asked, "a long, b long")).collect()}
    for a, b in asked:
        cells = sorted((i, j) for x, i, s in items for y, j, t in items if x == a and y == b and s == t)
        taken = []
        for i, j in cells:
            if all(i != x and j != y for x, y in taken):
                taken.append((i, j))
        assert got[a, b].rough == len(cells) and sorted((c.a_idx, c.b_idx) for c in got[a, b].cells) == taken
    many = spark.range(6000).select((F.col("id") % 2).alias("book"), F.floor(F.col("id") / 2).cast("int").alias("idx"), F.lit("same").alias("item"))
    held = pairs.equal_cells(many, spark.createDataFrame([(0, 1)], "a long, b long")).first()
    assert held.rough == 9_000_000 and len(held.cells) == 3000


def test_decisions_at_their_limits(spark):
    books = spark.createDataFrame([(i, 40, 40) for i in range(10)], "book long, pages int, usable int")

    def cells(a, b, matches):
        return (a, b, [(i, j, s) for i, j, s in matches])

    data = [
        cells(0, 1, [(i, i, 1.0) for i in range(10)]),  # ratio 0.25 exactly
        cells(0, 2, [(i, i, 1.0) for i in range(8)]),  # under the ratio, at the chain floor
        cells(0, 3, [(i, i, 1.0) for i in range(7)]),  # under both
        cells(0, 4, [(i, i, 0.62) for i in range(12)]),  # scores at the limit
        cells(0, 5, [(i, i, 0.6199) for i in range(12)]),  # scores under it
        cells(0, 6, [(i, (i * 7) % 20, 1.0) for i in range(20)]),  # out of order
        cells(0, 7, [(i, i + 1, 1.0) for i in range(12)]),  # shifted
    ]
    df = spark.createDataFrame(data, "a long, b long, cells array<struct<a_idx: int, b_idx: int, score: double>>")
    got = {r.b: r for r in pairs.accepted(df, books, Thresholds()).collect()}
    assert sorted(got) == [1, 2, 4, 7]
    assert got[1].relation == "完全相同" and got[7].relation == "有页码偏移" and got[1].ratio == 0.25
    assert sorted(r.b for r in pairs.accepted(df, books, Thresholds(chain_floor=0)).collect()) == [1, 4, 7]
    assert sorted(r.b for r in pairs.first_pass(df, books, Thresholds()).collect()) == [1, 2, 3, 6, 7]


def test_similar_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 12))
    v[10] = v[40] * 2 + 1
    v[11] = 5.0
    book = [i % 7 for i in range(90)]
    u = v - v.mean(1, keepdims=True)
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, norm, out=np.zeros_like(u), where=norm > 1e-3)
    want = sorted((book[i], i, book[j], j) for i in range(90) for j in range(90) if book[i] < book[j] and u[i] @ u[j] >= 0.5)
    df = spark.createDataFrame([(book[i], i, v[i].tolist()) for i in range(90)], "book long, idx long, vector array<double>")
    for block in (2048, 20):
        got = similarity.similar_vectors(df, 0.5, block)
        assert sorted(map(tuple, got.drop("score").collect())) == want


def test_close_hashes(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(20)]
    h = [(i % 5, i, base[i % 20] ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(4)))) for i in range(80)]
    h = [(b, i, x & ((1 << 63) - 1)) for b, i, x in h]
    want = sorted((b, i, c, j, (x ^ y).bit_count()) for b, i, x in h for c, j, y in h if b < c and (x ^ y).bit_count() <= 4)
    got = similarity.close_hashes(spark.createDataFrame(h, "book long, idx long, hash long"), 4)
    assert sorted(map(tuple, got.collect())) == want


def merged(accepted, rank, limits, strict=False):
    """The rule for merges, one pair after another."""
    own = {}
    good = {(a, b) for a, b, _, chain, ratio in accepted if chain >= limits.min_pages and ratio >= limits.ratio}
    teams = {x: [x] for p in accepted for x in p[:2]}
    for a, b, *_ in sorted(accepted, key=lambda p: (-p[2], p[0], p[1])):
        ta, tb = teams[a], teams[b]
        if ta is tb:
            continue
        ra, rb = own.get(id(ta)), own.get(id(tb))
        if strict:
            check = len(ta) > 1 or len(tb) > 1
        else:
            check = ra is not None and rb is not None
        x, y = a if ra is None else ra, b if rb is None else rb
        if check and (x, y) != (a, b) and tuple(sorted((x, y))) not in good:
            continue
        joined = ta + tb
        for m in joined:
            teams[m] = joined
        own[id(joined)] = max((x, y), key=lambda k: (rank[k], -k))
    return {m: min(t) for t in teams.values() for m in t if len(t) > 1}


@pytest.mark.parametrize("guard", ["reference", "strict"])
def test_guarded_groups(spark, guard):
    rng = random.Random(4)
    limits = Thresholds(guard=guard)
    books = [(i, f"{'copy ' * (i % 3 == 0)}book{'x' * (i % 4)}{i}.zip", rng.randrange(100)) for i in range(40)]
    found = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)})
    accepted = [(a, b, rng.choice([0.7, 0.8, 0.9]), rng.choice([3, 9]), rng.choice([0.1, 0.5])) for a, b in found]
    rank = {i: (-("copy" in p), -len(p), s, p.lower()) for i, p, s in books}
    got = groups.guarded_groups(spark.createDataFrame(accepted, "a long, b long, score double, chain int, ratio double"), spark.createDataFrame(books, "book long, path string, size long"), limits)
    assert dict(map(tuple, got.collect())) == merged(accepted, rank, limits, guard == "strict")


def test_reports(spark):
    found = spark.createDataFrame(
        [(1, 2, 5, 5, 0.5, 0.9, "完全相同", [(0, 1, 0.9)]), (2, 3, 4, 6, 0.4, 0.8, "有页码偏移", [(2, 3, 0.8)]), (7, 8, 9, 9, 0.9, 0.95, "完全相同", [])],
        "a long, b long, chain int, n_match int, ratio double, score double, relation string, matches array<struct<a_idx: int, b_idx: int, score: double>>",
    )
    books = spark.createDataFrame([(1, "/l/a copy.zip", 100, 1000), (2, "/l/a.zip", 90, 900), (3, "/l/a-long.zip", 400, 100), (7, "/l/b.zip", 50, 10), (8, "/l/B.zip", 60, 10)], "book long, path string, size long, px long")
    told = report.with_keep(report.members(groups.plain_groups(found), found, books))
    by = {r.book: r for r in told.collect()}
    assert {b for b, r in by.items() if r.kept} == {2, 8}  # the copy and the small one lose; the larger file wins a tie
    assert by[2].peer == 1 and by[2].score == 0.9 and by[2].matched == 5 and by[3].peer == 2
    assert [by[b].place for b in (1, 2, 3)] == [1, 2, 3]
    reports = {r.grp: r for r in report.group_report(told).collect()}
    assert (reports[1].gid, reports[1].wasted, reports[1].total_size, reports[1].keep_book) == (1, 500, 590, 2)
    assert (reports[7].gid, reports[7].wasted) == (2, 50)
    assert {r.book for r in report.named(told, "LONG").collect()} == {1, 2, 3}
    assert {r.book for r in report.keep_override(told, spark.createDataFrame([(3,)], "book long")).where("kept").collect()} == {3, 8}
    moved = report.removal_plan(told, "/bin/").collect()
    assert [(r.turn, r.book, r.target) for r in moved] == [(1, 1, "/bin/a copy.zip"), (2, 3, "/bin/a-long.zip"), (3, 7, "/bin/b.zip")]
    back = {(r.book, r.peer): r.matches for r in report.relations(found).collect()}
    assert [tuple(m)[:2] for m in back[3, 2]] == [(3, 2)]


def test_numbers_over_partitions(spark):
    from quiresift.operators.numbering import numbered

    rng = random.Random(9)
    data = [(i, rng.randrange(50)) for i in range(2000)]
    got = numbered(spark.createDataFrame(data, "k long, v long").repartition(9), [F.desc("v"), F.asc("k")], "place").collect()
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.place)] == sorted(data, key=lambda r: (-r[1], r[0])) and sorted(r.place for r in got) == list(range(1, 2001))
    assert numbered(spark.createDataFrame([], "k long"), [F.asc("k")], "place").count() == 0


def test_evaluation(spark):
    truth = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")
    found = spark.createDataFrame([(2, 1), (3, 4), (3, 4), (8, 9)], "a long, b long")
    r = evaluate.recall(truth, found).first()
    assert (r.expected, r.found, r.hit, r.missed, r.unsupported) == (3, 3, 2, 1, 1) and r.recall == r.support == 2 / 3
    scores = spark.createDataFrame([("x", float(i)) for i in range(101)], "k string, v double")
    p = evaluate.percentiles(scores, "k", "v").first()
    assert (p.n, p.least, p.p5, p.median, p.p99, p.greatest) == (101, 0.0, 5.0, 50.0, 99.0, 100.0)


def test_result_does_not_hang_on_partitions(spark):
    from quiresift.plans import queries

    def told(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return rows(queries.pair_decision(spark, "/root/testdata/sf0.001"))

    try:
        assert told(1) == told(8) != []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
