import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiresift.__main__ import main
from quiresift.config import PRESETS, Sampling
from quiresift.functions import image
from quiresift.functions.register import register
from quiresift.functions.sampling import sample_pages
from quiresift.functions.text import natural_key
from quiresift.plans import books
from quiresift.sources import store


def drawn(seed):
    rng = np.random.default_rng(seed)
    page = np.full((200, 150), 245.0)
    for _ in range(14):
        y, x = rng.integers(5, 160), rng.integers(5, 110)
        page[y : y + rng.integers(8, 38), x : x + rng.integers(8, 38)] = rng.integers(0, 120)
    return page


def scanned(page, seed):
    out = np.pad(image.turned(page * 0.88 + 10, 0.8, grow=False), 10, constant_values=15.0)
    return np.clip(out + np.random.default_rng(seed).normal(0, 3, out.shape), 0, 255)


def packed(pages):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i, p in enumerate(pages):
            z.writestr(f"{i}.png", image.write_png(p))
    return data.getvalue()


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("library")
    one, two = [drawn(i) for i in range(12)], [drawn(100 + i) for i in range(12)]
    (top / "first.cbz").write_bytes(packed(one))
    (top / "first copy.zip").write_bytes(packed(one))
    (top / "folder").mkdir()
    for i, p in enumerate(one):
        (top / "folder" / f"{i}.png").write_bytes(image.write_png(scanned(p, i)))
    (top / "other.cbz").write_bytes(packed(two))
    (top / "broken.zip").write_bytes(b"PK\x03\x04")
    return str(top)


def test_scan_and_group(spark, root):
    shelf = books.scan(spark, root, sampling=PRESETS["all"])
    told = {r.path.rsplit("/", 1)[-1].replace("%20", " "): r for r in shelf.books.collect()}
    assert {n: r.status for n, r in told.items()} == {"first.cbz": "ok", "first copy.zip": "ok", "folder": "ok", "other.cbz": "ok", "broken.zip": "error"}
    assert told["first.cbz"].sampled == 12 and shelf.pages.count() == 48
    small = image.read_png(bytes(told["first.cbz"].thumb))
    assert small.shape[0] == 300 and told["broken.zip"].thumb is None and all(told[n].thumb for n in ("folder", "other.cbz"))
    again = books.scan(spark, root, shelf, sampling=PRESETS["all"])
    assert sorted(map(str, again.books.collect())) == sorted(map(str, shelf.books.collect()))  # nothing was read again
    found = books.group(shelf)
    rows = {r.path.rsplit("/", 1)[-1].replace("%20", " "): r for r in found.members.collect()}
    assert set(rows) == {"first.cbz", "first copy.zip", "folder"} and len({r.grp for r in rows.values()}) == 1
    assert not rows["first copy.zip"].kept and sum(r.kept for r in rows.values()) == 1 and rows["first.cbz"].score > 0.9
    other = books.scan(spark, root, shelf, sampling=Sampling(2, 1, 0))
    assert {r.sampled for r in other.books.where("status = 'ok'").collect()} == {6}


def test_command_line(spark, root, tmp_path, capsys):
    assert main(["scan", root, "--store", f"{tmp_path}/store", "--csv", f"{tmp_path}/csv", "--preset", "quick"], spark) == 0
    assert "group 1: 3 books" in capsys.readouterr().out
    assert main(["regroup", "--store", f"{tmp_path}/store", "--sim", "0.999"], spark) == 0
    assert main(["clear", "--store", f"{tmp_path}/store"], spark) == 0 and spark.read.parquet(f"{tmp_path}/store/books").count() == 0
    assert main(["regroup", "--store", f"{tmp_path}/none"], spark) == 1 and main(["backends"]) == 0
    assert next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8-sig").startswith("组号")


def test_command_line_keeps_a_history(spark, root, tmp_path, capsys):
    data = f"{tmp_path}/data"
    assert main(["scan", root, "--data-dir", data, "--preset", "quick"], spark) == 0
    assert main(["verify", "--data-dir", data], spark) == 0 and main(["regroup", "--data-dir", data], spark) == 0
    assert [(r.note, r.n_books, r.n_groups) for r in spark.read.parquet(f"{data}/store/runs").orderBy("started_at").collect()] == [("scan", 5, 1), ("regroup", 5, 1)]
    assert spark.read.option("header", "true").csv(f"{data}/log").count() == 2
    kept = spark.read.parquet(f"{data}/store/pages").where("idx > 1")
    kept.write.parquet(f"{data}/fewer")
    spark.read.parquet(f"{data}/fewer").write.mode("overwrite").parquet(f"{data}/store/pages")
    assert main(["verify", "--data-dir", data], spark) == 1 and "page count" in capsys.readouterr().out


def test_self_test(spark, tmp_path, capsys):
    (tmp_path / "drawn").mkdir()
    assert main(["selftest", f"{tmp_path}/drawn"], spark) == 0 and "FAILED" not in capsys.readouterr().out


def test_touch(spark):
    stored = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "path string, scanned_at double")
    seen = spark.createDataFrame([("b",), ("b",), ("c",)], "path string")
    assert sorted(map(tuple, store.touch(stored, seen, F.lit(5.0)).collect())) == [("a", 1.0), ("b", 5.0)]


def test_sql_functions(spark):
    assert len(register(spark)) == 5
    names = ["a10.jpg", "b/2.png", "", "007", "x\\y01z"]
    for r in spark.createDataFrame([(n,) for n in names], "n string").select(F.expr("natural_key(n)").alias("x"), natural_key(F.col("n")).alias("y")).collect():
        assert r.x == r.y
    cases = [(n, p.blocks, p.half, p.most) for n in [0, 1, 3, 4, 50, 51, 200] for p in [*PRESETS.values(), Sampling(1, 2, 0)]]
    for r in spark.createDataFrame(cases, "n int, b int, h int, m int").select(F.expr("sample_indices(n, b, h, m)").alias("x"), sample_pages(F.col("n"), F.col("b"), F.col("h"), F.col("m")).alias("y")).collect():
        assert r.x == r.y
    rng = random.Random(1)
    places = [rng.randrange(20) for _ in range(30)]
    got = spark.createDataFrame([(places,)], "p array<int>").select(F.expr("lis_length(p)"), F.expr("hamming_sim(5, 4)"), F.expr("greedy_match(array(named_struct('a_idx', 1, 'b_idx', 2, 'score', 0.9D), named_struct('a_idx', 1, 'b_idx', 3, 'score', 1.0D)), 0.5D)").alias("g")).first()
    best = []
    for x in places:
        best.append((x, 1 + max([n for y, n in best if y < x], default=0)))
    assert got[0] == max(n for _, n in best) and got[1] == 31 / 32 and [tuple(x) for x in got.g] == [(1, 3, 1.0)]
