import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiresift.config import Sampling
from quiresift.functions.image import write_png
from quiresift.sources import library, sinks, store
from quiresift.streaming import ingest


def page(seed):
    rng = np.random.default_rng(seed)
    out = np.full((120, 90), 240.0)
    for _ in range(8):
        y, x = rng.integers(0, 90), rng.integers(0, 60)
        out[y : y + 20, x : x + 20] = rng.integers(0, 100)
    return write_png(out)


@pytest.fixture
def shelf(tmp_path):
    def packed(names, **kw):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for n, content in names:
                z.writestr(n, content)
        return data.getvalue()

    root = tmp_path / "shelf"
    (root / "series" / "vol 1").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "$RECYCLE.BIN").mkdir()
    for i in range(12):
        (root / "series" / "vol 1" / f"{i}.PNG").write_bytes(page(i))
    (root / "series" / "vol 1" / "notes.txt").write_text("x")
    (root / ".hidden" / "a.png").write_bytes(page(1))
    (root / "$RECYCLE.BIN" / "b.zip").write_bytes(packed([("1.png", page(1))]))
    (root / "good.cbz").write_bytes(packed([(f"p{i}.png", page(i)) for i in (10, 2, 1)] + [("__MACOSX/p1.png", b""), ("info.xml", b"")]))
    (root / "wrong name.rar").write_bytes(packed([("1.png", page(1)), ("2.png", b"no image")]))
    (root / "broken.zip").write_bytes(b"PK\x03\x04 broken")
    (root / "empty.zip").write_bytes(packed([("readme.txt", b"")]))
    (root / "other.7z").write_bytes(b"7z\xbc\xaf\x27\x1c rest")
    return str(root)


def test_library(spark, shelf):
    books = {r.path.rsplit("/", 1)[-1]: r for r in library.discover(spark, shelf).collect()}
    assert set(books) == {"vol 1", "good.cbz", "wrong name.rar", "broken.zip", "empty.zip", "other.7z"} or set(books) == {"vol%201", "good.cbz", "wrong%20name.rar", "broken.zip", "empty.zip", "other.7z"}
    folder = next(r for r in books.values() if r.kind == "folder")
    assert folder.pages == 12 and folder.size == sum(len(page(i)) for i in range(12))
    pages = library.folder_pages(spark, shelf, Sampling(0, 0, 0)).orderBy("idx").collect()
    assert [r.name for r in pages] == [f"{i}.PNG" for i in range(12)] and bytes(pages[3].content) == page(3)
    assert [r.idx for r in library.folder_pages(spark, shelf, Sampling(2, 1, 0)).orderBy("idx").collect()] == [3, 4, 5, 8, 9, 10]
    found = library.archive_pages(spark, shelf, Sampling(0, 0, 0)).collect()
    good = sorted((r.idx, r.name) for r in found if r.path.endswith("good.cbz"))
    assert good == [(1, "p2.png"), (2, "p10.png")] or good == [(0, "p1.png"), (1, "p2.png"), (2, "p10.png")]
    told = {r.path.rsplit("/", 1)[-1].replace("%20", " "): r.error for r in found if r.idx is None}
    assert "zip cannot be opened" in told["broken.zip"] and told["empty.zip"] == "no images" and "7z" in told["other.7z"]
    features = library.page_features(library.archive_pages(spark, shelf, Sampling(0, 0, 0))).collect()
    bad = [r for r in features if r.error]
    assert len(bad) == 1 and bad[0].phash is None and all(r.phash is not None and len(r.tile) == 4096 and len(r.map16) == 256 for r in features if not r.error)
    decoded = library.decoded_images(spark, shelf + "/series").collect()
    assert len(decoded) == 12 and {(r.width, r.height) for r in decoded} == {(90, 120)}


def test_member_names():
    info = zipfile.ZipInfo("x")
    info.filename = "第1页.png".encode("gbk").decode("cp437")
    assert library.member_name(info) == "第1页.png"
    info.flag_bits |= 0x800
    info.filename = "第1页.png"
    assert library.member_name(info) == "第1页.png"
    assert library.decoded("第一页".encode("gbk")) == "第一页" and library.backends()["zipfile"]


def test_store(spark):
    schema = "path string, size long, mtime double, feat_ver string, crop_mode string, sampling string, status string, error string, scanned_at double, pages long, sampled long"
    old = spark.createDataFrame([("a", 1, 1.0, "q1", "bed", "s", "ok", "", 1.0, 10, 3), ("b", 2, 1.0, "q1", "bed", "s", "error", "x", 1.0, 0, 0), ("c", 3, 1.0, "q0", "bed", "s", "ok", "", 1.0, 5, 2)], schema)
    seen = spark.createDataFrame([("a", 1, 1.0, "q1", "bed", "s"), ("a2", 1, 1.0, "q1", "bed", "s"), ("b", 2, 1.0, "q1", "bed", "s"), ("c", 3, 1.0, "q1", "bed", "s"), ("a", 1, 1.0, "q1", "bed", "other")], "path string, size long, mtime double, feat_ver string, crop_mode string, sampling string")
    assert sorted((r.path, r.sampling) for r in store.delta(seen, old).collect()) == [("a", "other"), ("a2", "s"), ("c", "s")]
    assert {(r.path, r.status) for r in store.hits(seen, old).collect()} == {("a", "ok"), ("b", "error")}
    new = spark.createDataFrame([("a", 9, 2.0, "q1", "bed", "s", "ok", "", 1.0, 11, 4), ("d", 1, 2.0, "q1", "bed", "s", "ok", "", 2.0, 1, 1)], schema)
    after = store.upsert(old, new)
    assert {(r.path, r.size) for r in after.collect()} == {("a", 9), ("b", 2), ("c", 3), ("d", 1)}
    assert tuple(store.stats(after, "q1").first()) == (3, 12, 5, 1)
    assert {r.path for r in store.purge(after, "q1").collect()} == {"a", "b", "d"}
    pages = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 1, False), ("z", 0, False), ("c", 0, False)], "path string, idx int, blank boolean")
    assert {(r.path, r.idx) for r in store.usable(pages, after, "q1").collect()} == {("a", 0), ("a", 1)}
    found = {(r.check, r.subject): r.n for r in store.audit(after, pages).collect()}
    assert found == {("orphan pages", "z"): 1, ("double page", "a#1"): 2, ("page count", "a"): 3, ("page count", "c"): 1, ("page count", "d"): 0}
    assert store.upsert_pages(pages, pages.where("path = 'z'").withColumn("idx", F.lit(5))).where("path = 'z'").first().idx == 5
    assert store.for_books(pages, seen).count() == 4 and store.remove(pages, seen).count() == 1
    assert store.clear(pages).count() == 0 and store.clear(pages, keep_features=True).count() == 5
    twice = spark.createDataFrame([("//NAS/a.zip", 1.0), ("m:\\a.zip", 2.0), ("M:\\b.zip", 1.0)], "path string, scanned_at double")
    assert {(r.path, r.was) for r in store.merge_paths(twice, {"\\\\nas": "M:"}).collect()} == {("M:\\a.zip", "m:\\a.zip"), ("M:\\b.zip", "M:\\b.zip")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, "/l/a.zip", "archive", "zip", 2048, 10, 5, 0.98765, 4, 0.8, "完全相同", 1)], "gid int, kept boolean, path string, kind string, fmt string, size long, pages int, sampled int, score double, matched int, ratio double, relation string, place int")
    listed = sinks.duplicate_list(rows)
    assert tuple(listed.first()) == (1, "★保留", "a.zip", "压缩包", "zip", 2048, "2.00 KB", 10, 5, "0.988", 4, "0.80", "完全相同", "/l/a.zip")
    sinks.write_csv(listed, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert text.startswith("\ufeff组号,建议保留".encode())
    log = spark.createDataFrame([("t", "move", "a", "ok", "")], "a string, b string, c string, d string, e string")
    sinks.append_log(spark, log, str(tmp_path / "log"))
    sinks.append_log(spark, log, str(tmp_path / "log"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "log")).count() == 2
    sinks.save_settings(spark, {"page": 0.62, "名": "x"}, str(tmp_path / "conf"))
    assert sinks.load_settings(spark, str(tmp_path / "conf")) == {"page": 0.62, "名": "x"}


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    spark.range(5).write.parquet(source)
    schema = spark.read.parquet(source).schema
    run = lambda: ingest.ingest(spark, source, schema, ingest.append_by_batch(out), mark).awaitTermination()
    run()
    run()
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).write.mode("append").parquet(source)
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_one_page_opens_one_book(spark, shelf):
    books = {r.path.rsplit("/", 1)[-1].replace("%20", " "): r.path for r in library.discover(spark, shelf).collect()}
    got = library.one_page(spark, books["good.cbz"], 1).collect()
    assert [(r.path, r.idx, r.name, r.page_count) for r in got] == [(books["good.cbz"], 1, "p2.png", 3)] and bytes(got[0].content) == page(2)
    got = library.one_page(spark, books["vol 1"], 11).collect()
    assert [(r.path, r.name) for r in got] == [(books["vol 1"], "11.PNG")] and bytes(got[0].content) == page(11)
    assert library.one_page(spark, books["good.cbz"], 9).count() == 0


def test_books_that_are_not_asked_for_are_not_opened(spark, shelf):
    books = library.discover(spark, shelf)
    some = books.where(F.col("path").endswith("good.cbz"))
    every = Sampling(0, 0, 0)
    assert {r.path.rsplit("/", 1)[-1] for r in library.archive_pages(spark, shelf, every, some).collect()} == {"good.cbz"}
    assert library.folder_pages(spark, shelf, every, some).count() == 0 and library.folder_pages(spark, shelf, every, books).count() == 12


@pytest.mark.skipif(not (library.backends()["bsdtar"] or library.backends()["7z"]), reason="no program that packs 7z")
def test_an_archive_through_a_program(spark, tmp_path):
    import subprocess

    names = [f"{k} {n}.png" for k, n in enumerate(["a", "ü", "c"])]
    for k, n in enumerate(names):
        (tmp_path / n).write_bytes(page(k))
    pack = ["bsdtar", "-a", "-cf", "book.7z"] if library.backends()["bsdtar"] else ["7z", "a", "book.7z"]
    subprocess.run([*pack, *names], cwd=tmp_path, check=True, capture_output=True)
    got = library.archive_pages(spark, f"{tmp_path}/book.7z", Sampling(0, 0, 0)).orderBy("idx").collect()
    assert [(r.name, r.error) for r in got] == [(n, "") for n in names] and [bytes(r.content) for r in got] == [page(k) for k in range(3)]
