"""Groups of duplicate books, printed and as CSV: scan FOLDER, regroup, clear, verify (audits the store), selftest FOLDER (draws a small library there), backends."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from quiresift.config import PRESETS, Thresholds
from quiresift.functions import crop
from quiresift.plans import books
from quiresift.sources import library, sinks, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quiresift", description=__doc__)
    p.add_argument("action", choices=["scan", "regroup", "clear", "verify", "selftest", "backends"])
    p.add_argument("folder", nargs="?", help="scan: folder with books; selftest: an empty folder")
    p.add_argument("--store", help="folder of the feature store, read and written")
    p.add_argument("--data-dir", help="folder of store and log, where these are not named")
    p.add_argument("--log", help="folder of the log of actions, added to")
    p.add_argument("--jobs", type=int, default=0, help="tasks at once on this machine; 0: as Spark is set")
    p.add_argument("--csv", help="folder for the list of duplicates")
    p.add_argument("--preset", choices=sorted(PRESETS), default="standard")
    p.add_argument("--sim", type=float, default=Thresholds.page)
    p.add_argument("--min-pages", type=int, default=Thresholds.min_pages)
    p.add_argument("--ratio", type=float, default=Thresholds.ratio)
    p.add_argument("--in-order", type=float, default=Thresholds.in_order)
    p.add_argument("--coarse", type=float, default=Thresholds.coarse)
    p.add_argument("--pre-min", type=int, default=Thresholds.pre_min)
    p.add_argument("--pre-ratio", type=float, default=Thresholds.pre_ratio)
    p.add_argument("--chain-floor", type=int, default=Thresholds.chain_floor)
    p.add_argument("--guard", choices=["reference", "strict"], default=Thresholds.guard)
    p.add_argument("--crop", choices=crop.MODES, default="bed")
    p.add_argument("--no-deskew", action="store_true")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--keep-features", action="store_true")
    p.add_argument("--limit", type=int)
    p.add_argument("--show", type=int, default=20)
    return p


def record(spark: SparkSession, a: argparse.Namespace, began: float, n_books: int, n_groups: int) -> None:
    """Adds the run to the store's history (root, started_at, ended_at, n_books, n_groups, note) and to the log."""
    if a.store:
        run = spark.createDataFrame([(a.folder, began, time.time(), n_books, n_groups, a.action)], "root string, started_at double, ended_at double, n_books long, n_groups long, note string")
        run.write.mode("append").parquet(f"{a.store}/runs")
    if a.log:
        when = time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(began))
        sinks.append_log(spark, spark.createDataFrame([(when, a.action, a.folder or a.store or "", "ok", f"{n_books} books, {n_groups} groups")], "a string, b string, c string, d string, e string"), a.log)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.action == "backends":
        for name, there in library.backends().items():
            print(f"{name}: {'yes' if there else 'no'}")
        return 0
    builder = SparkSession.builder.appName("quiresift")
    spark = spark or (builder.master(f"local[{a.jobs}]") if a.jobs else builder).getOrCreate()
    if a.action == "selftest":
        told = books.self_test(spark, a.folder)
        for what, well in told.items():
            print(f"{'ok' if well else 'FAILED'}: {what}")
        return 0 if all(told.values()) else 1
    if a.data_dir:
        a.store, a.log = a.store or f"{a.data_dir}/store", a.log or f"{a.data_dir}/log"
    began = time.time()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{a.store}/books") if a.store else None
    there = path is not None and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    shelf = books.Shelf(spark.read.parquet(f"{a.store}/books"), spark.read.parquet(f"{a.store}/pages")) if there else None
    if a.action == "clear" and shelf:
        shelf = books.Shelf(store.clear(shelf.books), store.clear(shelf.pages, a.keep_features))
    elif a.action == "scan":
        shelf = books.scan(spark, a.folder, None if a.no_cache else shelf, PRESETS[a.preset], a.crop, not a.no_deskew, a.limit)
    if shelf is None:
        print("no store to read")
        return 1
    if a.action == "verify":
        found = store.audit(shelf.books.where("status = 'ok'"), shelf.pages).limit(a.show).collect()
        for r in found:
            print(f"{r.check}: {r.subject}, {r.n}")
        return 1 if found else 0
    if a.store and a.action != "regroup":
        # Read whole and written aside first: a store is never read and overwritten at once.
        for name, table in (("books", shelf.books), ("pages", shelf.pages)):
            books.keep(table, f"store-{name}").write.mode("overwrite").parquet(f"{a.store}/{name}")
    if a.action == "clear":
        record(spark, a, began, 0, 0)
        return 0
    limits = Thresholds(a.sim, a.min_pages, a.ratio, a.in_order, a.coarse, a.pre_min, a.pre_ratio, a.chain_floor, a.guard)
    found = books.group(shelf, limits)
    for r in found.groups.orderBy("gid").limit(a.show).collect():
        print(f"group {r.gid}: {r.members} books, {r.wasted} bytes to gain, score {r.score:.3f}, chain {r.matched}")
    record(spark, a, began, shelf.books.count(), found.groups.count())
    if a.csv:
        sinks.write_csv(sinks.duplicate_list(found.members), a.csv)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
