import bisect
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiresift.config import PRESETS, Sampling
from quiresift.functions import crop, image, sequence, text, vectors
from quiresift.functions.sampling import sample_pages
from quiresift.sources.library import sort_key


def one(spark, column, **values):
    names = list(values)
    kinds = {int: "long", str: "string", bool: "boolean", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)] if type(v) in kinds else 'array<double>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("x")).first().x


def test_natural_order(spark):
    names = ["10.jpg", "2.jpg", "a10b2", "a10b10", "a9", "A2.png", "b/1.jpg", "x\\001.jpg", "001.jpg", "", "a" + "9" * 40, "a" + "1" + "0" * 40]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(text.natural_key(F.col("n")), "n").collect()]

    def key(n):
        base = n.replace("\\", "/").rsplit("/", 1)[-1].lower()
        return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", base)]

    assert got == sorted(names, key=lambda n: (key(n), n))
    assert sorted(names, key=lambda n: (sort_key(n), n)) == got


@pytest.mark.parametrize("size,told", [(None, "-"), (0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (1048576, "1.00 MB"), (5 * 1024**4, "5.00 TB"), (5 * 1024**5, "5120.00 TB")])
def test_human_size(spark, size, told):
    assert spark.createDataFrame([(size,)], "n long").select(text.human_size(F.col("n"))).first()[0] == told


def test_names_and_paths(spark):
    rows = spark.createDataFrame([("x Copy (1) 扫描.zip",), ("clean.zip",)], "n string").select(text.suspects(F.col("n"))).collect()
    assert [r[0] for r in rows] == [3, 0]
    shares = {"\\\\nas\\books": "M:", "\\\\nas": "N:"}
    cases = {"//NAS/Books/a/": "M:\\a", "\\\\nas\\other": "N:\\other", "c:/x/": "C:\\x", "c:/": "C:\\", "\\\\nas\\bookshelf": "N:\\bookshelf", "rel/p": "rel\\p"}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", text.normal_path(F.col("p"), shares).alias("q")).collect()
    assert {r.p: r.q for r in got} == cases
    pages = {"a/b.JPG": True, "__MACOSX/b.jpg": False, "d/.hidden.png": False, "x.txt": False, "noext": False, "p.avif": True}
    got = spark.createDataFrame([(k,) for k in pages], "p string").select("p", text.is_page_name(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in got} == pages
    heads = {b"PK\x03\x04....": "zip", b"Rar!\x1a\x07\x00.": "rar", b"Rar!\x1a\x07\x01\x00": "rar", b"7z\xbc\xaf\x27\x1c..": "7z", b"": None, b"PK": None}
    got = spark.createDataFrame([(bytearray(k),) for k in heads], "p binary").select("p", text.sniffed_format(F.col("p")).alias("q")).collect()
    assert {bytes(r.p): r.q for r in got} == heads


def test_titles(spark):
    cases = {
        "[Group] Some_Title Vol.03.zip": ("some title", "3"),
        "作品 第 007 卷.cbz": ("作品", "7"),
        "Story 上册 (x).rar": ("story", "上册"),
        "Thing-000.zip": ("thing", "0"),
        "Plain.zip": ("plain", ""),
    }
    got = spark.createDataFrame([(k,) for k in cases], "n string").select("n", text.title_volume(F.col("n")).alias("t")).collect()
    assert {r.n: (r.t.title, r.t.volume) for r in got} == cases


def expected_pages(n, s):
    """Straight from the rule: centres at (k + 1/2) / blocks of the pages after the cover."""
    if n <= 0:
        return []
    if n <= 3:
        return list(range(1, n)) or [0]
    if s.blocks <= 0:
        return list(range(n))
    wanted = set()
    for k in range(s.blocks):
        centre = 1 + (n - 1) // 2 if s.blocks == 1 else 1 + round((k + 0.5) * (n - 1) / s.blocks)
        wanted |= {i for i in range(centre - s.half, centre + s.half + 1) if 0 < i < n}
    found = sorted(wanted)
    if 0 < s.most < len(found):
        step = len(found) / s.most
        found = [found[math.floor(step * turn)] for turn in range(s.most)]
    return found


def test_sample_pages(spark):
    plans = [*PRESETS.values(), Sampling(1, 2, 0), Sampling(5, 3, 7)]
    rows = [(n, p.blocks, p.half, p.most) for n in [*range(0, 60), 150, 151, 999] for p in plans]
    got = spark.createDataFrame(rows, "n int, b int, h int, m int").select("n", "b", "h", "m", sample_pages(F.col("n"), F.col("b"), F.col("h"), F.col("m")).alias("x")).collect()
    for r in got:
        assert r.x == expected_pages(r.n, Sampling(r.b, r.h, r.m)), r


def greedy(cells, least):
    used_a, used_b, out = set(), set(), []
    for score, a, b in sorted(((-s, a, b) for a, b, s in cells if s >= least)):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b, -score))
    return out


def chain(matches):
    tails = []
    for _, b, *_ in sorted(matches):
        k = bisect.bisect_left(tails, b)
        tails[k : k + 1] = [b]
    return len(tails)


def quadratic_chain(matches):
    best = []
    for a, b, *_ in sorted(matches):
        best.append((b, 1 + max([n for x, n in best if x < b], default=0)))
    return max([n for _, n in best], default=0)


def test_matches_and_chains(spark):
    rng = random.Random(5)
    cases = [[(rng.randrange(8), rng.randrange(8), rng.choice([0.5, 0.62, 0.7, 1.0])) for _ in range(rng.randrange(0, 25))] for _ in range(60)]
    cases += [[(i, (i * 7) % 31, 1.0) for i in range(31)], []]
    cells = "array<struct<a_idx: int, b_idx: int, score: double>>"
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, cells {cells}").withColumn("m", sequence.greedy_match(F.col("cells"), 0.62))
    for r in df.select("i", "m", sequence.longest_chain(F.col("m")).alias("n")).collect():
        want = greedy(cases[r.i], 0.62)
        assert sorted(tuple(x) for x in r.m) == sorted(want)
        assert len({x.a_idx for x in r.m}) == len({x.b_idx for x in r.m}) == len(r.m)
        assert r.n == chain(want) == quadratic_chain(want)


def test_places_of_matches():
    rng = random.Random(6)
    for n in [0, 1, *range(2, 40)]:
        cells = list({(rng.randrange(-4, 8), rng.randrange(8)): rng.choice([0.3, 0.5, 1.0]) for _ in range(n)}.items())
        a, b, score = (np.array(x, kind) for x, kind in (([c[0][0] for c in cells], np.int64), ([c[0][1] for c in cells], np.int64), ([c[1] for c in cells], float)))
        got = sequence.greedy_places(a, b, score)
        want = greedy([(*p, s) for p, s in cells], 0.0)
        assert [(a[k], b[k], score[k]) for k in got] == sorted(map(tuple, want), key=lambda c: (-c[2], *c[:2]))
        assert sequence.chain_length(a[got], b[got]) == chain(want)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=20))
def test_chain_rules_agree(pairs):
    assert chain(pairs) == quadratic_chain(pairs) or len({a for a, _ in pairs}) < len(pairs)


def test_vector_functions(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=64)
    df = spark.createDataFrame([(v.tolist(), [0.0] * 64)], "v array<double>, z array<double>")
    r = df.select(vectors.perceptual_hash(F.col("v")).alias("p"), vectors.profile_hash(F.col("v"), 8).alias("b"), vectors.unit(F.col("v")).alias("u"), vectors.unit(F.col("z")).alias("uz"), vectors.dot(F.col("v"), F.col("v")).alias("d")).first()
    assert r.p == sum(1 << i for i, x in enumerate(v[1:]) if x > np.median(v[1:]))
    g = v.reshape(8, 8)
    flags = list(g.sum(1) > np.median(g.sum(1))) + list(g.sum(0) > np.median(g.sum(0)))
    assert r.b == sum(1 << i for i, x in enumerate(flags) if x)
    c = v - v.mean()
    assert np.allclose(r.u, c / np.linalg.norm(c)) and not any(r.uz) and np.isclose(r.d, v @ v)
    pair = spark.createDataFrame([(5, -1), (0, 0)], "a long, b long").select(vectors.hamming(F.col("a"), F.col("b")).alias("h"), vectors.hash_similarity(vectors.hamming(F.col("a"), F.col("b"))).alias("s")).collect()
    assert [(x.h, x.s) for x in pair] == [(62, 0.0), (0, 1.0)]
    fused = spark.createDataFrame([(0.05, 1.0), (0.06, 1.0)], "a double, h double").select(vectors.page_score(F.col("a"), F.col("h"))).collect()
    assert [round(x[0], 6) for x in fused] == [0.0, 0.295]


def drawn(seed, size=(300, 220)):
    rng = np.random.default_rng(seed)
    page = np.full(size, 245.0)
    for _ in range(14):
        y, x = rng.integers(10, size[0] - 60), rng.integers(10, size[1] - 60)
        page[y : y + rng.integers(8, 50), x : x + rng.integers(8, 50)] = rng.integers(0, 120)
    return page


def test_image_features_tell_pages_apart():
    from quiresift.operators.similarity import aligned

    same, different = [], []
    pages = [drawn(s) for s in range(6)]
    clean = [image.features(p) for p in pages]
    for i, p in enumerate(pages):
        scan = np.pad(image.turned(p * 0.85 + 12, 1.5, grow=False), 16, constant_values=15.0)
        told = image.features(np.clip(scan + np.random.default_rng(i).normal(0, 4, scan.shape), 0, 255))
        tile = np.frombuffer(told["tile"], np.uint8).reshape(64, 64)
        for j, c in enumerate(clean):
            (same if i == j else different).append(aligned(np.frombuffer(c["tile"], np.uint8).reshape(64, 64), tile, 48))
    assert min(same) > max(different)
    assert np.median(same) > 0.7
    assert clean[0]["px"] == 300 * 220 and not clean[0]["blank"]
    assert image.features(np.full((100, 100), 240.0))["blank"]
    assert image.features(np.zeros((10, 10))) is None and image.features(None) is None


def test_png_round_trip_and_crop():
    page = np.round(drawn(3)).astype(np.uint8)
    assert (image.read_png(image.write_png(page)) == page).all()
    assert image.decode(b"no image") is None and image.decode(None) is None and image.decode(image.write_png(page)[:60]) is None
    small = image.read_png(image.thumbnail(page, 100))
    assert small.shape == (100, 73) and abs(small.mean() - page.mean()) < 2
    framed = np.pad(page, 30, constant_values=10)
    top, bottom, left, right = crop.box(framed.astype(float))
    assert abs(top - 30) <= 2 and abs(bottom - 330) <= 2 and abs(left - 30) <= 2 and abs(right - 250) <= 2
    assert abs(image.skew(image.turned(page.astype(float), 2.0, grow=False)) + 2.0) <= 0.61


def test_crop_modes():
    rng = np.random.default_rng(4)
    page = np.full((400, 300), 235.0)
    page[60:340, 45:255] = (np.add.outer(np.arange(28), np.arange(21)) % 2).repeat(10, 0).repeat(10, 1) * 200.0 + 20
    lid = np.clip(np.pad(page, 20, constant_values=15.0) * np.linspace(0.85, 1.0, 340)[None, :] + rng.normal(0, 2, (440, 340)), 0, 255)
    near = lambda got, want, by: all(abs(g - w) <= by for g, w in zip(got, want, strict=True))
    assert near(crop.box(lid, "bed"), (20, 420, 20, 320), 3) and crop.box(lid, "none") == (0, 440, 0, 340)
    for mode in ("edge", "paper"):
        assert near(crop.box(lid, mode), (80, 360, 65, 275), 12)
    inner = crop.box(page, "mass")
    assert inner.top >= 60 and inner.bottom <= 340 and inner.left >= 45 and inner.right <= 255 and near(inner, (68, 332, 51, 249), 15)
    for mode in crop.MODES:
        assert crop.box(np.full((200, 150), 240.0), mode) == (0, 200, 0, 150) and crop.box(np.zeros((10, 9)), mode) == (0, 10, 0, 9)
        assert image.features(lid, mode)["px"] == lid.size
    with pytest.raises(ValueError, match="crop"):
        image.features(lid, "other")


def test_patches_and_levels():
    cells = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    assert sorted((n, tuple(f)) for n, f in crop.patches(cells)) == [(1, (3, 4, 3, 4)), (2, (0, 2, 0, 2)), (2, (0, 2, 3, 4)), (2, (3, 4, 0, 2))]
    assert 20 < crop.two_levels(np.array([10.0] * 50 + [20.0] * 50 + [200.0] * 30)) < 200 and crop.two_levels(np.full(9, 4.0)) == 4.0
    bars = np.ones((40, 40), bool)
    bars[:, 18:21] = False
    assert crop.closed(bars)[10:30, 10:30].all()


def test_stored_tiles(spark):
    from quiresift.operators.similarity import aligned, tile_similarity

    tiles = [image.features(drawn(s))["tile"] for s in range(3)]
    got = spark.createDataFrame([(a, b) for a in [*tiles, None] for b in tiles], "a binary, b binary").select(tile_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    grid = lambda t: np.frombuffer(t, np.uint8).reshape(64, 64)
    assert np.allclose([r.s for r in got[:9]], [aligned(grid(a), grid(b), 48) for a in tiles for b in tiles]) and all(r.s is None for r in got[9:])


def test_sizes_by_heads(spark):
    from quiresift.sources.library import page_sizes

    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"J" * 14 + b"\xff\xff\xc4\x00\x04ab" + b"\xff\xc2\x00\x11\x08" + (481).to_bytes(2, "big") + (320).to_bytes(2, "big") + bytes(12)
    cases = {
        image.write_png(np.zeros((7, 9))): (9, 7),
        b"GIF89a" + bytes([44, 1, 200, 0]) + bytes(20): (300, 200),
        b"BM" + bytes(16) + (640).to_bytes(4, "little") + (-480).to_bytes(4, "little", signed=True) + bytes(8): (640, 480),
        jpeg: (320, 481),
        b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"): (100, 50),
        b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + (639 | 479 << 14).to_bytes(4, "little") + bytes(8): (640, 480),
        b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(10) + (320).to_bytes(2, "little") + (240).to_bytes(2, "little"): (320, 240),
        b"": None, b"\xff\xd8": None, b"\xff\xd8\xff": None, jpeg[:30]: None, b"nothing": None,
    }
    for head, size in cases.items():
        assert image.header_size(head) == size, head[:12]
    rows = spark.createDataFrame([("a", i, bytearray(h)) for i, h in enumerate(cases)] + [("a", 99, None)], "path string, idx int, content binary")
    got = {r.idx: r for r in page_sizes(rows).collect()}
    assert [(got[i].width, got[i].height) if got[i].width else None for i in range(len(cases))] == list(cases.values()) and got[0].px == 63 and got[99].px is None
