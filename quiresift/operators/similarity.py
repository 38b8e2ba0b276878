"""Similarity joins of page vectors and hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresift.functions.sequence import chain_length, greedy_places
from quiresift.functions.vectors import hamming

#: Vectors of a block; a block pair is one matrix product.
BLOCK = 2048
#: Of those whose scores are looked at only for hits: each vector is sent once a block.
WIDE_BLOCK = 8192
#: Bits of a band of hashes from which bands tell hashes apart.
LEAST_BITS = 10
#: A tile that deviates less is flat. Fixed value.
FLAT = 1e-3


def _units(values: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in values])
    v -= v.mean(1, keepdims=True)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm >= 1e-3)


def _hits(vectors: DataFrame, least: float, told, schema: str, block: int) -> DataFrame:
    """Rows of ``told(a_book, a_idx, b_book, b_idx, score)``, a frame, for the hits of some lines of a block pair; every hit is told once."""
    blocks = max(1, -(-vectors.count() // block))
    dealt = vectors.select("book", "idx", "vector", F.pmod(F.xxhash64("book", "idx"), F.lit(blocks)).cast("int").alias("block"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = dealt.withColumn("other", F.explode(others)).select("book", "idx", "vector", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        left, right = pdf[pdf["block"] == low], pdf[pdf["block"] == high]
        out = []
        if len(left) and len(right):
            lv, rv = _units(left["vector"]), _units(right["vector"])
            lb, rb = left["book"].to_numpy(), right["book"].to_numpy()
            li, ri = left["idx"].to_numpy(), right["idx"].to_numpy()
            for at in range(0, len(lv), 512):
                score = lv[at : at + 512] @ rv.T
                i, j = np.nonzero(score >= least)
                i_ = i + at
                forward = lb[i_] < rb[j]
                back = (lb[i_] > rb[j]) & (low != high)
                for hit, (xb, xi, yb, yi) in ((forward, (lb[i_], li[i_], rb[j], ri[j])), (back, (rb[j], ri[j], lb[i_], li[i_]))):
                    out.append(told(xb[hit], xi[hit], yb[hit], yi[hit], score[i, j][hit]))
        return pd.concat(out) if out else told(*[np.zeros(0, object)] * 4, np.zeros(0))

    return rows.groupBy("low", "high").applyInPandas(product, schema)


def similar_vectors(vectors: DataFrame, least: float, block: int = WIDE_BLOCK) -> DataFrame:
    """(a_book, a_idx, b_book, b_idx, score) of pages of different books, a_book < b_book, whose centred cosine is at least ``least``.

    vectors: (book, idx, vector). All pairs are compared, as matrix products of
    blocks: each vector goes to one task a block of the others, and only hits
    leave. The number of blocks follows the number of vectors, so a task's
    memory does not grow with the input.
    """
    book, idx = (vectors.schema[c].dataType.simpleString() for c in ("book", "idx"))
    names = ["a_book", "a_idx", "b_book", "b_idx", "score"]
    return _hits(vectors, least, lambda *hits: pd.DataFrame(dict(zip(names, hits, strict=True))), f"a_book {book}, a_idx {idx}, b_book {book}, b_idx {idx}, score double", block)


def matched_books(vectors: DataFrame, least: float, digits: int, block: int = WIDE_BLOCK) -> DataFrame:
    """(a_book, b_book, n_match, chain) of books that have hits, as similar_vectors(): greedy matches by score to ``digits`` places, and their longest chain.

    vectors: (book, idx, vector), idx a whole number. A pair's hits travel packed,
    24 bytes each, and meet in one task, in time of their number and its logarithm.
    """
    book = vectors.schema["book"].dataType.simpleString()

    def packed(ab: np.ndarray, ai: np.ndarray, bb: np.ndarray, bi: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        hits = pd.DataFrame({"a_book": ab, "b_book": bb})
        found = [(*key, ai[at].astype(np.int64).tobytes(), bi[at].astype(np.int64).tobytes(), score[at].tobytes()) for key, at in hits.groupby(["a_book", "b_book"]).indices.items()]
        return pd.DataFrame(found, columns=["a_book", "b_book", "a", "b", "score"])

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, score = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (("a", np.int64), ("b", np.int64), ("score", np.float64)))
        scaled = score * 10.0**digits
        rank = np.rint(scaled)
        rank += scaled - rank == 0.5  # halves go up
        taken = greedy_places(a, b, rank)
        return pd.DataFrame({"a_book": pdf["a_book"].iloc[:1], "b_book": pdf["b_book"].iloc[:1], "n_match": len(taken), "chain": chain_length(a[taken], b[taken])})

    hits = _hits(vectors, least, packed, f"a_book {book}, b_book {book}, a binary, b binary, score binary", block)
    return hits.groupBy("a_book", "b_book").applyInPandas(match, f"a_book {book}, b_book {book}, n_match long, chain long")


def _every_score(vectors: DataFrame, told, schema: str, block: int) -> DataFrame:
    """Rows of ``told(same, score)``, a frame, for the scores of each block pair; every pair of pages is in one."""
    blocks = max(1, -(-vectors.count() // block))
    dealt = vectors.select("book", "vector", F.pmod(F.xxhash64("book", "idx"), F.lit(blocks)).cast("int").alias("block"))
    rows = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("book", "vector", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        left, right = pdf[pdf["block"] == low], pdf[pdf["block"] == high]
        out = []
        if len(left) and len(right):
            lv, rv = _units(left["vector"]), _units(right["vector"])
            lb, rb = left["book"].to_numpy(), right["book"].to_numpy()
            for at in range(0, len(lv), 512):
                score, same = lv[at : at + 512] @ rv.T, lb[at : at + 512, None] == rb[None, :]
                # Within a block each pair is taken once.
                once = np.arange(len(rv))[None, :] > np.arange(at, at + len(score))[:, None] if low == high else np.ones_like(same)
                out.append(told(same[once], score[once]))
        return pd.concat(out) if out else told(np.zeros(0, bool), np.zeros(0))

    return rows.groupBy("low", "high").applyInPandas(product, schema)


def score_percentiles(vectors: DataFrame, shares: dict[str, float], block: int = BLOCK, bins: int = 20_000) -> DataFrame:
    """(kind, n, least, a column for each of ``shares``, greatest): exact distribution of the centred cosine over all pairs of pages, "same" and "different" books.

    vectors: (book, idx, vector), books not null. Blocks count their scores in bins; then only
    scores of the bins that hold a percentile are gathered, so none sees all pairs.
    """
    bin_of = lambda score: np.clip(((score + 1) * (bins / 2)).astype(np.int64), 0, bins - 1)

    def counted(same: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        rows = pd.DataFrame({"same": same, "bin": bin_of(score), "score": score})
        return rows.groupby(["same", "bin"], as_index=False).agg(n=("score", "size"), least=("score", "min"), greatest=("score", "max"))

    sums = _every_score(vectors, counted, "same boolean, bin long, n long, least double, greatest double", block).groupBy("same", "bin")
    held = sums.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest")).toPandas().sort_values("bin")
    wanted: dict[tuple[bool, int], list] = {}  # of a bin, (name, place in the bin, weight)
    told = {}
    for same, of in held.groupby("same"):
        ends = of["n"].cumsum().to_numpy()
        told[same] = {"n": int(ends[-1]), "least": of["least"].min(), "greatest": of["greatest"].max()} | dict.fromkeys(shares, 0.0)
        for name, share in shares.items():
            place = share * (ends[-1] - 1)
            for rank, weight in ((int(place), 1 - place % 1), (int(place) + 1, place % 1)):
                if weight:
                    k = int(np.searchsorted(ends, rank, "right"))
                    wanted.setdefault((bool(same), int(of["bin"].iloc[k])), []).append((name, rank - int(ends[k] - of["n"].iloc[k]), weight))
    keys = np.array([k * 2 + same for same, k in wanted], np.int64)

    def chosen(same: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        key = bin_of(score) * 2 + same
        hit = np.isin(key, keys)
        return pd.DataFrame({"key": key[hit], "score": score[hit]})

    if wanted:
        near = _every_score(vectors, chosen, "key long, score double", block)
        ranks = F.array(*[F.struct(F.lit(k * 2 + same).cast("long").alias("key"), F.lit(r).cast("long").alias("rank")) for (same, k), at in wanted.items() for r in sorted({r for _, r, _ in at})])
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("score")) - 1).where(F.array_contains(ranks, F.struct("key", F.col("rank").cast("long").alias("rank"))))
        found = {(r["key"], r["rank"]): r["score"] for r in ranked.collect()}
        for (same, k), at in wanted.items():
            for name, rank, weight in at:
                told[same][name] += weight * found[k * 2 + same, rank]
    names = ["least", *shares, "greatest"]
    rows = [("same" if same else "different", of["n"], *[float(of[c]) for c in names]) for same, of in told.items()]
    return vectors.sparkSession.createDataFrame(rows, "kind string, n long, " + ", ".join(f"{c} double" for c in names))


def close_hashes(hashes: DataFrame, most: int, width: int = 63, block: int = BLOCK) -> DataFrame:
    """(a_book, a_idx, b_book, b_idx, distance) of pages of different books, a_book < b_book, at most ``most`` bits apart.

    hashes: (book, idx, hash). Exact: of most + 1 bands of bits one is equal in
    any such pair. Where bands would have too few bits to tell hashes apart,
    blocks of hashes are compared with blocks, as in similar_vectors().
    """
    bands = min(most + 1, width)
    if width // bands < LEAST_BITS:
        return _close_in_blocks(hashes, most, block)
    edges = [width * k // bands for k in range(bands + 1)]
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftright("hash", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)).alias("key")) for k in range(bands)])
    banded = hashes.select("book", "idx", "hash", F.explode(keys).alias("k")).select("book", "idx", "hash", "k.band", "k.key")
    a, b = (banded.withColumnsRenamed({"book": f"{s}_book", "idx": f"{s}_idx", "hash": f"{s}_hash"}) for s in "ab")
    met = a.join(b, ["band", "key"]).where("a_book < b_book").withColumn("distance", hamming(F.col("a_hash"), F.col("b_hash"))).where(F.col("distance") <= most)
    return met.select("a_book", "a_idx", "b_book", "b_idx", "distance").distinct()


def _close_in_blocks(hashes: DataFrame, most: int, block: int) -> DataFrame:
    blocks = max(1, -(-hashes.count() // block))
    dealt = hashes.select("book", "idx", "hash", F.pmod(F.xxhash64("book", "idx"), F.lit(blocks)).cast("int").alias("block"))
    rows = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("book", "idx", "hash", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["block"] == pdf["low"].iloc[0]], pdf[pdf["block"] == pdf["high"].iloc[0]]
        one, two = (x["hash"].to_numpy(np.int64).view(np.uint64) for x in (left, right))
        out = [pd.DataFrame({"a_book": [], "a_idx": [], "b_book": [], "b_idx": [], "distance": []})]
        for at in range(0, len(one), 512):
            apart = np.bitwise_count(one[at : at + 512, None] ^ two[None, :])
            i, j = np.nonzero(apart <= most)
            x, y = left.iloc[i + at], right.iloc[j]
            for first, second, hit in ((x, y, x["book"].to_numpy() < y["book"].to_numpy()), (y, x, (x["book"].to_numpy() > y["book"].to_numpy()) & (pdf["low"].iloc[0] != pdf["high"].iloc[0]))):
                out.append(pd.DataFrame({"a_book": first["book"].to_numpy()[hit], "a_idx": first["idx"].to_numpy()[hit], "b_book": second["book"].to_numpy()[hit], "b_idx": second["idx"].to_numpy()[hit], "distance": apart[i, j][hit].astype(np.int32)}))
        return pd.concat(out[1:] or out)

    book, idx = (hashes.schema[c].dataType.simpleString() for c in ("book", "idx"))
    return rows.groupBy("low", "high").applyInPandas(compare, f"a_book {book}, a_idx {idx}, b_book {book}, b_idx {idx}, distance int")


def aligned_all(a: np.ndarray, b: np.ndarray, template: int) -> np.ndarray:
    """For each pair of square pages (n x side x side): the greatest normalised correlation of the middle of b (template x template) with a, over all places in a; 0 if either is flat."""
    side = a.shape[1]
    template = min(template, side)
    off, area = (side - template) // 2, template * template
    a = a.astype(np.float64)
    t = b[:, off : off + template, off : off + template].astype(np.float64)
    t = t - t.mean((1, 2), keepdims=True)
    power = (t * t).sum((1, 2))
    flat = (np.sqrt(power / area) < FLAT) | (a.std((1, 2)) < FLAT)
    best = np.zeros(len(a))
    for y in range(side - template + 1):
        for x in range(side - template + 1):
            view = a[:, y : y + template, x : x + template]
            spread = np.sqrt(np.maximum((view * view).sum((1, 2)) - view.sum((1, 2)) ** 2 / area, 0) * power)
            fit = np.divide((view * t).sum((1, 2)), spread, out=np.zeros(len(a)), where=spread > 1e-9)
            best = np.maximum(best, fit)
    return np.where(flat, 0.0, best)


def aligned(a: np.ndarray, b: np.ndarray, template: int) -> float:
    """aligned_all() of one pair."""
    return float(aligned_all(a[None], b[None], template)[0])


def tile_similarity(a: Column, b: Column, side: int = 64, template: int = 48) -> Column:
    """The aligned score of two columns of stored tiles (side * side bytes)."""

    @F.pandas_udf("double")
    def best(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for at in range(0, len(x), 256):
            one, two = (np.stack([np.frombuffer(t, np.uint8) for t in s.iloc[at : at + 256]]).reshape(-1, side, side) for s in (x, y))
            out[at : at + 256] = aligned_all(one, two, template)
        return pd.Series(out)

    return F.when(a.isNotNull() & b.isNotNull(), best(F.coalesce(a, F.lit(bytes(side * side))), F.coalesce(b, F.lit(bytes(side * side)))))
