"""Removal of passages that stand earlier, by seed and extend.

Seeds are winnowed: of each ``window`` consecutive words the run of ``gram``
words with the smallest hash is an anchor, so equal windows have equal anchors.
Anchors are joined over all documents. Around a shared anchor a match is
extended both ways as long as whole windows agree: a window goes if its words
also start earlier somewhere, and neighbours that go are one maximal repeat,
``window`` words long at least. Along a repeat the earlier place may change
from one document to another, so each window seeks its own first place; no two
documents are paired. Between buckets windows are told apart by 96 bits of two
hashes: among 10^13 windows two different ones are taken for equal with
probability 6e-4; within one, by the first 64 bits of them.

Documents are dealt into buckets by id and text. Copies within a bucket meet
there, so a passage sends one row a bucket, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quiresift.llm.textbytes import Words, pieces, run_hashes, scramble, split_batches

#: Words of an anchor.
GRAM = 8
#: Documents of a bucket, on average; a hot passage has as many rows in one task as there are buckets.
BUCKET_DOCS = 1024
#: Pairs of anchor and bucket that a task gathers before it sends them.
MOST_PAIRS = 4_000_000


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours; len - width + 1 of them."""
    out, held = values, 1
    while held * 2 <= width:
        out = pick(out[:-held], out[held:])
        held *= 2
    return pick(out[: len(out) - (width - held)], out[width - held :]) if width > held else out


class Anchored:
    """Words of some texts with their hashes, grams and anchors."""

    def __init__(self, words: Words, window: int, gram: int):
        self.window, self.gram, self.span = window, gram, window - gram + 1
        self.counts = words.counts
        self.first = words.first
        self.hashes = words.hashes()
        n = len(self.hashes)
        ends = np.repeat(self.first[1:], self.counts)
        self.grams = run_hashes(self.hashes, gram)
        #: Starts of windows that end in their own text.
        self.valid = np.arange(max(n - window + 1, 0)) + window <= ends[: max(n - window + 1, 0)]
        #: The anchor of each window: its smallest gram.
        self.least = slide(self.grams, self.span, np.minimum) if len(self.valid) else np.zeros(0, np.uint64)
        #: The hash at every place at which some window has its anchor, and that place's text.
        self.anchors, self.anchor_rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.least):
            own = np.where(self.valid, self.least, np.uint64(0))
            around = np.concatenate([np.zeros(self.span - 1, np.uint64), own, np.zeros(self.span - 1, np.uint64)])
            at = np.flatnonzero(slide(around, self.span, np.maximum) == self.grams)
            self.anchors, self.anchor_rows = self.grams[at], self.rows()[at]

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def checks(self, at: np.ndarray) -> np.ndarray:
        """32 more bits of the windows at ``at``, from the grams that cover them."""
        out = np.zeros(len(at), np.uint64)
        for offset in sorted({*range(0, self.window - self.gram + 1, self.gram), self.window - self.gram}):
            out = scramble(out ^ self.grams[at + offset])
        return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def shared_windows(self, shared: np.ndarray) -> np.ndarray:
        """Starts of windows whose anchor is in ``shared`` (sorted)."""
        if not len(self.valid) or not len(shared):
            return np.zeros(0, np.int64)
        turns = np.flatnonzero(np.concatenate([[True], self.least[1:] != self.least[:-1]]))
        own = self.least[turns]
        met = shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own
        return np.flatnonzero(np.repeat(met, np.diff(np.append(turns, len(self.least)))) & self.valid)


def bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, doc_id, text), each bucket in one partition."""
    buckets = max(1, -(-docs.count() // BUCKET_DOCS))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return base.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text").repartition(parts, "bucket")


def anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, bucket): each bucket's distinct anchors."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        values, buckets = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.lexsort((buckets, values))
        values, buckets = values[order], buckets[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (buckets[1:] != buckets[:-1])
        return pa.record_batch([pa.array(values[fresh].view(np.int64)), pa.array(buckets[fresh])], names=["anchor", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch, texts in split_batches(batches, "text"):
            a = Anchored(Words(texts), window, gram)
            if len(a.anchors):
                held.append((a.anchors, batch.column("bucket").to_numpy(zero_copy_only=False)[a.anchor_rows]))
            if sum(len(h[0]) for h in held) > MOST_PAIRS:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    return rows.mapInArrow(run, "anchor long, bucket int")


class Bucket:
    """A bucket's documents: their windows' hashes, ids' ranks and starts, in order of the rows, and the pieces they come from."""

    def __init__(self, docs: pa.Table, window: int, gram: int, shared: np.ndarray | None = None):
        ids = docs.column("doc_id").combine_chunks()
        order = pc.sort_indices(ids, null_placement="at_start")
        docs = docs.take(order).combine_chunks()
        self.ids_of_rows = ids = docs.column("doc_id").chunk(0) if docs.num_rows else ids
        text = docs.column("text").chunk(0) if docs.num_rows else pa.array([], pa.string())
        codes = np.asarray(ids.dictionary_encode(null_encoding="encode").indices)
        own = np.cumsum(np.concatenate([np.zeros(min(len(ids), 1), np.int64), codes[1:] != codes[:-1]])) if len(ids) else np.zeros(0, np.int64)
        self.pieces = []  # (first row, first word of each text, texts)
        hashes, checks, rows_, starts, places, base = [], [], [], [], [], 0
        for first, _, texts in pieces(text):
            a = Anchored(Words(texts), window, gram)
            at = np.flatnonzero(a.valid) if shared is None else a.shared_windows(shared)
            rows = a.rows()[at]
            hashes.append(run_hashes(a.hashes, window)[at])
            checks.append(a.checks(at) if shared is not None else np.zeros(0, np.int32))
            rows_.append(rows + first)
            starts.append(at - a.first[rows])
            places.append(at + base)
            self.pieces.append((first, a.first + base, texts))
            base += len(a.hashes)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hashes, self.checks, self.rows, self.starts, self.places = join(hashes, np.uint64), join(checks, np.int32), join(rows_, np.int64), join(starts, np.int64), join(places, np.int64)
        self.ids = own[self.rows]
        self.n_words = base
        #: Windows by hash, id and start; and where in that order each one's hash begins. Rows come by id, so windows do by id and start, unless an id repeats.
        self.order = np.argsort(self.hashes, kind="stable") if len(own) == 0 or own[-1] + 1 == len(own) else np.lexsort((self.starts, self.ids, self.hashes))
        fresh = np.ones(len(self.order), bool)
        fresh[1:] = self.hashes[self.order][1:] != self.hashes[self.order][:-1]
        self.leader = np.maximum.accumulate(np.where(fresh, np.arange(len(self.order)), 0))


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = GRAM) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, spans (start, stop of words that go, maximal), kept (the other words, joined by spaces).

    A word goes if it is in a run of ``window`` words that also starts earlier:
    in a smaller id, or in the same document. Ids are of any type that has an
    order; null ids stand before all others and count as one. Null texts have
    no words. Rows that repeat an id are one document: of two such places the
    one of the earlier word stays, and both if they start at the same word.
    Other columns play no part; an empty table gives no rows.
    """
    rows = bucketed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    found = anchors(rows, window, gram).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor")))
    shared = found.where("n > 1").select("bucket", "anchor")

    def candidates(docs_: pa.Table, shared_: pa.Table) -> pa.Table:
        """The first occurrence in the bucket of each window that may stand in others; place: the bucket and the start."""
        b = Bucket(docs_, window, gram, np.sort(shared_.column("anchor").to_numpy().view(np.uint64)))
        lead = np.sort(b.order[np.unique(b.leader)])  # neighbours in a document compress better together
        bucket = docs_.column("bucket")[0].as_py() if docs_.num_rows else 0
        return pa.table({"hash": b.hashes[lead].view(np.int64), "check": b.checks[lead], "doc_id": b.ids_of_rows.take(pa.array(b.rows[lead])), "place": b.starts[lead].astype(np.int64) | bucket << 32})

    by_bucket = rows.groupBy("bucket")
    windows = by_bucket.cogroup(shared.groupBy("bucket")).applyInArrow(candidates, StructType([StructField("hash", LongType()), StructField("check", IntegerType()), StructField("doc_id", kind), StructField("place", LongType())]))
    start = F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    windows = windows.select("hash", "check", "doc_id", start.alias("start"), F.shiftright("place", 32).cast("int").alias("bucket"))
    first = F.min(F.struct("doc_id", "start")).over(Window.partitionBy("hash", "check"))
    late = windows.withColumn("first", first).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start")))).select("bucket", "hash")

    def cut(docs_: pa.Table, late_: pa.Table) -> pa.Table:
        b = Bucket(docs_, window, gram)
        ids, starts = b.ids[b.order], b.starts[b.order]
        later = (ids != ids[b.leader]) | (starts != starts[b.leader])
        gone = np.sort(late_.column("hash").to_numpy().view(np.uint64))
        if len(gone):
            own = b.hashes[b.order]
            later |= gone[np.minimum(np.searchsorted(gone, own), len(gone) - 1)] == own
        edge = np.zeros(b.n_words + 1, np.int64)
        at = b.places[b.order[later]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        goes = np.cumsum(edge)[: b.n_words] > 0
        out_rows, counts, spans, kept = [], [], [], []
        for row, first_, texts in b.pieces:
            for i in range(texts.n):
                mask = goes[first_[i] : first_[i + 1]]
                words = texts.row(i).split()
                step = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                spans.append([{"start": int(s), "stop": int(e)} for s, e in zip(step[::2], step[1::2], strict=True)])
                if len(step):
                    words = [words[j] for j in np.flatnonzero(~mask)]
                counts.append(len(mask))
                kept.append(b" ".join(words))
                out_rows.append(row + i)
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.table({"doc_id": b.ids_of_rows.take(pa.array(out_rows, pa.int64())), "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return by_bucket.cogroup(late.groupBy("bucket")).applyInArrow(cut, f"doc_id {kind.simpleString()}, n_words long, spans array<struct<start: int, stop: int>>, kept string")
