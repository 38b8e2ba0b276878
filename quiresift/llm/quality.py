"""Quality classifier: a factorisation machine over a whole text.

Inputs are hashed words (by the square root of their counts, scaled to length
1) and standardised statistics of the text's structure and extent. A score is

    w0 + x.w + 1/2 sum_f ((x.V_f)^2 - (x^2).(V_f^2))

through a logistic function: every pairwise interaction, in time linear in the
inputs, by the sum-of-squares identity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiresift.llm.sampling import sample_ids, sample_rows
from quiresift.llm.textbytes import Texts, Words, pieces, split_batches

#: Hashed words.
BINS = 2048
#: Factors of an interaction.
RANK = 6
#: Rows of each label that the model is fitted on, at most about so many.
PER_CLASS = 4000

NOT_NEWLINE = np.ones(256, np.uint8)
NOT_NEWLINE[10] = 0


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, LOWER_, DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
CLASSES = [UPPER, LOWER_, DIGIT, _class(".,;:?"), _class("!"), _class("|"), _class("#$%&*@^~+=<>\\/_"), _class("\"'()[]{}-"), _class("\n"), np.arange(256) >= 192, (np.arange(256) >= 128) & (np.arange(256) < 192)]
NAMES = ["upper", "lower", "digit", "stops", "shouts", "bars", "symbols", "brackets", "lines", "leads", "continued", "log_chars", "log_words", "word_bytes", "line_words", "distinct", "top_share", "repeats", "line_copies", "caps_words", "odd_ends", "odd_words"]


def shares(texts: Texts) -> np.ndarray:
    """Share of a text's bytes in each of CLASSES."""
    sizes = np.maximum(np.diff(texts.starts), 1)
    out = np.empty((texts.n, len(CLASSES)), np.float32)
    for j, held in enumerate(CLASSES):
        total = np.concatenate([[0], np.cumsum(held[texts.data], dtype=np.int64)])
        out[:, j] = np.diff(total[texts.starts]) / sizes
    return out


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[first])


def inputs(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words, structure), a row a text; both float32."""
    words = Words(texts.lowered())
    hashes = words.hashes()
    bins = (hashes >> np.uint64(40)).astype(np.int64) & (BINS - 1)
    counts = np.bincount(words.rows() * BINS + bins, minlength=texts.n * BINS).reshape(texts.n, BINS)
    n_words = words.counts
    some = np.maximum(n_words, 1)
    structure = np.empty((texts.n, len(NAMES)), np.float32)
    structure[:, : len(CLASSES)] = shares(texts)
    sizes = np.diff(texts.starts)
    chars = sizes * (1 - structure[:, len(CLASSES) - 1])
    own = Words(texts)
    first, last, lengths = texts.data[own.starts], texts.data[own.ends - 1], own.ends - own.starts
    lines = Words(texts, NOT_NEWLINE)
    keys = lines.hashes() ^ (lines.rows().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, where = np.unique(keys, return_index=True)
    distinct_lines = np.bincount(lines.rows()[where], minlength=texts.n)
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = hashes[1:] == hashes[:-1]
    letters = UPPER | LOWER_ | (np.arange(256) >= 128)
    total_upper = np.concatenate([[0], np.cumsum(UPPER[texts.data], dtype=np.int64)])
    upper_in = total_upper[own.ends] - total_upper[own.starts]
    stops = _class(".,;:?!")
    rest = [
        np.log1p(chars),
        np.log1p(n_words),
        row_sums(lengths, own.first) / some,
        n_words / np.maximum(lines.counts, 1),
        (counts > 0).sum(1) / np.minimum(some, BINS),
        counts.max(1, initial=0) / some,
        row_sums(same, words.first) / some,
        1 - distinct_lines / np.maximum(lines.counts, 1),
        row_sums((upper_in > 1), own.first) / some,
        row_sums(~(letters | DIGIT | stops)[last], own.first) / some,
        row_sums(~(letters | DIGIT)[first], own.first) / some,
    ]
    for j, value in enumerate(rest):
        structure[:, len(CLASSES) + j] = value
    hashed = np.sqrt(counts.astype(np.float32))
    hashed /= np.maximum(np.sqrt(counts.sum(1, keepdims=True)), 1)
    return hashed, structure


@dataclass
class Machine:
    """A fitted factorisation machine."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def design(self, hashed: np.ndarray, structure: np.ndarray) -> np.ndarray:
        return np.hstack([hashed, np.clip((structure - self.mean) / self.scale, -4, 4) * np.float32(0.5)]).astype(np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.w0 + x @ self.w + 0.5 * (((x @ self.v) ** 2).sum(1) - (x**2) @ (self.v**2).sum(1))

    def score(self, texts: Texts) -> np.ndarray:
        """Rounded, so that a text's score does not hang on the texts it is worked on with."""
        x = self.design(*inputs(texts)).astype(np.float64)
        return np.round(1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30))), 9)


@dataclass
class Sample:
    """Inputs of some texts; hashed words sparse: where each text's begin, their bins and amounts."""

    first: np.ndarray
    bins: np.ndarray
    amounts: np.ndarray
    structure: np.ndarray


def sparse(texts: Texts) -> Sample:
    hashed, structure = inputs(texts)
    row, column = np.nonzero(hashed)
    return Sample(np.searchsorted(row, np.arange(texts.n + 1)), column.astype(np.uint16), hashed[row, column], structure)


def joined(parts: Sequence[Sample]) -> Sample:
    counts = np.concatenate([[0], *[np.diff(p.first) for p in parts]])
    return Sample(np.cumsum(counts), np.concatenate([p.bins for p in parts]), np.concatenate([p.amounts for p in parts]), np.vstack([p.structure for p in parts]))


def fit(texts: Sequence[str | None] | pa.Array, labels: Sequence[int], rounds: int = 250, batch: int = 512, seed: int = 11) -> Machine:
    """fit_sample() of some texts."""
    parts = [sparse(t) for _, _, t in pieces(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), most_rows=256)]
    return fit_sample(joined(parts) if parts else None, labels, rounds, batch, seed)


def fit_sample(sample: Sample | None, labels: Sequence[int], rounds: int = 250, batch: int = 512, seed: int = 11) -> Machine:
    """Logistic loss, Adam steps over mini-batches, weight decay; without labels of both kinds a constant."""
    y = np.asarray(labels, np.float32)
    if sample is None or not len(y):
        return Machine(0.0, np.zeros(BINS + len(NAMES), np.float32), np.zeros((BINS + len(NAMES), RANK), np.float32), np.zeros(len(NAMES), np.float32), np.ones(len(NAMES), np.float32))
    structure = sample.structure
    machine = Machine(0.0, np.zeros(BINS + len(NAMES), np.float32), np.zeros((BINS + len(NAMES), RANK), np.float32), structure.mean(0), np.maximum(structure.std(0), 1e-3))

    def dense(take: np.ndarray) -> np.ndarray:
        """A mini-batch; hashed words are dense in it alone."""
        hashed = np.zeros((len(take), BINS), np.float32)
        for k, i in enumerate(take):
            own = slice(sample.first[i], sample.first[i + 1])
            hashed[k, sample.bins[own]] = sample.amounts[own]
        return machine.design(hashed, structure[take])

    if y.min() == y.max():
        machine.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return machine
    rng = np.random.default_rng(seed)
    machine.v = rng.normal(0, 0.02, machine.v.shape).astype(np.float32)
    machine.w0 = float(np.log(y.mean() / (1 - y.mean())))
    slots = [np.zeros_like(machine.w), np.zeros_like(machine.w), np.zeros_like(machine.v), np.zeros_like(machine.v)]
    order, at = rng.permutation(len(y)), 0
    for step in range(1, rounds + 1):
        if at + batch > len(order):
            order, at = rng.permutation(len(y)), 0
        take = order[at : at + batch]
        at += batch
        xb = dense(take)
        xv = xb @ machine.v
        margin = machine.w0 + xb @ machine.w + 0.5 * ((xv**2).sum(1) - (xb**2) @ (machine.v**2).sum(1))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[take]) / len(take)
        grad_w = xb.T @ error + 1e-5 * machine.w
        grad_v = xb.T @ (error[:, None] * xv) - ((xb**2).T @ error)[:, None] * machine.v + 1e-4 * machine.v
        rate = 0.03 * min(1.0, 2 * (1 - step / (rounds + 1)))
        machine.w0 -= rate * float(error.sum())
        for value, grad, m, s in ((machine.w, grad_w, slots[0], slots[1]), (machine.v, grad_v, slots[2], slots[3])):
            m += 0.1 * (grad - m)
            s += 0.01 * (grad**2 - s)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    machine.w, machine.v = machine.w.astype(np.float64), machine.v.astype(np.float64)
    return machine


def fit_on(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Machine:
    """Fit on about ``per_class`` rows a label of ``docs`` joined with ``labels``; null labels and ids are passed over.

    Inputs are made on the executors; the driver gets those of the sample, at
    most 6 * BINS bytes and the structure of each row, no texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in split_batches(batches, "text"):
            s = sparse(texts)
            cut = lambda values: [values[a:b].tobytes() for a, b in zip(s.first, s.first[1:], strict=False)]
            yield pa.record_batch([batch.column("label"), pa.array(cut(s.bins), pa.binary()), pa.array(cut(s.amounts), pa.binary()), pa.array([r.tobytes() for r in s.structure], pa.binary())], names=["label", "bins", "amounts", "structure"])

    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").dropDuplicates(["id"])
    # Some thousands of ids, however many labels there are; an id on many rows is held to the bound by the second draw.
    drawn = F.broadcast(sample_ids(marked, per_class))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(drawn, "id").select("id", "label", "text")
    found = sample_rows(rows, per_class).mapInArrow(run, "label int, bins binary, amounts binary, structure binary").toArrow()
    held = sorted(zip(*(found[c].to_pylist() for c in ("label", "bins", "amounts", "structure")), strict=True))
    if not held:
        return fit_sample(None, [])
    counts = np.concatenate([[0], [len(r[1]) // 2 for r in held]])
    sample = Sample(np.cumsum(counts), np.frombuffer(b"".join(r[1] for r in held), np.uint16), np.frombuffer(b"".join(r[2] for r in held), np.float32), np.frombuffer(b"".join(r[3] for r in held), np.float32).reshape(len(held), -1))
    return fit_sample(sample, [r[0] for r in held])


def score_column(machine: Machine, text: Column, spark) -> Column:
    """The score (0 to 1) of each whole text; null and empty texts have one too, the same."""
    sent = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [sent.value.score(t) for _, _, t in pieces(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(text)
