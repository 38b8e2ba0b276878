"""Language by hierarchical discrimination.

A text's language family is predicted first, then the language within it; at
either level by linear support vector machines, one for each pair of classes,
whose votes count before the sum of their margins. Inputs are hashed runs of
three bytes of the lowered text, by the square root of their counts, scaled to
length 1.

The machines are fitted on the executors, for blocks of classes against blocks
of classes; the driver holds the languages and the fitted machines, no texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresift.llm.sampling import sample_rows
from quiresift.llm.textbytes import Texts, pieces, split_batches
from quiresift.scratch import keep

#: Hashed runs of three bytes.
BINS = 2048
#: Rows of each language that the model is fitted on, at most about so many; and of each family, shared by its languages.
PER_LANGUAGE, PER_FAMILY = 1500, 6000
#: Classes of a block: a task fits the machines between two blocks.
BLOCK = 8
UNKNOWN = "und"

#: Families of languages by code. Fixed values. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "tk", "ky"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "ne", "pa", "gu", "si"],
    "semitic": ["ar", "he", "am", "mt"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
LETTER = re.compile(r"[^\W\d_]")
ASCII_LETTERS = np.zeros(256, bool)
ASCII_LETTERS[65:91] = ASCII_LETTERS[97:123] = True


def inputs(texts: Texts) -> np.ndarray:
    low = texts.lowered()
    data, n = low.data.astype(np.uint32), low.n
    out = np.zeros((n, BINS), np.float32)
    if len(data) >= 3:
        runs = (data[:-2] | data[1:-1] << 8 | data[2:] << 16) * np.uint32(2654435761)
        bins = (runs >> np.uint32(32 - 11)).astype(np.int64)
        sizes = np.diff(low.starts)
        rows = np.repeat(np.arange(n), sizes)[:-2]
        whole = np.repeat(low.starts[1:], sizes)[:-2] >= np.arange(3, len(data) + 1)  # the run ends in its own text
        counts = np.bincount(rows[whole] * BINS + bins[whole], minlength=n * BINS).reshape(n, BINS)
        out = np.sqrt(counts.astype(np.float32))
        out /= np.maximum(np.sqrt(counts.sum(1, keepdims=True)), 1)
    return out


def has_letter(texts: Texts) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(ASCII_LETTERS[texts.data], dtype=np.int64)])
    found = np.diff(total[texts.starts]) > 0
    high = np.concatenate([[0], np.cumsum(texts.data >= 128, dtype=np.int64)])
    for i in np.flatnonzero(~found & (np.diff(high[texts.starts]) > 0)):
        found[i] = LETTER.search(texts.row(i).decode("utf-8", "replace")) is not None
    return found


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 120, cost: float = 20.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge), y -1 or 1, by Nesterov steps; classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * cost
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    ahead_w, ahead_b, t = w, b, 1.0
    rate = 1.0 / (1.0 + 4 * cost)  # rows have length 1, and 1 for the bias
    for _ in range(rounds):
        miss = np.maximum(0, 1 - y * (x @ ahead_w + ahead_b)) * weight * y
        new_w = ahead_w - rate * (ahead_w - 2 * (miss @ x))
        new_b = ahead_b + rate * 2 * float(miss.sum())
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        pull = (last - 1) / t
        ahead_w, ahead_b = new_w + np.float32(pull) * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w.astype(np.float32), new_b
    return w, b


@dataclass
class Level:
    """Machines for all pairs of ``classes``."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BINS, 0), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class index, certainty): most votes, then the greater sum of margins, then the first class."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        # Rounded, so that a text's class does not hang on the texts it is worked on with.
        margins = np.round(x.astype(np.float64) @ self.weights.astype(np.float64) + self.biases, 9)
        votes, sums = np.zeros((n, k)), np.zeros((n, k))
        for j, (a, b) in enumerate(self.pairs):
            m = margins[:, j]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            sums[:, a] += m
            sums[:, b] -= m
        best = np.argmax(votes + np.arctan(sums) / 4, 1)  # the arc tangent is under a vote
        certain = 1 / (1 + np.exp(-4 * np.clip(sums[np.arange(n), best] / (k - 1), -8, 8)))
        return best, certain


def fit_level(x: np.ndarray, of: np.ndarray, classes: list[str]) -> Level:
    pairs = [(a, b) for a in range(len(classes)) for b in range(a + 1, len(classes))]
    fitted = []
    for a, b in pairs:
        rows = (of == a) | (of == b)
        fitted.append(fit_svm(x[rows], np.where(of[rows] == a, 1.0, -1.0).astype(np.float32)))
    return Level(classes, pairs, np.stack([w for w, _ in fitted], 1) if fitted else np.zeros((BINS, 0), np.float32), np.array([b for _, b in fitted]))


@dataclass
class Model:
    families: Level | None
    within: list[Level]

    def predict(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(language, score from 0 to 1); UNKNOWN and 0 without a letter or a model."""
        names, score = np.full(texts.n, UNKNOWN, object), np.zeros(texts.n)
        if self.families is None:
            return names, score
        x = inputs(texts)
        family, certain = self.families.decide(x)
        lettered = has_letter(texts)
        for f, level in enumerate(self.within):
            rows = np.flatnonzero((family == f) & lettered)
            if len(rows):
                best, own = level.decide(x[rows])
                names[rows] = np.array(level.classes, object)[best]
                score[rows] = certain[rows] * own
        return names, score


def fit(texts: Sequence[str | None], langs: Sequence[str]) -> Model:
    if not len(langs):
        return Model(None, [])
    x = np.vstack([inputs(t) for _, _, t in pieces(pa.array(texts, pa.string()))])
    langs = np.array(langs, object)
    family_names = np.array([FAMILY_OF.get(code, f"only {code}") for code in langs], object)
    families = sorted(set(family_names))
    top = fit_level(x, np.array([families.index(f) for f in family_names]), families)
    within = []
    for f in families:
        rows = family_names == f
        classes = sorted(set(langs[rows]))
        within.append(fit_level(x[rows], np.array([classes.index(code) for code in langs[rows]]), classes))
    return Model(top, within)


def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (label, bins, amounts): the inputs above 0, as bytes of uint16 and float32; at most 6 * BINS bytes a row."""
    for batch, texts in split_batches(batches, "text"):
        x = inputs(texts)
        held = [(np.flatnonzero(row), row) for row in x]
        columns = [batch.column("label"), pa.array([at.astype(np.uint16).tobytes() for at, _ in held], pa.binary()), pa.array([row[at].tobytes() for at, row in held], pa.binary())]
        yield pa.record_batch(columns, names=["label", "bins", "amounts"])


def dense(bins: list[bytes], amounts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(bins), BINS), np.float32)
    for row, (at, values) in enumerate(zip(bins, amounts, strict=True)):
        out[row, np.frombuffer(at, np.uint16)] = np.frombuffer(values, np.float32)
    return out


def fit_block(rows: pa.Table) -> pa.Table:
    """(level, a, b, weights, bias) of all pairs of classes a of the first block and b > a of the second; rows: (level, one, two, cls, bins, amounts)."""
    level, one, two = (rows.column(c)[0].as_py() for c in ("level", "one", "two"))
    held: dict[int, list[tuple[bytes, bytes]]] = {}
    for cls, at, values in zip(*(rows.column(c).to_pylist() for c in ("cls", "bins", "amounts")), strict=True):
        held.setdefault(cls, []).append((at, values))
    made = []
    for a in sorted(c for c in held if c // BLOCK == one):
        for b in sorted(c for c in held if c // BLOCK == two and c > a):
            ordered = [sorted(held[c]) for c in (a, b)]  # the sums do not hang on the order in which rows come
            x = dense([r[0] for c in ordered for r in c], [r[1] for c in ordered for r in c])
            w, bias = fit_svm(x, np.repeat(np.array([1.0, -1.0], np.float32), [len(c) for c in ordered]))
            made.append((level, a, b, w.astype(np.float32).tobytes(), float(bias)))
    kinds = [("level", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("weights", pa.binary()), ("bias", pa.float64())]
    return pa.table({name: pa.array([m[j] for m in made], kind) for j, (name, kind) in enumerate(kinds)})


def fit_on(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, per_family: int = PER_FAMILY) -> Model:
    """Fit on about ``per_language`` rows of each language, and ``per_family`` of each family; null languages teach nothing.

    All languages are learned, however many. One-versus-one machines grow with
    the square of a family's languages; a language of no known family is one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("label"), F.col(f"`{text_col}`").alias("text")).where("label IS NOT NULL")
    sample = keep(sample_rows(rows, per_language).mapInArrow(sparse, "label string, bins binary, amounts binary"), "language-sample")
    langs = sorted(r.label for r in sample.select("label").distinct().collect())
    if not langs:
        return Model(None, [])
    family_of = {lang: FAMILY_OF.get(lang, f"only {lang}") for lang in langs}
    families = sorted(set(family_of.values()))
    members = {f: [lang for lang in langs if family_of[lang] == f] for f in families}
    # Families first, under the name ""; then the languages of each.
    places = [("", families.index(family_of[lang]), lang, len(families), min(1.0, per_family / (per_language * len(members[family_of[lang]])))) for lang in langs]
    places += [(f, k, lang, len(own), 1.0) for f, own in members.items() for k, lang in enumerate(own)]
    dealt = []
    for level, cls, lang, n, share in places:
        for other in range(-(-n // BLOCK) if n > 1 else 0):
            dealt.append((lang, level, cls, min(cls // BLOCK, other), max(cls // BLOCK, other), share))
    fitted: dict[str, dict[tuple[int, int], tuple[np.ndarray, float]]] = {}
    if dealt:
        where = spark.createDataFrame(dealt, "of string, level string, cls int, one int, two int, share double")
        drawn = F.pmod(F.xxhash64("bins", "amounts"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        spread = sample.withColumn("drawn", drawn).join(where, F.col("label") == F.col("of")).where("drawn < share").select("level", "one", "two", "cls", "bins", "amounts")
        for r in spread.groupBy("level", "one", "two").applyInArrow(fit_block, "level string, a int, b int, weights binary, bias double").toLocalIterator():
            fitted.setdefault(r.level, {})[r.a, r.b] = (np.frombuffer(r.weights, np.float32), r.bias)

    def level_of(name: str, classes: list[str]) -> Level:
        pairs = sorted(fitted.get(name, {}))
        held = [fitted[name][p] for p in pairs]
        return Level(classes, pairs, np.stack([w for w, _ in held], 1) if held else np.zeros((BINS, 0), np.float32), np.array([b for _, b in held]))

    return Model(level_of("", families), [level_of(f, members[f]) for f in families])


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, lang_pred, score.

    Only the text decides. Null and empty texts and those without a letter are
    UNKNOWN with score 0; ids may be null or repeat; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in split_batches(batches, "text"):
            names, score = sent.value.predict(texts)
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
