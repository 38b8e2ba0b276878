"""Tables of awkward rows, and brute-force versions of the rules."""

import hashlib
import random
import re

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that a table may have besides, under names that operators use inside.
CLASHING = ["size", "bucket", "words", "hash", "kept", "lines", "spans", "rep", "score", "taken", "term", "position", "start", "text_hash", "band", "target", "n_words", "document", "rest", "less"]

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng, n, pool=400):
    return " ".join(f"w{int(pool * rng.random() ** 2)}" for _ in range(n))


def rows(seed=3, n=60):
    """Prose, copies, near copies, shared passages, repeated lines, and all kinds of odd rows."""
    rng = random.Random(seed)
    out, texts = [], []
    passage = sentence(rng, 60, 10_000)
    block = "\n".join(sentence(rng, 9, 10_000) for _ in range(8))
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6)))
        kind = i % 10
        if kind == 3 and texts:
            text = rng.choice(texts)
        elif kind == 4 and texts:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 5:
            text = f"{text}\n{passage}\n{sentence(rng, 8)}"
        elif kind == 6:
            text = f"{sentence(rng, 5)}\n{block}\n{text}"
        elif kind == 7:
            text = "again and again " * 30
        texts.append(text)
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), len(text)))
    long = "\n".join(sentence(rng, 40) for _ in range(400))
    odd = [None, "", " \t\r\n\x0b\x0c ", "one", "Two words", "ÀÉ ÇÖ über İK", "x" * 5000, "...", "\n\n\n", long, long + " end", "A-B_c 1,2"]
    out += [(n + i, t, None if i % 3 == 0 else "de", None if i % 2 else "a", None) for i, t in enumerate(odd)]
    out += [out[5], out[5], out[n]]  # repeated rows
    return out


def frame(spark, data, clashing=False):
    df = spark.createDataFrame(data, COLUMNS)
    if clashing:
        from pyspark.sql import functions as F

        for c in CLASHING:
            df = df.withColumn(c, F.lit("clash"))
    return df


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)
