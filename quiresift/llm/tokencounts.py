"""Token counts of a unigram tokenizer, by dynamic programming shared in a trie.

A pre-token is a run of non-space bytes with the word mark before it. Its
distinct pre-tokens go into a trie, one for each task; the best score of every
prefix (forward score) and its number of tokens are computed when the prefix's
node is made, from the nodes above it, and so once for all pre-tokens that
share it. The node that ends a pre-token stores its count. A document's count
is the sum over its pre-tokens. Below a depth, prefixes are hardly ever shared;
there the scores of the last few prefixes only are held, so that a pre-token
of any length takes bounded memory.

The tokenizer's model is a parameter: pieces with their scores. No unigram
model is among the public files and tokenizers are not trained here, so
``pieces_of`` gives the pieces of a public vocabulary scores by their rank as
Zipf's law has it: -ln(rank + 2). Counts are those of that model, not of the
vocabulary's own tokenizer. A byte outside all pieces is a token of its
own with a score below every piece's. Of segmentations with equal scores the
one with fewer tokens counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresift.llm.textbytes import texts_of

#: Marks the beginning of a pre-token.
MARK = "▁".encode()
#: A byte that no piece covers scores so much below the rarest piece.
BYTE_PENALTY = 10.0
#: Nodes beyond which a task's trie is begun anew; results do not change.
MOST_NODES = 600_000
#: Bytes of distinct pre-tokens whose counts a task remembers before it begins anew; longer ones than a share of it are not.
MOST_BYTES = 16 << 20
#: Bytes of a pre-token that go into the trie.
DEEPEST = 48


def pieces_of(model_file: str) -> dict[bytes, float]:
    """Pieces of a sentencepiece model, without control, byte and unknown ones, with scores by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i).encode(): -math.log(rank + 2.0) for rank, i in enumerate(ids)}


class Vocabulary:
    """Pieces, reversed in a trie of nested dicts; key 256 holds a piece's score."""

    def __init__(self, scores: dict[bytes, float]):
        self.byte_score = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.longest = max(map(len, scores), default=1)
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for byte in reversed(piece):
                node = node.setdefault(byte, {})
            node[256] = score

    def step(self, text: bytes, end: int, scores: list[float], tokens: list[int], first: int) -> tuple[float, int]:
        """Best score and fewest tokens of ``text[:end]``, from those of its prefixes; the lists begin with that of length ``first``."""
        best, fewest = scores[end - 1 - first] + self.byte_score, tokens[end - 1 - first] + 1
        piece, j = self.root, end
        while j > 0:
            piece = piece.get(text[j - 1])
            if piece is None:
                break
            j -= 1
            if 256 in piece:
                score, count = scores[j - first] + piece[256], tokens[j - first] + 1
                if score > best or score == best and count < fewest:
                    best, fewest = score, count
        return best, fewest


class Trie(dict):
    """Pre-token (without mark) -> tokens. Missing ones are inserted; nodes hold forward scores."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.clear_nodes()

    def clear_nodes(self) -> None:
        self.clear()
        self.held = 0
        self.children: dict[int, int] = {}  # node * 256 + byte -> node
        self.score: list[float] = [0.0]
        self.tokens: list[int] = [0]

    def walk(self, text: bytes) -> tuple[list[float], list[int]]:
        """Scores and tokens of all prefixes of ``text``, the empty one first; new nodes get theirs."""
        children, score, tokens = self.children, self.score, self.tokens
        node, scores, counts = 0, [0.0], [0]
        for end, byte in enumerate(text, 1):
            child = children.get(node << 8 | byte)
            if child is None:
                best, fewest = self.vocabulary.step(text, end, scores, counts, 0)
                child = children[node << 8 | byte] = len(score)
                score.append(best)
                tokens.append(fewest)
            node = child
            scores.append(score[node])
            counts.append(tokens[node])
        return scores, counts

    def __missing__(self, word: bytes) -> int:
        if len(self.score) > MOST_NODES or self.held > MOST_BYTES:
            self.clear_nodes()
        text = MARK + word
        scores, counts = self.walk(text[: len(MARK) + DEEPEST])
        first, longest, step = 0, self.vocabulary.longest, self.vocabulary.step
        for end in range(len(MARK) + DEEPEST + 1, len(text) + 1):
            best, fewest = step(text, end, scores, counts, first)
            scores.append(best)
            counts.append(fewest)
            if len(scores) > 8 * longest + 1024:
                first += len(scores) - longest
                del scores[:-longest], counts[:-longest]
        if len(word) <= MOST_BYTES >> 10:
            self[word] = counts[-1]
            self.held += len(word) + 100
        return counts[-1]


def count_tokens(docs: DataFrame, scores: dict[bytes, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, n_pretokens, n_tokens, n_bytes.

    Null and empty texts, and white space alone, have 0 of all but bytes. Rows
    stand alone: ids may be null or repeat; other columns play no part; an
    empty table gives no rows. ``scores``: piece (UTF-8) -> score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(Vocabulary(sent.value))
        for batch in batches:
            texts = texts_of(batch.column("text"))
            n_words, n_tokens = np.zeros(texts.n, np.int64), np.zeros(texts.n, np.int64)
            for i in range(texts.n):
                words = texts.row(i).split()
                n_words[i] = len(words)
                n_tokens[i] = sum(map(trie.__getitem__, words))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words), pa.array(n_tokens), pa.array(np.diff(texts.starts))], names=["doc_id", "n_pretokens", "n_tokens", "n_bytes"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long, n_bytes long")
