"""Token counts under a unigram vocabulary: a Viterbi pass that keeps scores and counts only.

Text is cut into words at spaces (each word starts with the space sign), as the unigram tokenizer's
pre-tokenizer does, so words are independent and each distinct word of a slice is counted once.
For a word, an Aho-Corasick automaton enumerates the vocabulary's pieces by their end; the dynamic
program keeps at each place the best score and the number of pieces on its path, nothing else.

The tokenizer's rules: of equal scores the path whose last piece starts first wins (the automaton
reports longer pieces first, a later one has to be strictly better); a character that is no piece
by itself costs the least score less ``UNKNOWN_PENALTY``; unknown characters count one token for
each UTF-8 byte where the vocabulary has byte pieces, else a run of them counts one.

Scale: a narrow map over the documents in slices; the vocabulary is read by each worker process
from ``path``; the memory of counted words is bounded by ``REMEMBERED``.

Defined results: null or empty text has no tokens and score 0; repeated rows are counted each; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.bpe import slices
from cadenza.llm.common import text_or_empty, worker_cache

DEFAULT_PATH = public_tokenizers.path("piece_bpe_32k.model")
SPACE_SIGN = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 200_000   # distinct words kept between slices
SLICE = 1_000_000


def pieces(path: str = DEFAULT_PATH) -> list[tuple[str, float]]:
    """The vocabulary of a model file, with the scores that it states."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts tokens of words over a vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        scores = {}
        for piece, score in vocabulary:
            scores[piece] = score  # of a repeated piece the last counts
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.by_bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.words: dict[str, tuple[int, float]] = {}

    def count(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of the best path."""
        n = len(word)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        after_unknown = [False] * (n + 1)
        hits: list[list] = [[] for _ in range(n)]
        for end, hit in self.automaton.iter(word):
            hits[end].append(hit)
        for end in range(1, n + 1):
            best, start, known = None, 0, True
            for length, s in hits[end - 1]:
                s += score[end - length]
                if best is None or s > best:
                    best, start = s, end - length
            char = word[end - 1]
            if char not in self.single:
                s = score[end - 1] + self.unknown
                if best is None or s > best:
                    best, start, known = s, end - 1, False
            score[end] = best
            if known:
                count[end] = count[start] + 1
            elif self.by_bytes:
                count[end] = count[start] + len(char.encode())
            else:
                count[end] = count[start] + (not after_unknown[start])
            after_unknown[end] = not known
        return count[n], score[n]

    def of(self, word: str) -> tuple[int, float]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            found = self.words[word] = self.count(word)
        return found


def words_of(text: str) -> list[str]:
    """Words with their leading space sign; a text without one at its start gets one."""
    if not text:
        return []
    text = text.replace(" ", SPACE_SIGN)
    parts = text.split(SPACE_SIGN)
    return parts[1:] if text[0] == SPACE_SIGN else parts


def count_texts(counter: Counter, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens and score of each text."""
    split = [words_of(t) for t in texts]
    size = np.array([len(s) for s in split], np.int64)
    coded = pa.array([w for s in split for w in s], pa.large_string()).dictionary_encode()
    found = [counter.of(SPACE_SIGN + w) for w in coded.dictionary.to_pylist()]
    which = coded.indices.to_numpy()
    tokens = np.concatenate([[0], np.cumsum(np.array([f[0] for f in found], np.int64)[which])]) \
        if found else np.zeros(1, np.int64)
    scores = np.concatenate([[0.0], np.cumsum(np.array([f[1] for f in found])[which])]) \
        if found else np.zeros(1)
    ends = np.cumsum(size)
    return tokens[ends] - tokens[ends - size], scores[ends] - scores[ends - size]


def token_counts(docs: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """doc_id, n_tokens, score - one row per document."""
    def run(batches):
        cache = worker_cache()
        if ("unigram", path) not in cache:
            cache["unigram", path] = Counter(pieces(path))
        counter = cache["unigram", path]
        for batch in batches:
            for first, texts in slices(batch.column(1), SLICE):
                tokens, scores = count_texts(counter, texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(tokens),
                     pa.array(scores)], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInArrow(run, "doc_id long, n_tokens long, score double")
