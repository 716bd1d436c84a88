"""Packing: order-preserving cuts of the token stream by dynamic programming.

Each input partition's documents, in order, are one stream of tokens (a document's ids, then the
separator).  The stream is cut into sequences of at most ``limit`` tokens at document or sentence
ends.  A cut costs its sequence's padding plus a truncation penalty (none at a document's end,
``SENTENCE`` at a sentence's, ``HARD`` at a place inside a sentence, offered only where sentences
are longer than ``STRIDE``).  With cost(i, j) = limit - (b[j] - b[i]) the best predecessor is the
smallest f(i) + b[i] within reach, which a monotone queue gives in constant time; sequences whose
length is a power of two need no padding and are looked up apart.

Scale: a narrow map, without a shuffle: texts are encoded and cut a slice at a time, the last
sequence of a slice is carried into the next.  Only a partition's last sequence is padded for
want of documents.  ``sequence_id`` is the partition's number and a count within it; a rerun of a
lost task reads the same rows and gives the same pieces.

Defined results: null or empty text is the separator alone; a document longer than ``limit`` is
cut at sentence ends; repeated rows are packed each; a null doc_id stays null; an empty table gives
an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import bpe
from cadenza.llm.common import text_or_empty

LIMIT = 1024
SEPARATOR = 0
SENTENCE, HARD = 6, 48   # truncation penalties, in tokens of padding
SEQUENCE = 3             # a sequence's own cost: fewer sequences before more
STRIDE = 128             # inside longer sentences a cut is offered so often
LEAST_POWER = 64         # shorter powers of two are no targets

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def cut_windows(places: list[int], costs: list[int], limit: int = LIMIT) -> list[int]:
    """Ends of the cheapest sequences.  ``places`` rise from 0 in steps of at most ``limit``;
    ``costs`` are the penalties of a cut there.  Ties go to the longer sequence."""
    powers = [1 << k for k in range(limit.bit_length()) if LEAST_POWER <= 1 << k <= limit]
    best, back = [0] * len(places), [0] * len(places)
    index = {0: 0}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + b[i], i), rising
    for j in range(1, len(places)):
        b = places[j]
        while places[queue[0][1]] < b - limit:
            queue.popleft()
        least, i = queue[0]
        cost = least + limit - b
        for p in powers:
            k = index.get(b - p)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        cost += costs[j] + SEQUENCE
        best[j], back[j] = cost, i
        index[b] = j
        key = cost + b
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], len(places) - 1
    while j:
        ends.append(places[j])
        j = back[j]
    return ends[::-1]


def offered(doc_ends: np.ndarray, sentence_ends: np.ndarray, stride: int = STRIDE):
    """Places of cuts (from 0) and their penalties."""
    places = np.unique(np.concatenate([[0], sentence_ends, doc_ends]))
    gaps = np.diff(places)
    long = np.flatnonzero(gaps > stride)
    extra = [np.arange(places[g] + stride, places[g + 1], stride) for g in long.tolist()]
    hard = np.concatenate([np.zeros(0, np.int64), *extra]).astype(np.int64)
    every = np.concatenate([places, hard])
    costs = np.concatenate([np.full(len(places), SENTENCE), np.full(len(hard), HARD)])
    costs[:len(places)][np.isin(places, doc_ends)] = 0
    order = np.argsort(every)
    return every[order].tolist(), costs[order].tolist()


class Stream:
    """A partition's tokens not yet packed, and where their documents begin."""

    def __init__(self, partition: int, limit: int):
        self.limit = limit
        self.sequence = partition << 40
        self.ids = np.zeros(0, np.uint32)
        self.sentences = np.zeros(0, np.int64)
        self.docs: list = []                       # doc_id of each document in the buffer
        self.begin = np.zeros(0, np.int64)         # its first token's place (below 0: partly out)
        self.size = np.zeros(0, np.int64)

    def add(self, docs: list, ids: np.ndarray, size: np.ndarray, sentences: np.ndarray) -> None:
        at = len(self.ids)
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.sentences = np.concatenate([self.sentences, sentences + at])
        self.docs += docs
        self.begin = np.concatenate([self.begin, at + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])

    def pack(self, last: bool) -> dict[str, list]:
        """Pieces of all sequences but the last, or of all of them."""
        ends = self.begin + self.size
        places, costs = offered(ends, self.sentences)
        cuts = cut_windows(places, costs, self.limit) if len(places) > 1 else []
        if not last:
            cuts = cuts[:-1]
        done = cuts[-1] if cuts else 0
        out = self._pieces(np.array(cuts, np.int64), ends, done)
        self.sequence += len(cuts)
        left = ends > done
        self.ids = self.ids[done:]
        self.sentences = self.sentences[self.sentences > done] - done
        self.docs = [d for d, keep in zip(self.docs, left.tolist(), strict=True) if keep]
        self.begin, self.size = self.begin[left] - done, self.size[left]
        return out

    def _pieces(self, cuts: np.ndarray, ends: np.ndarray, done: int) -> dict[str, list]:
        if not done:
            return {}
        opens = np.concatenate([[0], cuts[:-1]])
        first = np.unique(np.concatenate([opens, self.begin[(self.begin > 0) & (self.begin < done)]]))
        stop = np.concatenate([first[1:], [done]])
        doc = np.searchsorted(ends, first, side="right")
        sequence = np.searchsorted(cuts, first, side="right")
        raw = memoryview(self.ids.astype("<u4").tobytes())
        return {
            "doc_id": [self.docs[d] for d in doc.tolist()],
            "start": first - self.begin[doc], "length": stop - first,
            "ids_crc32": [zlib.crc32(raw[4 * a:4 * b])
                          for a, b in zip(first.tolist(), stop.tolist(), strict=True)],
            "doc_tokens": self.size[doc], "sequence_id": self.sequence + sequence,
            "offset": first - opens[sequence]}


def pack_documents(docs: DataFrame, path: str = bpe.DEFAULT_PATH, limit: int = LIMIT,
                   separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    def rows(pieces: dict[str, list]) -> list[pa.RecordBatch]:
        return [pa.RecordBatch.from_pydict({k: pa.array(x, pa.int64()) for k, x in pieces.items()})
                ] if pieces else []

    def run(batches):
        v = bpe.vocabulary(path)
        stream = Stream(TaskContext.get().partitionId(), limit)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, texts in bpe.slices(batch.column(1)):
                ids, offsets, word_token, final = bpe.encode_texts(v, texts)
                size = np.diff(offsets) + 1
                begin = np.cumsum(size) - size
                every = np.full(int(size.sum()), separator, np.int64)
                every[bpe.ranges(begin, size - 1)] = ids
                ends = word_token[1:][final]  # tokens before a sentence's end, as without separators
                doc = np.searchsorted(offsets, ends, side="left") - 1
                stream.add(names[first:first + len(texts)], every, size, ends + doc)
                yield from rows(stream.pack(False))
        yield from rows(stream.pack(True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInArrow(run, SCHEMA)
