"""Byte-level BPE encoding and decoding: speculate, verify, merge exactly only where that fails.

A batch of texts is cut into words by vectorised rules (the pre-tokenizer's pattern as operations
on arrays of code points), equal words are collapsed, and each distinct word is encoded once:

* speculate: greedy longest match through the vocabulary's trie, all words a byte at a time;
* verify: a sequence of tokens is the BPE encoding exactly if every adjacent pair is the encoding
  of its own concatenation.  The merges along the edge between two tokens are undone from the
  latest to the earliest, for all distinct pairs at once; a merge across the edge that would have
  come first refutes the pair;
* words with a refuted pair are merged exactly, by a heap.

Scale: a narrow map over the documents; texts are handled in slices of ``SLICE`` characters, so a
task's memory is bounded whatever the batch (one text of any length is one slice).  The vocabulary
is read by each worker process from ``path``.

Defined results: null text is empty (no tokens); every other text decodes to itself; special
tokens' strings in a text become their ids, as the tokenizer file says; repeated rows are encoded
each; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_or_empty, worker_cache

DEFAULT_PATH = public_tokenizers.path("byte_bpe_50k.json")
SLICE = 1_500_000
NONE = np.iinfo(np.int64).max

#: Code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
               0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, BLANK = range(4)


def _classes() -> np.ndarray:
    """The pattern's class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        table[c] = kinds.get(unicodedata.category(chr(c))[0], OTHER)
    table[WHITE_SPACE] = BLANK
    return table


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its rule:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, symbols = file["model"], byte_symbols()
        self.special = {a["content"].encode(): a["id"] for a in file["added_tokens"]}
        n = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.bytes = [b""] * n
        for s, i in model["vocab"].items():
            self.bytes[i] = bytes(symbols[c] for c in s)
        for b, i in self.special.items():
            self.bytes[i] = b
        self.byte_id = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.byte_id[b] = model["vocab"][c]
        # the merge that makes each token: its parts, and its rank (-1: a single byte)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.rank = np.full(n, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = model["vocab"]["".join(pair) if not isinstance(pair, str)
                                  else pair.replace(" ", "")]
            self.merges[a, b] = r, made
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = a, b, r
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.made = np.array([made for _, made in self.merges.values()], np.int64)  # by rank
        self._trie([i for i in model["vocab"].values()])
        self.classes = _classes()

    def _trie(self, ids) -> None:
        edges, token = {}, [-1]
        for i in ids:
            state = 0
            for b in self.bytes[i]:
                key = state << 8 | b
                if key not in edges:
                    edges[key] = len(token)
                    token.append(-1)
                state = edges[key]
            token[state] = i
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys = keys[order]
        self.edge_to = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.token_at = np.array(token, np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next trie state, or -1."""
        key = state << 8 | byte
        at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
        return np.where(self.edge_keys[at] == key, self.edge_to[at], -1)

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)


def vocabulary(path: str) -> Vocabulary:
    cache = worker_cache()
    if ("bpe", path) not in cache:
        cache["bpe", path] = Vocabulary(path)
    return cache["bpe", path]


# -- words --------------------------------------------------------------------------------

def word_starts(points: np.ndarray, heads: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point; ``heads`` marks the first of each text.

    The pattern: contractions, runs of letters, of numbers and of other signs, each with one
    space before it; of a longer run of white space the last character stands apart.
    """
    n = len(points)
    kind = classes[points]
    start = heads.copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    last = np.zeros(n, bool)  # the last blank before a sign of the same text
    last[:-1] = blank[:-1] & ~blank[1:] & ~heads[1:]
    start |= last
    joined = np.zeros(n, bool)  # what a single space before it belongs to
    joined[1:] = last[:-1] & (points[:-1] == 0x20)
    start &= ~joined
    for at, length in contractions(points, start, heads):
        start[at + 1] = False
        start[at + 2] &= False if length == 3 else True
        after = at + length
        after = after[after < n]
        start[after] = True
    return start


def contractions(points: np.ndarray, start: np.ndarray, heads: np.ndarray):
    """(positions of the quote, length) for 's 't 'm 'd and 're 've 'll at a word's start."""
    n = len(points)
    at = np.flatnonzero((points == 0x27) & start)
    at = at[at + 1 < n]
    at = at[~heads[at + 1]]
    one = points[at + 1]
    short = np.isin(one, [ord(c) for c in "stmd"])
    yield at[short], 2
    at = at[~short]
    at = at[at + 2 < n]
    at = at[~heads[at + 2]]
    one, two = points[at + 1], points[at + 2]
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    yield at[long], 3


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


# -- encoding -----------------------------------------------------------------------------

def propose(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Greedy longest matches: token ids in word order, and each word's number of tokens."""
    word = np.arange(len(starts))
    at, stop = starts.copy(), ends
    found_word, found_id = [], []
    while len(word):
        state = np.zeros(len(word), np.int64)
        best, size = np.full(len(word), -1, np.int64), np.zeros(len(word), np.int64)
        live, depth = np.arange(len(word)), 0
        while len(live):
            here = at[live] + depth
            live, here = live[here < stop[live]], here[here < stop[live]]
            to = v.step(state[live], data[here].astype(np.int64))
            live, to = live[to >= 0], to[to >= 0]
            state[live] = to
            depth += 1
            token = v.token_at[to]
            hit = live[token >= 0]
            best[hit], size[hit] = token[token >= 0], depth
        found_word.append(word)
        found_id.append(best)
        at = at + size
        more = at < stop
        word, at, stop = word[more], at[more], stop[more]
    if not found_word:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.concatenate(found_word)
    order = np.argsort(words, kind="stable")
    return np.concatenate(found_id)[order], np.bincount(words, minlength=len(starts))


def compatible(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the encoding of each a's and b's joint bytes is exactly [a, b]."""
    good = np.ones(len(a), bool)
    live = np.arange(len(a))
    x, y = a.astype(np.int64), b.astype(np.int64)
    over_x, over_y = np.full(len(a), NONE), np.full(len(a), NONE)  # ranks of the undone merges
    while len(live):
        rank = v.merge_rank(x, y)
        # a merge across the edge comes first; of equal ranks the left place does
        wrong = (rank < over_x) & (rank <= over_y) & (rank < NONE)
        good[live[wrong]] = False
        rank_x, rank_y = v.rank[x], v.rank[y]
        go = ~wrong & ((rank_x >= 0) | (rank_y >= 0))
        undo_x = go & (rank_x > rank_y)
        undo_y = go & ~undo_x
        over_x[undo_x], x = rank_x[undo_x], np.where(undo_x, v.right[x], x)
        over_y[undo_y], y = rank_y[undo_y], np.where(undo_y, v.left[y], y)
        live, x, y, over_x, over_y = live[go], x[go], y[go], over_x[go], over_y[go]
    return good


def merge_exactly(v: Vocabulary, word: bytes) -> list[int]:
    """Merges by rank, then place."""
    ids = v.byte_id[np.frombuffer(word, np.uint8)].tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (m := v.merges.get((ids[i], ids[j]))):
            heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue  # one of the two has been merged meanwhile
        ids[i], ids[j] = made, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in ids if x >= 0]


def merge_rows(v: Vocabulary, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """``merge_exactly`` for many short words at once: each round merges one pair a word.

    Returns the tokens in word order and each word's number of tokens.
    """
    width = int(sizes.max())
    column = np.arange(width)
    at = np.minimum(starts[:, None] + column, len(data) - 1)
    inside = column < sizes[:, None]
    ids = np.where(inside, v.byte_id[data[at]], -1)
    rank = np.full(ids.shape, NONE)
    rank[:, :-1] = np.where(inside[:, 1:], v.merge_rank(ids[:, :-1], ids[:, 1:]), NONE)
    out, row = np.full(ids.shape, -1, np.int64), np.arange(len(ids))
    while len(row):
        place = rank.argmin(axis=1)
        every = np.arange(len(row))
        least = rank[every, place]
        done = least == NONE
        if done.any():
            out[row[done], :ids.shape[1]] = ids[done]
            row, ids, rank = row[~done], ids[~done], rank[~done]
            place, least, every = place[~done], least[~done], np.arange(len(row))
            if not len(row):
                break
        moved = column[None, :ids.shape[1]] > place[:, None]
        gone = np.full((len(row), 1), -1, np.int64)
        ids = np.where(moved, np.hstack([ids[:, 1:], gone]), ids)
        rank = np.where(moved, np.hstack([rank[:, 1:], gone + NONE + 1]), rank)
        ids[every, place] = v.made[least]
        for edge in (place - 1, place):
            ok = (edge >= 0) & (edge + 1 < ids.shape[1])
            r, e = every[ok], edge[ok]
            rank[r, e] = np.where(ids[r, e + 1] >= 0, v.merge_rank(ids[r, e], ids[r, e + 1]), NONE)
    return out[out >= 0], (out >= 0).sum(axis=1)


SHORT = (12, 24, 48)  # words of up to so many bytes are merged together


def exact_words(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Exact tokens of the words in order, and each word's number of tokens."""
    sizes, low = ends - starts, 0
    order, ids = [], []
    for high in SHORT:
        own = np.flatnonzero((sizes > low) & (sizes <= high))
        low = high
        if len(own):
            got, n = merge_rows(v, data, starts[own], sizes[own])
            order.append(np.repeat(own, n))
            ids.append(got)
    for w in np.flatnonzero(sizes > low).tolist():
        got = merge_exactly(v, data[starts[w]:ends[w]].tobytes())
        order.append(np.full(len(got), w))
        ids.append(np.array(got, np.int64))
    word = np.concatenate(order)
    place = np.argsort(word, kind="stable")
    return np.concatenate(ids)[place], np.bincount(word, minlength=len(starts))


def encode_words(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Token ids of distinct words in order, each word's number of tokens and first token."""
    ids, count = propose(v, data, starts, ends)
    word = np.repeat(np.arange(len(starts)), count)
    inner = np.flatnonzero(word[:-1] == word[1:])
    pairs, which = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
    bad = ~compatible(v, pairs >> 32, pairs & 0xFFFFFFFF)
    failed = np.unique(word[inner[bad[which]]])
    if len(failed):
        exact, n = exact_words(v, data, starts[failed], ends[failed])
        keep = np.ones(len(starts), bool)
        keep[failed] = False
        order = np.concatenate([word[keep[word]], np.repeat(failed, n)])
        ids = np.concatenate([ids[keep[word]], exact])[np.argsort(order, kind="stable")]
        count[failed] = n
    return ids, count, np.cumsum(count) - count


def encode_texts(v: Vocabulary, texts: list[str]):
    """ids (int32, all texts' in order), token offsets of texts, token offsets of words, and
    whether each word ends a sentence (on . ! ? or a line end)."""
    parts, part_of = [], []
    plain = [s.decode() for s in v.special]
    for i, t in enumerate(texts):
        own = [t]
        if any(s in t for s in plain):
            own = _around_special(t, plain)
        parts += own
        part_of += [i] * len(own)
    text = "".join(parts)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64)
    part_end = np.cumsum(sizes)
    heads = np.zeros(len(points) + 1, bool)
    heads[part_end - sizes] = True
    heads = heads[:-1]
    start = word_starts(points, heads, v.classes)
    special_at, special_id = [], []
    if len(parts) > len(texts):
        for p, e, n in zip(parts, part_end.tolist(), sizes.tolist(), strict=True):
            if p in plain:
                start[e - n + 1:e] = False
                special_at.append(e - n)
                special_id.append(v.special[p.encode()])
    at = np.flatnonzero(start)
    data = np.frombuffer(text.encode(), np.uint8)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.concatenate([np.cumsum(width) - width, [len(data)]])
    offsets = np.concatenate([byte_at[at], [len(data)]])
    if len(at):
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        which = coded.indices.to_numpy()
        ends = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[:len(coded.dictionary) + 1]
        store = np.frombuffer(coded.dictionary.buffers()[2] or b"", np.uint8)
        ids, count, first = encode_words(v, store, ends[:-1].copy(), ends[1:].copy())
        length = count[which]
        flat = ids[ranges(first[which], length)]
    else:
        length, flat = np.zeros(0, np.int64), np.zeros(0, np.int64)
    word_token = np.concatenate([[0], np.cumsum(length)])
    if special_at:
        flat, word_token = _with_special(flat, word_token, np.searchsorted(at, special_at),
                                         special_id)
    # each text's first word
    text_point = np.zeros(len(texts) + 1, np.int64)
    np.add.at(text_point, np.array(part_of, np.int64) + 1, sizes)
    text_token = word_token[np.searchsorted(at, np.cumsum(text_point))]
    final = data[offsets[1:] - 1] if len(at) else np.zeros(0, np.uint8)
    return (flat.astype(np.int32), text_token, word_token,
            np.isin(final, np.frombuffer(b".!?\n", np.uint8)))


def _around_special(text: str, plain: list[str]) -> list[str]:
    out, rest = [], text
    while True:
        found = min(((rest.find(s), s) for s in plain if s in rest), default=None)
        if found is None:
            return [*out, rest] if rest else out
        i, s = found
        out += [rest[:i], s] if i else [s]
        rest = rest[i + len(s):]


def _with_special(flat, word_token, words, ids):
    """The words given are each one special token."""
    length = np.diff(word_token)
    keep = np.ones(len(flat), bool)
    keep[ranges(word_token[words], length[words])] = False
    word = np.repeat(np.arange(len(length)), length)[keep]
    order = np.argsort(np.concatenate([word, words]), kind="stable")
    length[words] = 1
    return (np.concatenate([flat[keep], ids])[order],
            np.concatenate([[0], np.cumsum(length)]))


def slices(texts: pa.Array, limit: int | None = None, rows: int = 256
           ) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) runs of at most ``limit`` characters, or of one longer text.

    The array becomes Python strings ``rows`` rows at a time, so a large batch is never held twice.
    """
    limit = limit or SLICE
    held, first, size = [], 0, 0
    for at in range(0, len(texts), rows):
        for i, t in enumerate(texts.slice(at, rows).to_pylist(), at):
            if held and size + len(t) > limit:
                yield first, held
                held, first, size = [], i, 0
            held.append(t)
            size += len(t)
    if held:
        yield first, held


def encode_batches(v: Vocabulary, batches) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) batches of (doc_id, text) batches."""
    for batch in batches:
        for first, texts in slices(batch.column(1)):
            ids, offsets, _, _ = encode_texts(v, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))],
                ["doc_id", "ids"])


def encode(docs: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """doc_id and ids (array of int), one row per document."""
    def run(batches):
        yield from encode_batches(vocabulary(path), batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInArrow(run, "doc_id long, ids array<int>")


def decode_lists(v: Vocabulary, lists: pa.ListArray) -> list[str]:
    """The texts of lists of ids."""
    known = len(v.bytes)
    return [b"".join([v.bytes[i] for i in ids.as_py() or () if i is not None and 0 <= i < known])
            .decode("utf-8", "replace") for ids in lists]


def decode(encoded: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """doc_id, ids and text; bytes that are no UTF-8 become U+FFFD, ids out of range nothing."""
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array(decode_lists(v, batch.column(1)), pa.string())],
                ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """doc_id, ids and the text decoded from them: ``decode(encode(docs))`` in one pass, with one
    Python worker and one vocabulary a task."""
    def run(batches):
        v = vocabulary(path)
        for ids in encode_batches(v, batches):
            yield pa.RecordBatch.from_arrays(
                [ids.column(0), ids.column(1),
                 pa.array(decode_lists(v, ids.column(1)), pa.string())], ["doc_id", "ids", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip_digests(docs: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
        .alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
