import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm_cases import EDGES, documents, make  # noqa: F401
from cadenza.llm import packing as P


def best_cost(places, costs, limit):
    """Brute force over all predecessors."""
    f = [0]
    for j in range(1, len(places)):
        options = []
        for i in range(j):
            n = places[j] - places[i]
            if n <= limit:
                power = n & (n - 1) == 0 and n >= P.LEAST_POWER
                options.append(f[i] + (0 if power else limit - n))
        f.append(min(options) + costs[j] + P.SEQUENCE)
    return f[-1]


def cost_of(cuts, places, costs, limit):
    at = dict(zip(places, costs, strict=True))
    total = 0
    for a, b in itertools.pairwise([0, *cuts]):
        n = b - a
        assert 0 < n <= limit
        total += (0 if n & (n - 1) == 0 and n >= P.LEAST_POWER else limit - n) + at[b] + P.SEQUENCE
    return total


def test_cuts_are_optimal():
    rng = random.Random(5)
    for _ in range(150):
        limit = rng.choice([128, 256, 200])
        places, at = [0], 0
        for _ in range(rng.randint(1, 60)):
            at += rng.randint(1, 90)
            places.append(at)
        costs = [0] + [rng.choice([0, 6, 48]) for _ in places[1:]]
        cuts = P.cut_windows(places, costs, limit)
        assert cuts[-1] == places[-1]
        assert cost_of(cuts, places, costs, limit) == best_cost(places, costs, limit)


def check(rows, pairs, partitions):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i if i is not None else -1, [*e.ids, 0]) for (i, _), e in zip(
        pairs, library.encode_batch([t or "" for _, t in pairs], add_special_tokens=False),
        strict=True))
    tokens = sum(len(w) for _, w in want)
    assert sum(r["length"] for r in rows) == tokens
    by = {}
    for i, w in want:
        by.setdefault(i, []).append(w)
    for i, own in by.items():
        pieces = sorted((r for r in rows if (r["doc_id"] if r["doc_id"] is not None else -1) == i),
                        key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == sum(map(len, own))
        for r in pieces:
            assert any(r["doc_tokens"] == len(w) and zlib.crc32(np.array(
                w[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
                for w in own)
    padding, seen = 0, {}
    for r in rows:
        seen.setdefault(r["sequence_id"], []).append(r)
    for own in seen.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.05 * tokens + 1024 * partitions


def test_edges(make):
    df = make(EDGES).coalesce(2)
    check(P.pack_documents(df).collect(), EDGES, 2)
    assert P.pack_documents(make([])).count() == 0


def test_documents_and_slices(documents, monkeypatch):
    pairs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    check(P.pack_documents(documents).collect(), pairs, documents.rdd.getNumPartitions())


def test_stream_carries_over():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 3000, 60)
    ids = rng.integers(0, 99, size.sum()).astype(np.int64)
    out = []
    s = P.Stream(0, 1024)
    for k in range(0, 60, 7):
        part = size[k:k + 7]
        a, b = size[:k].sum(), size[:k + 7].sum()
        s.add(list(range(k, k + len(part))), ids[a:b], part, np.arange(20, part.sum(), 20))
        out.append(s.pack(False))
    out.append(s.pack(True))
    rows = [dict(zip(o, x, strict=True)) for o in out if o for x in zip(*o.values(), strict=True)]
    assert sum(int(r["length"]) for r in rows) == size.sum()
    first = np.cumsum(size) - size
    for r in rows:
        a = first[r["doc_id"]] + r["start"]
        assert zlib.crc32(ids[a:a + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"]
