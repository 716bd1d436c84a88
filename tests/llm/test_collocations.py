import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import EDGES, documents, make, words  # noqa: F401
from cadenza.llm import collocations as C

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute_force(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate(str.maketrans(UPPER, UPPER.lower()))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and any(
                    q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in cand.items()):
                continue
            s, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    return df.selectExpr("*", "'x' as phrase", "1 as n", "2 as words", "'y' as bucket", "3 as f")


EXTRA = [(lang, t) for lang in ("en", "de", None, "und", "") for t in (
    words(1, 2, 3, 4, 1, 2, 3, 4, 1, 2), "A b, a B! c\ta b; \x00 b \x00 é É b é",
    words(1, 2, 9, 1, 2, 3), "a " * 50, "", None, ".,;:!?\n\x0b\x0c\r", words(*range(1, 9)))]


def test_edges_equal_brute_force(spark, make):
    rows = [("en", t) for _, t in EDGES]
    assert got(C.collocations(make(EDGES), least=2)) == brute_force(rows, 2)
    assert C.collocations(make([])).count() == 0


def test_hot_pairs_are_dealt_out(spark):
    """Tiny buckets: pairs and triples overfill them, so counts come in parts."""
    hot = [("en", " ".join(f"of the {['big', f'x{i % 7}'][i % 2]} y{i}" for i in range(300)))
           for _ in range(20)]
    rows = [*EXTRA, *hot]
    want = brute_force(rows, 3)
    assert any(r[2] == "of the big" for r in want)
    for bucket in (200, 1 << 30):
        assert got(C.collocations(rows_of(spark, rows), least=3, bucket=bucket)) == want
    assert got(C.collocations(rows_of(spark, rows), least=3, top=4)) == brute_force(rows, 3, 4)


def test_documents(documents):
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    want = brute_force(rows, 12)
    assert want and got(C.collocations(documents, least=12)) == want


@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), max_size=60),
       st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_quicksort_counts_prefixes(rows, least):
    table = np.zeros((len(rows), 4), np.int64)
    for i, r in enumerate(rows):
        table[i, :len(r)] = r
    weight = np.arange(1, len(rows) + 1)
    want = Counter()
    for r, w in zip(rows, weight.tolist(), strict=True):
        for m in range(2, len(r) + 1):
            want[tuple(r[:m])] += w
        if len(r) == 1:
            want[tuple(r)] += w
    at, length, n = C.frequent_prefixes(table, weight, np.zeros(len(rows), np.int64), least)
    found = {tuple(table[i, :m].tolist()): c for i, m, c in zip(at, length, n, strict=True)}
    assert found == {p: c for p, c in want.items() if c >= least} and len(found) == len(at)
    # rows dealt out to two words give every pair, whatever its count
    at, length, n = C.frequent_prefixes(table, weight, np.full(len(rows), 2), least)
    found = {tuple(table[i, :m].tolist()): c for i, m, c in zip(at, length, n, strict=True)}
    assert found == {p: c for p, c in want.items() if c >= least or len(p) <= 2}


def test_a_task_holds_one_chunk_at_a_time(monkeypatch):
    import weakref

    import pyarrow as pa

    held, alive = [], []

    class Watched(C.Chunk):
        def __init__(self, langs, texts):
            alive.append(sum(r() is not None for r in held))
            super().__init__(langs, texts)
            held.append(weakref.ref(self))

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(C, "Chunk", Watched)
    monkeypatch.setattr(C, "CHUNK", 10)
    texts = ["a b c d e f", "a b a b a b", "", "é b é b. a b"]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en", "en"], "text": texts})
    got_rows = Counter()
    for out in C.routed(Rows(), 3, [np.zeros(0, np.int64)] * 2)(iter([batch])):
        for r in out.to_pylist():
            for s, n in zip(r["suffix"], r["n"], strict=True):
                got_rows[r["lang"], r["bucket"] < 0, s] += n
    assert alive == [0] * 3
    want = Counter()
    for lang, text in zip(("en", "de", "en", "en"), texts, strict=True):
        for piece in text.split("."):
            w = piece.split()
            want[lang, True, ""] += len(w)
            for i, x in enumerate(w):
                want[lang, False, x] += 1
                if w[i + 1:]:
                    want[lang, False, " ".join(w[i:i + 4])] += 1
    assert +got_rows == +want
