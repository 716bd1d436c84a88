import hashlib
import re

from llm_cases import EDGES, WORDS, documents, make, words  # noqa: F401
from cadenza.llm import winnowing as W

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split(text):
    lower = (text or "").translate(str.maketrans(UPPER, UPPER.lower()))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_force(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = split(text)
        m = min(width, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add(item)
    widths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, held = split(text), set(), set()
        for m in widths:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit.update(range(i, i + m))
                    held |= windows[tuple(w[i:i + m])]
        held = sorted(str(x) for x in held if x is not None)
        out.append((doc, len(w), len(hit), len(held),
                    hashlib.sha256(",".join(held).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                                        "contaminated")) for r in df.collect()), key=repr)


ITEMS = [(1, words(*range(60, 90))), (2, words(*range(70, 85))), (2, words(*range(200, 212))),
         (3, "Short One!"), (4, words(7, 8, 9)), (5, None), (6, " .. "), (7, words(*[5] * 14)),
         (None, words(*range(300, 315))), (10, "ÉTÉ, Straße é3"), (11, words(*range(110, 120)))]

CASES = [
    (20, words(*range(60, 69))), (21, words(*range(60, 70))), (22, words(1, *range(75, 89), 2)),
    (23, "a short, ONE b short one"), (24, words(*[5] * 9)), (25, words(*[5] * 40)),
    (26, words(*range(300, 311))), (27, "x Été straße É3"), (28, "x ÉTÉ STRAßE é3 İ Ⅳ ẞ"),
    (29, "\x00".join(WORDS[i] for i in range(200, 212))),
    (30, words(*range(60, 90), *range(0, 50), *range(65, 80), *range(110, 119))),
    (30, words(*range(60, 90))), (31, words(*range(60, 75)).upper()),
    (32, ". ".join([words(*range(100, 140))] * 300)),
    (33, words(*range(72, 80), 3, *range(81, 90))), (34, "one short"),
]


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr(
        "*", "'x' as words", "1 as n", "2 as f", "'y' as doc_id", "'z' as items", "'k' as k1")


def test_spans_equal_brute_force(spark, make):
    pairs = [*EDGES, *CASES]
    df = W.scan_documents(make(pairs), items_frame(spark, ITEMS))
    assert got(df) == brute_force(pairs, ITEMS)


def test_more_fingerprints_than_the_plan_holds(spark, make, monkeypatch):
    pairs = [*EDGES, *CASES]
    monkeypatch.setattr(W, "LITERALS", 3)
    df = W.scan_documents(make(pairs), items_frame(spark, ITEMS))
    assert got(df) == brute_force(pairs, ITEMS)


def test_copies_and_widths(spark, make):
    pairs = [(i, CASES[10][1]) for i in range(200)] + [*CASES]
    for width in (1, 3, 25):
        df = W.scan_documents(make(pairs), items_frame(spark, ITEMS), width)
        assert got(df) == brute_force(pairs, ITEMS, width)


def test_spans_are_maximal(spark, make):
    rows = W.contaminated_spans(make([CASES[10]]), items_frame(spark, ITEMS)).collect()
    assert sorted((r["first"], r["last"]) for r in rows) == [(0, 30), (37, 40), (80, 95)]


def test_empty_tables(spark, make):
    pairs = [*EDGES, *CASES]
    assert got(W.scan_documents(make(pairs), items_frame(spark, []))) == brute_force(pairs, [])
    assert got(W.scan_documents(make(pairs), items_frame(spark, [(1, None), (2, "")]))) \
        == brute_force(pairs, [])
    assert W.scan_documents(make([]), items_frame(spark, ITEMS)).count() == 0
    assert W.contaminated_spans(make([]), items_frame(spark, ITEMS)).count() == 0


def test_documents(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute_force([(r["doc_id"], r["text"]) for r in documents.collect()],
                       [(r["item_id"], r["text"]) for r in items.collect()])
    assert got(W.scan_documents(documents, items)) == want
