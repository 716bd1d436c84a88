import math

import numpy as np
import pytest

from llm_cases import make  # noqa: F401
from cadenza.llm import hard_negatives as H

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute_force(rows, every=100, top=5):
    use = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(
                x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for n, (i, label, q) in enumerate(use):
        if i % every:
            continue
        scored = sorted(((-score(q, r), j, k, m) for m, (j, k, r) in enumerate(use) if m != n))
        for s, p, _, _ in [x for x in scored if x[2] == label][:top]:
            found = [x for x in scored if x[2] != label
                     and 80 * -s <= 100 * -x[0] <= 100 * -s][:top]
            out += [(i, p, at + 1, x[1], -s, -x[0]) for at, x in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "'x' as rid", "1 as block", "2 as q", "'y' as ask", "3 as windows")


def random_rows(n=700, dims=7, seed=3):
    rng = np.random.default_rng(seed)
    out = [(i, rng.integers(-3, 4, dims).astype(float).tolist(), int(rng.integers(0, 10)))
           for i in range(n)]
    # a label with a third of all rows, and many equal vectors
    out += [(i, [1.0, 0.5, 0.0, 0.0, 2.0, 0.0, 1.0], 4) for i in range(n, n + n // 2)]
    return out


ODD = [(None, [1.0] * 7, 1), (1001, None, 1), (1002, [1.0] * 7, None), (1100, [], 2),
       (1200, [3.0], 2), (1300, [1.0, None], 2), (1400, [float("nan")] * 7, 2),
       (1500, [float("inf"), 1.0], 2), (1600, [0.0] * 7, 9), (1600, [0.0] * 7, 9),
       (1600, [1.0] * 9, 5), (-100, [2.0, -1.0, 0.25] * 3, 4), (1700, [0.1, -0.1] * 3, -3)]


@pytest.mark.parametrize("block,anchors", [(2048, 8192), (60, 4)])
def test_equal_brute_force(spark, block, anchors):
    rows = random_rows() + ODD + ODD[-3:]
    want = brute_force(rows)
    assert len(want) > 100
    assert got(H.hard_negatives(frame(spark, rows), block=block, anchors=anchors)) == want


def test_small_tables(spark):
    assert H.hard_negatives(frame(spark, [])).count() == 0
    rows = [(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 1), (102, [1.0, 1.75], 3), (200, [1.0], 8)]
    want = brute_force(rows)
    assert want and got(H.hard_negatives(frame(spark, rows))) == want
    big = [(i, [3e38 if i == 102 else 1e5, 1.0], i % 2) for i in range(98, 106)]
    assert got(H.hard_negatives(frame(spark, big))) == brute_force(
        [r for r in big if r[0] != 102])


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (64, 64, 64), (33, 70, 129), (200, 65, 31)])
def test_strassen(shape):
    rng = np.random.default_rng(list(shape))
    m, k, n = shape
    a = rng.integers(-2 ** 27, 2 ** 27, (m, k))
    b = rng.integers(-2 ** 27, 2 ** 27, (k, n))
    want = a.astype(object) @ b.astype(object)
    for leaf in (1, 2, 16):
        assert (H.strassen(a, b, leaf) == want).all()
    assert (H.strassen(np.full((40, 40), 2 ** 28), np.full((40, 40), 2 ** 28)) == 40 * 2 ** 56).all()


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    want = brute_force(rows)
    assert want and got(H.hard_negatives(df)) == want
