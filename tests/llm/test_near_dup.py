import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_cases import EDGES, documents, make  # noqa: F401
from cadenza.llm import near_dup as N

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset(
        [tuple(w)])


def brute_force(pairs, percent=85):
    """component of each doc_id, from all pairs that share a shingle."""
    sets = [(i, set_of(t)) for i, t in pairs]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    shared = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        hits = Counter(j for x in s for j in shared[x])
        for x in s:
            if i is not None:
                shared[x].append(k)
        for j, n in hits.items():
            if i is not None and 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(i), find(sets[j][0])))
                up[b] = a
    return {i: find(i) for i in up}, Counter((i, len(s)) for i, s in sets)


def check(df, pairs, percent=85):
    got = N.near_duplicates(df, percent).collect()
    want, sizes = brute_force(pairs, percent)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def base(rng, n):
    return [f"v{rng.randint(0, 5000)}" for _ in range(n)]


def test_edges(make):
    pairs = [*EDGES, (20, "One TWO\tthree."), (21, "ONE"), (22, "a b c d"), (23, "A  B C D"),
             (24, "a b c d e"), (25, "\x1ca b c d e")]
    check(make(pairs), pairs)
    kept = N.keep_documents(make(pairs))
    assert kept.columns == make(pairs).columns
    got = [r["doc_id"] for r in kept.collect()]
    want, _ = brute_force(pairs)
    assert sorted(i or -1 for i in got) == sorted([-1, *{i for i, c in want.items() if i == c}])
    assert N.near_duplicates(make([])).count() == 0 and N.keep_documents(make([])).count() == 0


def test_star_whose_hub_is_not_first(make):
    """Copies of one text, each like it and unlike each other; the text itself has the last id."""
    rng = random.Random(3)
    text = base(rng, 200)
    pairs = []
    for i in range(260):
        own = list(text)
        own[10 + (i * 3) % 180] = f"new{i}"
        own[10 + (i * 7 + 90) % 180] = f"other{i}"
        pairs.append((i, " ".join(own)))
    pairs.append((999, " ".join(text)))
    want, _ = brute_force(pairs)
    check(make(pairs), pairs)
    assert len(set(want.values())) < 30


def test_chains_and_hot_copies(make):
    rng = random.Random(4)
    text, pairs = base(rng, 120), []
    for i in range(40):  # a chain: each is like its neighbours only
        pairs.append((500 - i, " ".join(text)))
        k = (i * 3) % 117
        text[k] = f"c{i}"
    pairs += [(1000 + i, "hot " + " ".join(base(random.Random(9), 50))) for i in range(300)]
    pairs += [(2000 + i, " ".join(base(rng, 60))) for i in range(150)]
    check(make(pairs), pairs)


def test_blocks_find_what_stars_leave(make):
    rng = random.Random(5)
    pairs = []
    for g in range(6):
        text = base(rng, 150)
        for i in range(12):
            own = list(text)
            own[(i * 11) % 150] = f"x{g}_{i}"
            own[(i * 17 + 40) % 150] = f"y{g}_{i}"
            pairs.append((g * 100 + i, " ".join(own)))
    df = make(pairs)
    want, _ = brute_force(pairs)
    got = N.near_duplicates(df, stars=0, block=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_one_doc_id_with_several_texts(make):
    """Every text of a doc_id is a node: links of each count, and they are linked by the id."""
    rng = random.Random(6)
    a, b, c = (base(rng, 80) for _ in range(3))
    near = lambda w, x: " ".join([*w[:-1], x])
    pairs = [(5, " ".join(a)), (5, " ".join(b)), (7, near(b, "seven")), (6, near(a, "six")),
             (3, " ".join(c)), (9, near(c, "nine")), (9, " ".join(a)), (9, " ".join(a)), (11, "")]
    want = {i: 3 for i in (5, 6, 7, 3, 9)} | {11: 11}
    got = N.near_duplicates(make(pairs)).collect()
    assert len(got) == len(pairs) and {r["doc_id"]: r["component_id"] for r in got} == want
    assert sorted(r["doc_id"] for r in N.keep_documents(make(pairs)).collect()) == [3, 11]


def test_documents(documents):
    pairs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    check(documents, pairs)


def test_posterior_bounds():
    low = N.least_matches(85, miss=1e-6)
    assert low == sorted(low) and len(low) == N.HASHES // N.BATCH
    rng = np.random.default_rng(0)
    for n, m in zip(range(N.BATCH, N.HASHES + 1, N.BATCH), low, strict=True):
        draws = rng.beta(m - 1 + 1, n - (m - 1) + 1, 200_000)  # one match fewer is hopeless
        assert (draws >= 0.85).mean() < 1e-4


@pytest.mark.parametrize("likeness", [0.85, 0.9])
def test_signatures_estimate_similarity(likeness):
    rng = np.random.default_rng(1)
    n = 4000
    both = int(n * 2 * likeness / (1 + likeness))
    x = rng.integers(0, 1 << 62, 2 * n - both, np.uint64)
    flat = np.concatenate([np.sort(x[:n]), np.sort(x[n - both:])])
    sig = N.minhash(flat, np.array([n, n]))
    assert abs((sig[0] == sig[1]).mean() - likeness) < 0.12


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = N.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100}
    assert {r["node"]: r["root"] for r in got} == want


@pytest.mark.parametrize("travel", [4, 100])
def test_copies_of_band_keys_are_not_broadcast(spark, monkeypatch, travel):
    """A few keys travel as they are; of more, the copies are shuffled, however small they look."""
    monkeypatch.setattr(N, "TRAVEL", travel, raising=False)
    rows = spark.createDataFrame([(n, n % 12) for n in range(300)], "node long, key long")
    keys = N.staged(spark.createDataFrame([(k, k + 1) for k in range(9)], "key long, r1 long"), "keys")
    got = N._of_keys(rows, keys)
    assert sorted(map(tuple, got.select("node", "key", "r1").collect())) == sorted(
        (n, n % 12, n % 12 + 1) for n in range(300) if n % 12 < 9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    copies, travels = "Generate explode" in plan, "BroadcastHashJoin" in plan
    assert (copies, travels) == ((True, False) if travel < 9 else (False, True))


def test_many_band_keys(monkeypatch, documents):
    monkeypatch.setattr(N, "TRAVEL", 0)
    pairs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    check(documents, pairs)
