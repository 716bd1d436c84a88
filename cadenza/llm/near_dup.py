"""MinHash near-duplicates with sequential Bayesian verification.

1. ``signatures``: a document's set of shingles (distinct runs of five words, A-Z lower-cased), its
   size, an order-free 128-bit fingerprint of the set, and a MinHash signature; one narrow pass.
2. Documents with equal sets form a class, a node of its own, whose text is that of its smallest
   doc_id; the rest works on classes, so a group of exact copies of any size costs one.
3. Bands of the signature are bucket keys.  ``BANDS`` bands of ``ROWS`` miss a pair of similarity
   0.85 with a chance below 1e-6.
4. Star rounds: every member of a bucket is paired with the bucket's hub only.  ``prune`` compares
   the pair's signatures a batch of hashes after another and drops it as soon as the posterior
   chance that its similarity reaches the threshold is below ``MISS``; survivors are confirmed on
   their full sets.  Confirmed links give components.
5. Buckets whose members are all in one component are done.  In the others, every pair of members
   in different components is checked in blocks of ``BLOCK`` members (a large bucket is dealt out
   as pairs of blocks), again by batches, then on full sets; a block emits only links that join
   two components, never its pairs.  So no link is lost that the bands have found.

Scale: signatures are 0.5 KB a document, staged once; only texts that share a bucket are staged and
joined (a text takes a third of its set's hashes), and full sets are built where pairs are confirmed.
Members of a band key are joined in salted parts.  Buckets are found by a partial aggregate; nothing of unbounded size reaches one
task or the driver (the driver holds counts, and tables that it broadcasts: up to ``TRAVEL`` band keys).  Components are contracted in staged rounds.

Defined results: null, empty or wordless text has an empty set, is linked with nothing and is its
own component; with fewer than five words the whole sequence is the one shingle; rows that share a
doc_id are one document and linked; a row with null doc_id is linked with nothing, its component is
null and it is kept; an empty table gives an empty result; other columns are ignored.  Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.bpe import slices
from cadenza.llm.common import staged, text_or_empty, worker_cache
from cadenza.session import Stages

SHINGLE = 5
PERCENT = 85
HASHES, BANDS, ROWS = 128, 25, 5
BATCH = 32
MISS = 1e-6
BLOCK = 192
ROWS_PER_GROUP = 1024   # rows handed to Python at once, of many small cells
STARS = 3
SALTS = 16            # parts in which the members of a band key are joined
TRAVEL = 50_000       # band keys that are broadcast, by their count; more are shuffled
SLICE = 1_000_000
SEED = 2025


# -- sets and signatures ------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, stream: int) -> np.ndarray:
    return np.random.default_rng([SEED, stream]).integers(0, 1 << 63, n, np.uint64) << np.uint64(1) \
        | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2**64, from a worker's cache."""
    cache = worker_cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        base = int(_odd(1, 0)[0])
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        cache["powers"] = tuple(both)
    return cache["powers"]


def blank_bytes() -> np.ndarray:
    """Whether a byte separates words."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def word_hashes(texts: list[str], blanks: np.ndarray | None = None):
    """Hashes of all words in order (A-Z lower-cased), and each text's number of words.

    ``blanks`` says which bytes separate words (it has to hold the space)."""
    raw = " ".join(texts).encode()
    data = np.frombuffer(raw, np.uint8)
    size = np.array([len(t.encode()) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    blank = (blank_bytes() if blanks is None else blanks)[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    first = np.searchsorted(starts, np.concatenate([begin, [len(data) + 1]]))
    return hashes, np.diff(first)


def shingle_sets(texts: list[str], width: int = SHINGLE):
    """Sorted distinct shingle hashes of all texts in order, and each set's size."""
    words, count = word_hashes(texts)
    odd = _odd(width + 1, 1)
    first = np.cumsum(count) - count
    n = len(words) - width + 1
    joint = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        joint += words[k:k + max(n, 0)] * odd[k]
    joint = mix(joint)
    sets = []
    for f, c in zip(first.tolist(), count.tolist(), strict=True):
        if c >= width:
            sets.append(np.unique(joint[f:f + c - width + 1]))
        elif c:
            sets.append(mix((words[f:f + c] * odd[:c]).sum(keepdims=True)
                            + np.array([c], np.uint64) * odd[width:]))
        else:
            sets.append(np.zeros(0, np.uint64))
    size = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), size


def minhash(flat: np.ndarray, size: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """uint32 signatures, a row for each set; an empty set's row is all ones."""
    out = np.full((len(size), hashes), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(size)
    if len(some):
        at = (np.cumsum(size) - size)[some]
        times, plus = _odd(hashes, 2), _odd(hashes, 3)
        for j in range(hashes):
            out[some, j] = np.minimum.reduceat((flat * times[j] + plus[j]) >> np.uint64(32), at)
    return out


def fingerprints(flat: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two order-free 64-bit hashes of each set."""
    ends, keys = np.cumsum(size), []
    for stream in (5, 6):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat * _odd(1, stream)[0]))])
        keys.append((total[ends] - total[ends - size]).astype(np.uint64).view(np.int64))
    return keys


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the set's fingerprint), bands (array of long), sig (binary)."""
    def run(batches):
        odd = _odd(ROWS + 1, 4)
        for batch in batches:
            for first, texts in slices(batch.column(1), SLICE):
                flat, size = shingle_sets(texts)
                keys = fingerprints(flat, size)
                rows = minhash(flat, size)
                wide = rows[:, :BANDS * ROWS].astype(np.uint64).reshape(len(rows), BANDS, ROWS)
                bands = mix((wide * odd[:ROWS]).sum(axis=2, dtype=np.uint64)
                            + np.arange(BANDS, dtype=np.uint64) * odd[ROWS])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(size),
                     pa.array(keys[0]), pa.array(keys[1]),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()),
                         pa.array(bands.view(np.int64).ravel())),
                     pa.array([r.tobytes() for r in rows.astype(np.uint16)], pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, "
                         "sig binary")


def texts_of(docs: DataFrame, wanted: DataFrame, plain: bool) -> DataFrame:
    """node, text of the classes in ``wanted`` (node, rep, k1, k2).

    A class's text is that of the row of doc_id ``rep`` with its fingerprint; in a ``plain`` table
    (no doc_id twice) that is the one row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), text_or_empty().alias("text"))
    if plain:
        return rows.join(wanted.select("rep", "node"), "rep").select("node", "text")

    def own(batches):
        for batch in batches:
            keep = []
            for first, texts in slices(batch.column(1), SLICE):
                keys = fingerprints(*shingle_sets(texts))
                keep += [first + i for i, (x, y) in enumerate(zip(*[k.tolist() for k in keys],
                                                                  strict=True))
                         if (x, y) == (batch.column(2)[first + i].as_py(),
                                       batch.column(3)[first + i].as_py())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], ["node", "text"])

    rows = rows.join(wanted, "rep").select("node", "text", "k1", "k2")
    return rows.mapInArrow(own, "node long, text string").dropDuplicates(["node"])


# -- verification -------------------------------------------------------------------------

def least_matches(percent: int, miss: float = MISS, batch: int = BATCH,
                  hashes: int = HASHES) -> list[int]:
    """For n = batch, 2 * batch ...: the fewest matches of n at which the posterior chance (under
    a uniform prior) that the similarity is percent / 100 or more is still ``miss``."""
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            m += 1
            chance += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int], batch: int = BATCH) -> np.ndarray:
    """Rows of the signature arrays that no batch refutes."""
    live = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k, low in enumerate(least):
        part = slice(k * batch, (k + 1) * batch)
        matches = matches + (a[live, part] == b[live, part]).sum(axis=1)
        live, matches = live[matches >= low], matches[matches >= low]
    return live


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def verify(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    least = least_matches(percent)

    def prune(batches):
        for batch in batches:
            keep = survivors(_sig(batch.column(2)), _sig(batch.column(3)), least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    def confirm(batches):
        for batch in batches:
            for first, left in slices(batch.column(2), SLICE):
                right = batch.column(3).slice(first, len(left)).to_pylist()
                sides = []
                for some in (left, right):
                    flat, size = shingle_sets(some)
                    sides.append(np.split(flat, np.cumsum(size)[:-1]))
                keep = [first + i for i, (x, y) in enumerate(zip(*sides, strict=True))
                        if linked(x, y, percent)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], ["a", "b"])

    def beside(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(rows.select(F.col("node").alias(side),
                                           F.col(value).alias(f"{value}_{side}")), side)
        return pairs.select("a", "b", f"{value}_a", f"{value}_b")

    left = staged(beside(pairs, sigs, "sig").mapInArrow(prune, "a long, b long"), "pairs")
    return staged(beside(left, texts, "text").mapInArrow(confirm, "a long, b long"), "links")


# -- components ---------------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``links`` (a, b)."""
    with Stages() as scratch:
        labels = _components(links)
        scratch.release(labels)
    return labels


def _components(links: DataFrame) -> DataFrame:
    edges = staged(links.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = staged(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                    .withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "next")
        hooks = staged(both.groupBy("node").agg(F.min("next").alias("up")).select(
            "node", F.least("node", "up").alias("up")), "hooks")
        while True:  # pointers to pointers, until every node points to its root
            over = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = staged(hooks.join(over, "up").select(
                "node", "up", F.col("top")), "hooks")
            done = jumped.filter("up <> top").isEmpty()
            hooks = jumped.select("node", F.col("top").alias("up"))
            if done:
                break
        to = hooks.withColumnsRenamed({"node": "root", "up": "top"})
        labels = staged(labels.join(to, "root", "left").select(
            "node", F.coalesce("top", "root").alias("root")), "labels")
        for side in ("a", "b"):
            edges = edges.join(hooks.withColumnsRenamed({"node": side, "up": f"{side}2"}), side)
        edges = staged(edges.filter("a2 <> b2").select(
            F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "edges")
    return labels


# -- the operator -------------------------------------------------------------------------

def _members(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Bucket members with their component."""
    if labels is None:
        return buckets.withColumn("root", F.col("node"))
    return buckets.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (node, key) joined with one row per key (``keys`` is staged).

    Up to ``TRAVEL`` keys are broadcast; more meet the rows in ``SALTS`` parts of a key, always by a
    shuffle: Spark's estimate leaves the copies out, so by its choice the driver would hold them all."""
    if keys.limit(TRAVEL + 1).count() <= TRAVEL:
        return rows.join(F.broadcast(keys), "key")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("node", F.lit(9)), F.lit(SALTS)).cast("int"))
    keys = keys.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(keys.hint("merge"), ["key", "_part"]).drop("_part")


def _open(members: DataFrame) -> DataFrame:
    """Buckets whose members are in more than one component, one of each set of members."""
    h = F.xxhash64("node")
    found = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.min("root").alias("r1"),
        F.max("root").alias("r2"), F.sum(h.cast("decimal(38,0)")).alias("s"),
        F.bit_xor(h).alias("x"), F.max("node").alias("high"))
    found = found.filter("r1 <> r2")
    return found.groupBy("n", "low", "high", "s", "x").agg(
        F.min("key").alias("key"), F.min("r1").alias("r1"))


def _cells(open_: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Members of open buckets dealt to cells (key, kind, i, j) of pairs yet to be checked.

    A bucket of up to ``block`` members is one cell.  Of a larger one the most common component is
    the major one: cells of kind 0 hold a block of the major component and a block of the others,
    cells of kind 1 two blocks of the others, so where one component has all but a few members,
    each of its members is dealt out once.
    """
    rows = _of_keys(members, open_.select("key"))
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"))
    small = F.col("n") <= block
    sizes = staged(sizes.select(
        "key", F.when(~small, F.col("m")["root"]).alias("major"),
        F.when(small, 0).otherwise(F.ceil(F.col("m")["n"] / block)).cast("int").alias("qa"),
        F.when(small, 1).otherwise(F.ceil((F.col("n") - F.col("m")["n"]) / block)).cast("int")
        .alias("qb")), "open")
    rows = _of_keys(rows, sizes)
    h = F.xxhash64("node", F.lit(7))
    rows = rows.withColumn("first", F.coalesce(F.col("root") == F.col("major"), F.lit(False)))
    rows = rows.withColumn(
        "own", F.pmod(h, F.when(F.col("first"), F.col("qa")).otherwise(F.col("qb"))).cast("int"))

    def cell(kind, i, j):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    def upto(n):
        return F.slice(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1), F.lit(1), F.col(n))

    own, a, b = F.col("own"), upto("qa"), upto("qb")
    cells = F.when(F.col("first"), F.transform(b, lambda d: cell(0, own, d))).otherwise(F.concat(
        F.transform(a, lambda c: cell(0, c, own)),
        F.transform(b, lambda d: cell(1, F.least(own, d), F.greatest(own, d)))))
    return rows.select("key", "node", "root", "first", "own", F.explode(cells).alias("c")).select(
        "key", "node", "root", "first", "own", "c.kind", "c.i", "c.j")


def _block_links(open_: DataFrame, members: DataFrame, sigs: DataFrame, texts: DataFrame,
                 percent: int, block: int = BLOCK) -> DataFrame:
    """Links between different components within open buckets, by pairs of blocks."""
    least = least_matches(percent)
    rows = staged(_cells(open_, members, block), "cells")
    groups = max(1, math.ceil(rows.count() / ROWS_PER_GROUP))  # many small cells a group
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key", "kind", "i", "j"), F.lit(groups)))
    rows = rows.join(sigs.select("node", "sig"), "node").join(texts, "node")

    def check(cell) -> list[tuple[int, int]]:
        sig = np.frombuffer(b"".join(cell["sig"]), np.uint16).reshape(len(cell), -1)
        texts, sets = cell["text"].tolist(), {}

        def full(i):
            if i not in sets:
                sets[i] = shingle_sets([texts[i]])[0]
            return sets[i]

        ids, root = cell["node"].to_numpy(), cell["root"].to_numpy()
        kind, i, j = (cell[c].iloc[0] for c in ("kind", "i", "j"))
        side = cell["own" if kind else "first"].to_numpy()  # pairs have different sides
        pairs, score = [], []
        for a in range(len(cell)):
            b = np.flatnonzero(root[a + 1:] != root[a]) + a + 1
            if not kind or i != j:
                b = b[side[b] != side[a]]
            if len(b):
                b = b[survivors(np.broadcast_to(sig[a], (len(b), sig.shape[1])), sig[b], least)]
                pairs += [(a, int(x)) for x in b]
                score += (sig[b] == sig[a]).sum(axis=1).tolist()
        up = {r: r for r in root.tolist()}

        def find(r):
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        out = []
        for k in np.argsort(-np.array(score), kind="stable").tolist():
            a, b = pairs[k]
            x, y = find(root[a]), find(root[b])
            if x != y and linked(full(a), full(b), percent):
                up[x] = y
                out.append((ids[a], ids[b]))
        return out

    def run(pdf):
        import pandas as pd
        found = [x for _, cell in pdf.sort_values("node").groupby(["key", "kind", "i", "j"])
                 for x in check(cell)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return staged(rows.groupBy("group").applyInPandas(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, stars: int = STARS,
                    block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept - one row per row of ``docs``."""
    with Stages() as scratch:
        out = _near_duplicates(docs, percent, stars, block)
        scratch.release(out)    # what the result still reads stays
    return out


def _near_duplicates(docs: DataFrame, percent: int, stars: int, block: int) -> DataFrame:
    every = staged(signatures(docs), "signatures")
    some = every.filter("n_shingles > 0 and doc_id is not null")
    plain = some.groupBy("doc_id").count().filter("count > 1").isEmpty()
    # a node is a class of equal sets: rows of one doc_id may be of several
    classes = staged(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")).withColumn(
        "node", F.monotonically_increasing_id()), "classes")
    owners = staged(some.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"])
                    .select("doc_id", "node").distinct(), "owners")
    heads = some.join(classes.withColumnRenamed("rep", "doc_id"), ["k1", "k2", "doc_id"])
    found = heads.select("node", F.explode("bands").alias("key"))
    shared = staged(found.groupBy("key").agg(F.min("node").alias("r1"), F.max("node").alias("r2"))
                    .filter("r1 <> r2").select("key"), "shared")
    buckets = staged(_of_keys(found, shared).distinct(), "buckets")
    used = staged(buckets.select("node").distinct(), "used")
    sigs = heads.select("node", "sig").join(used, "node", "left_semi")
    sigs = staged(sigs if plain else sigs.dropDuplicates(["node"]), "sigs")
    texts = staged(texts_of(docs, classes.join(used, "node", "left_semi"), plain), "texts")
    # the texts of one doc_id are linked
    first = owners.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    links = staged(owners.join(first.filter("a <> b"), "doc_id").filter("a <> node").select(
        "a", F.col("node").alias("b")), "links")
    tested = None
    labels = components(links)
    for _ in range(stars):
        members = staged(_members(buckets, labels), "members")
        open_ = staged(_open(members), "open")
        if open_.isEmpty():
            break
        # a member of another component than the hub's, with the hub
        rows = _of_keys(members, open_.select("key", "r1"))
        hubs = staged(rows.filter("root = r1").groupBy("key").agg(F.min("node").alias("hub")), "hubs")
        pairs = _of_keys(rows.filter("root <> r1"), hubs).select(
            F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "stars")
        tested = pairs if tested is None else tested.union(pairs)
        links = links.union(verify(pairs, sigs, texts, percent))
        labels = components(links)
    members = staged(_members(buckets, labels), "members")
    open_ = staged(_open(members), "open")
    if not open_.isEmpty():
        links = links.union(_block_links(open_, members, sigs, texts, percent, block))
        labels = components(links)
    rooted = staged(owners.join(labels, "node", "left").select(
        "doc_id", F.coalesce("root", "node").alias("root")), "rooted")
    low = rooted.groupBy("root").agg(F.min("doc_id").alias("low"))
    rooted = rooted.join(low, "root").groupBy("doc_id").agg(F.min("low").alias("low"))
    out = every.select("doc_id", "n_shingles").join(rooted, "doc_id", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce(
        "low", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
                      .alias("kept"))


def keep_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` (all columns) of each group of near-duplicates; repeats of a doc_id go."""
    with Stages() as scratch:
        found = staged(near_duplicates(docs, percent), "groups")
        scratch.release(found)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = found.filter("kept and doc_id is not null").groupBy("doc_id").count() \
        .filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    repeated = docs.join(twice, "doc_id", "left_semi").select(*docs.columns)
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(
        repeated.dropDuplicates(["doc_id"]))
