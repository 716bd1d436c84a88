"""Batch cosine nearest neighbours over an index, exact (K4, K6, A19, P4 in batch form).

An index holds *classes* of equal vectors with their ``KEEP`` smallest ids, dealt to cells of about
``BLOCK`` classes, and a small table of what its cells can hold at most.  A search takes two steps:

1. every query is scored in one home cell (or a few); its ``top_n``-th distance there is a bound;
2. the query goes to those cells only that can still hold something as near as its bound.

Two indexes differ in what a cell is and how it is bounded:

* ``TokenIndex``, an inverted index: a class is listed under each of its tokens.  A query with bound
  ``theta`` (a cosine) may leave out tokens whose weights' squares sum up to less than theta squared
  (no vector that shares only those can reach it): it leaves out the commonest ones.  A long list
  is cut by angle, and the query skips parts whose weight for the token is too far from its own
  (the angle between two vectors is at least the difference of their angles to the token's axis).
* ``BoxIndex``, for vectors with one dominant component (an album's year): a class is in one cell,
  by the values of its box components.  In coordinates divided by the dominant one, the squared sine
  of the angle is at least ``|x - y|^2 / ((1 + |x|^2) (1 + |y|^2))``; the distance of the query to
  the cell's box, with the other components by their norm alone (Cauchy-Schwarz), bounds it.

A cell scores its queries against its classes in one task with numpy, takes out each query's
excluded ids while it does (sorted id lists travel with the query), and gives ``top_n`` rows a query.
A class of more than ``KEEP`` ids that runs out of them under a query's exclusions is looked up in
the table of all its ids.  Rows of a query are shuffled once per cell that it has to see.  Rows of a
class are shuffled once per token (for the first bound, per token under which some query has its home); a box's class once for the first bound, then once per ``MEET`` queries that see its cell.

Where a token index's bounds leave most pairs in (dense vectors of few tokens), its lists would score a
pair once per shared token: then all queries meet all classes in a grid of blocks instead, each pair once.

Equal queries are searched once (those that differ in a few excluded ids ask for as many rows more), and
a cell's pairs are first scored in single precision, less the cell's mean; only those that a bound of its
error cannot leave out are scored in full.

Both steps rank on ``rank_keys`` of the distance, then id.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANK_DIGITS = 9
KEEP = 64            # ids held by a class in the index
BLOCK = 4096         # classes in a cell
BINS = 64            # parts of a long token list, by angle
SALTS = 16           # parts in which the ids of a class are cut to KEEP
HOME = 1024          # classes that a query meets first in a box index
BOX_CELL = 65_536    # classes in a cell of a box index at most
BOX_CELLS = 64       # such cells at least, where there are BLOCK classes for them
MEET = 32_768        # queries that meet a cell of a box index in one task
MAX_BOXES = 20_000   # boxes that a task holds; coarser boxes beyond
QUERY_CHUNK = 1024   # query rows scored at once
KEY_CHUNK = 2048     # keys densified at once
DENSE = 32_000_000   # numbers of a cell's classes that are held densely, in single precision
FEW = 4              # excluded ids that equal queries may differ in
TILE = 2048          # classes whose products are held at once
SPARE = 32           # classes a query beyond those it needs, before the nearest are cut out
GRID = 131_072       # queries, classes in a cell of the grid
GRID_TASKS = 64      # cells of a grid at least, where there are queries for them
GRID_SHARE = 0.25    # of all pairs: a token index that would score more is left for the grid


def rank_keys(distance: np.ndarray, digits: int = RANK_DIGITS) -> np.ndarray:
    return np.floor(distance * 10.0 ** digits + 0.5)


# ---------------------------------------------------------------- classes of equal vectors

def packed(rows: DataFrame, ident: str, extra=()) -> DataFrame:
    """One row per entity from (ident, key, w): keys (64-bit hashes), ws, norm, and ``extra``
    aggregates."""
    terms = F.array_sort(F.collect_list(F.struct(F.xxhash64("key").alias("k"), F.col("w").alias("w"))))
    f = rows.groupBy(ident).agg(terms.alias("terms"),
                                F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *extra)
    names = [c for c in f.columns if c not in (ident, "terms", "norm")]
    return f.select(ident, F.col("terms.k").alias("keys"), F.col("terms.w").alias("ws"), "norm", *names)


def classes_of(rows: DataFrame, extra=(), tell=()) -> tuple[DataFrame, DataFrame]:
    """(classes, members): ``classes`` is cv (its smallest id), keys, ws, norm, ids (the ``KEEP``
    smallest), n_ids and the ``extra`` columns; ``members`` (cv, cand_id) has all ids of larger ones.
    Columns named in ``tell`` tell vectors apart."""
    f = packed(rows, "cand_id", extra)
    names = [c for c in f.columns if c not in ("cand_id", "keys", "ws", "norm")]
    own = ["keys", "ws", *tell]
    f = f.withColumn("h1", F.xxhash64(*own)).withColumn("h2", F.xxhash64(*own, F.lit(1)))
    part = F.pmod(F.xxhash64("cand_id"), F.lit(SALTS))
    by = Window.partitionBy("h1", "h2", part)
    few = f.withColumn("r", F.row_number().over(by.orderBy("cand_id"))) \
        .withColumn("n", F.count(F.lit(1)).over(by)).where(F.col("r") <= KEEP)
    ids = F.array_sort(F.collect_list("cand_id"))       # SALTS * KEEP at most
    classes = few.groupBy("h1", "h2").agg(
        ids.alias("ids"), F.sum(F.when(F.col("r") == 1, F.col("n"))).alias("n_ids"),
        *[F.any_value(c).alias(c) for c in ["keys", "ws", "norm", *names]])
    classes = stage(classes.select(F.col("ids")[0].alias("cv"), F.slice("ids", 1, KEEP).alias("ids"),
                                   "n_ids", "keys", "ws", "norm", *names, "h1", "h2"), name="classes")
    # read by searches that run out of a class's ids only
    large = classes.where(F.col("n_ids") > KEEP).select("cv", "h1", "h2")
    members = f.select("cand_id", "h1", "h2").join(large, ["h1", "h2"]).select("cv", "cand_id")
    return classes.drop("h1", "h2"), members


# ---------------------------------------------------------------- indexes

@dataclass
class TokenIndex:
    cells: DataFrame      # cell, cv, keys, ws, norm, ids, n_ids, ok
    parts: DataFrame      # t, sub, lo, hi (weights in it), salts, df
    members: DataFrame
    classes: DataFrame    # for the ids that share no token with a query


def token_index(candidates: DataFrame, block: int = BLOCK) -> TokenIndex:
    """Index of (cand_id, key, w[, ok]); weights are not negative.  A search can ask for ``ok``."""
    if "ok" not in candidates.columns:
        candidates = candidates.withColumn("ok", F.lit(True))
    candidates = candidates.select(F.col("cand_id").cast("long").alias("cand_id"), "key", "w", "ok")
    classes, members = classes_of(candidates, [F.any_value("ok").alias("ok")], ["ok"])
    idx = classes.where("norm > 0").select("*", F.explode(F.arrays_zip("keys", "ws")).alias("e"))
    idx = idx.select(*classes.columns, F.col("e.keys").alias("t"),
                     F.least(F.col("e.ws") / F.col("norm"), F.lit(1.0)).alias("tw")).where("tw > 0")
    idx = idx.withColumn("bin", F.least(F.floor(F.acos("tw") * (2 * BINS / math.pi)),
                                        F.lit(BINS - 1)).cast("int"))
    stats = stage(idx.groupBy("t", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("tw").alias("lo"),
                                              F.max("tw").alias("hi")), name="bins")
    df = stats.groupBy("t").agg(F.sum("n").alias("df"))
    route = stats.join(df, "t").withColumn(
        "sub", F.when(F.col("df") <= block, F.lit(-1)).otherwise(F.col("bin")))
    parts = stage(route.groupBy("t", "sub").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max("df").alias("df")).withColumn("salts", F.ceil(F.col("n") / block).cast("int")),
        name="parts")
    route = route.select("t", "bin", "sub").join(parts.select("t", "sub", "salts"), ["t", "sub"])
    cells = idx.join(route, ["t", "bin"]).withColumn(
        "cell", F.xxhash64("t", "sub", F.pmod(F.xxhash64("cv"), F.col("salts")).cast("int")))
    # a class's rows under its tokens are made from it when they are shuffled
    return TokenIndex(cells.select("cell", *classes.columns), parts, members, classes)


@dataclass
class BoxIndex:
    cells: DataFrame      # cell, cv, keys, ws, norm, ids, n_ids
    homes: DataFrame      # the same classes in cells of about BLOCK, for first bounds
    members: DataFrame
    boxes: pd.DataFrame   # numbers of cells (salts) and homes, low and high ends per coordinate, n
    dominant: str
    box: list


def _coordinates(dominant: str, box: list) -> list:
    """Aggregates of (key, w) rows: the box components, the dominant one, and the others' norm."""
    named = [dominant, *box]
    parts = [F.coalesce(F.max(F.when(F.col("key") == k, F.col("w"))), F.lit(0.0)).alias(f"v{i}")
             for i, k in enumerate(named)]
    rest = F.when(~F.col("key").isin(named), F.col("w") * F.col("w"))
    return [*parts, F.sqrt(F.coalesce(F.sum(rest), F.lit(0.0))).alias("rho")]


def _scaled(n_box: int) -> list:
    """The coordinates divided by the dominant component (0 where it is not positive)."""
    cols = [f"v{i + 1}" for i in range(n_box)] + ["rho"]
    return [F.when(F.col("v0") > 0, F.col(c) / F.col("v0")).otherwise(F.lit(0.0)).alias(f"x{i}")
            for i, c in enumerate(cols)]


def box_index(candidates: DataFrame, dominant: str, box: list, coarse: list = (),
              block: int | None = None) -> BoxIndex:
    """Index of (cand_id, key, w) by the components ``box``; where these have more than
    ``MAX_BOXES`` combinations, by the first of the ``coarse`` lists of components that has not.

    A query is shuffled once per cell that it sees, so cells grow with the table, up to ``BOX_CELL``
    classes (``block``: a size of the caller's)."""
    candidates = candidates.select(F.col("cand_id").cast("long").alias("cand_id"), "key", "w")
    classes, members = classes_of(candidates, _coordinates(dominant, box))
    names = ["cv", "keys", "ws", "norm", "ids", "n_ids"]
    rows = classes.select(*names, (F.col("v0") > 0).alias("bounded"), *_scaled(len(box)),
                          *[f"v{i + 1}" for i in range(len(box))])
    coords = [f"x{i}" for i in range(len(box) + 1)]
    for chosen in [box, *coarse, []]:
        by = ["bounded", *[f"v{box.index(c) + 1}" for c in chosen]]
        sums = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), *[F.min(x).alias(f"{x}_lo") for x in coords],
            *[F.max(x).alias(f"{x}_hi") for x in coords])
        found = sums.limit(MAX_BOXES + 1).toPandas()      # by its bound
        if len(found) <= MAX_BOXES:
            break
    # a cell's key is the hash of its box's values and salt, as the tasks compute it
    spark = candidates.sparkSession
    if block is None:
        block = min(max(int(found["n"].sum()) // BOX_CELLS, BLOCK), BOX_CELL)
    found["salts"] = -(-found["n"] // block)
    found["homes"] = -(-found["n"] // min(block, BLOCK))
    found["box_id"] = np.arange(len(found))
    dealt = ["box_id", "salts", "homes"]
    fields = rows.select(*by).schema.fields + [T.StructField(c, T.LongType()) for c in dealt]
    table = spark.createDataFrame(found[[*by, *dealt]], T.StructType(fields))
    cells, homes = (rows.join(table, by).select(
        (F.col("box_id") * 1_000_000 + F.pmod(F.xxhash64("cv"), F.col(n))).alias("cell"), *names)
        for n in ("salts", "homes"))
    return BoxIndex(cells, homes, members, found, dominant, box)


# ---------------------------------------------------------------- one cell

_HITS = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("cv", T.LongType()),
    T.StructField("cand_id", T.LongType()),         # null: the class ran out of ids
    T.StructField("rk", T.DoubleType()), T.StructField("distance", T.DoubleType())])


def _no_hits() -> pd.DataFrame:
    return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "cv": pd.Series(dtype="int64"),
                         "cand_id": pd.Series(dtype="Int64"), "rk": pd.Series(dtype="float64"),
                         "distance": pd.Series(dtype="float64")})


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of an array column one after another, and their rows."""
    size = np.array([len(x) for x in column], np.int64)
    flat = np.concatenate([np.asarray(x) for x in column]) if size.sum() else np.zeros(0, np.int64)
    return flat, np.repeat(np.arange(len(size)), size)


def _dots(q, c, nq: int, nc: int) -> np.ndarray:
    """Dot products of sparse rows (key code, row, weight), ``KEY_CHUNK`` codes at a time."""
    (qk, qr, qw), (ck, cr, cw) = q, c
    out = np.zeros((nq, nc))
    shared = np.intersect1d(qk, ck)
    for k0 in range(0, len(shared), KEY_CHUNK):
        keys = shared[k0:k0 + KEY_CHUNK]
        dense = []
        for k, r, w, n in ((qk, qr, qw, nq), (ck, cr, cw, nc)):
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            own = keys[at] == k
            m = np.zeros((n, len(keys)))
            m[r[own], at[own]] = w[own]
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _classes(cdf: pd.DataFrame) -> dict:
    """A cell's classes as flat arrays; the weights over the norm (a norm of 0 gives 0)."""
    cdf = cdf.drop_duplicates("cv")
    keys, rows = _flat(cdf["keys"])
    ids, of = _flat(cdf["ids"])
    held = np.bincount(of, minlength=len(cdf))
    return {"n": len(cdf), "keys": keys, "rows": rows, "ws": _unit(cdf, rows), "cv": cdf["cv"].to_numpy(),
            "ids": ids, "held": held, "first": np.cumsum(held) - held,
            "cut": cdf["n_ids"].to_numpy() > held}


def _unit(df: pd.DataFrame, rows: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        w = _flat(df["ws"])[0].astype(np.float64) / df["norm"].to_numpy(np.float64)[rows]
    return np.where(np.isfinite(w), w, 0.0)


def _queries(qdf: pd.DataFrame) -> list[dict]:
    """``QUERY_CHUNK`` queries at a time as flat arrays."""
    out = []
    for q0 in range(0, len(qdf), QUERY_CHUNK):
        part = qdf.iloc[q0:q0 + QUERY_CHUNK]
        keys, rows = _flat(part["keys"])
        ex, ex_of = _flat(part["excluded"])
        out.append({"n": len(part), "keys": keys, "rows": rows, "ws": _unit(part, rows),
                    "top": part["top_n"].to_numpy(np.int64), "ex": ex, "ex_of": ex_of,
                    "fkeys": part["fkeys"].to_numpy(), "ids": part["query_id"].to_numpy(),
                    "worst": part["worst"].to_numpy(np.float64).copy()})
    return out


def _hold_densely(blocks: list[dict]) -> tuple | None:
    """(keys, centre) of a cell's classes, which get a dense form in single precision; None where
    that would be too large.

    Vectors are held less the cell's mean, so that single precision tells those of one box apart: with
    u' = u - m and v' = v - m, u.v is u'.v' + m.v + m.u'.  The last column holds m.v - (1 + |m|^2) / 2."""
    keys = np.unique(np.concatenate([c["keys"] for c in blocks]))
    n = sum(c["n"] for c in blocks)
    if n * (len(keys) + 1) > DENSE:
        return None
    centre = np.zeros(len(keys))
    for c in blocks:
        c["codes"] = np.searchsorted(keys, c["keys"])
        c["count"] = np.bincount(c["rows"], minlength=c["n"])
        centre += np.bincount(c["codes"], c["ws"], minlength=len(keys)) / n
    for c in blocks:
        full = np.zeros((c["n"], len(keys)))
        full[c["rows"], c["codes"]] = c["ws"]
        plus = full @ centre - (1.0 + centre @ centre) / 2.0
        full -= centre
        c["most"] = math.sqrt(np.einsum("ij,ij->i", full, full).max()), np.abs(plus).max()
        c["dense"] = np.concatenate([full, plus[:, None]], axis=1).astype(np.float32)
    return keys, centre


def _centred(q: dict, keys: np.ndarray, centre: np.ndarray) -> None:
    """The same for queries: ``full`` on the cell's keys, its dense form, and what is left of 1 - u.v."""
    at = np.minimum(np.searchsorted(keys, q["keys"]), max(len(keys) - 1, 0))
    own = keys[at] == q["keys"] if len(keys) else np.zeros(len(at), bool)
    q["full"] = np.zeros((q["n"], len(keys)))
    q["full"][q["rows"][own], at[own]] = q["ws"][own]
    less = q["full"] - centre
    q["size"] = np.sqrt(np.einsum("ij,ij->i", less, less))
    q["left"] = (1.0 - centre @ centre) / 2.0 - less @ centre
    q["dense"] = np.concatenate([less, np.ones((q["n"], 1))], axis=1).astype(np.float32)


def _screened(q: dict, c: dict, limit: np.ndarray, need: np.ndarray, digits: int, space: dict) -> tuple:
    """(rows, classes, dots) of the pairs that can matter: single precision leaves out those that cannot,
    by a bound of its error, the others' products are taken in full."""
    nq, nc = q["n"], c["n"]
    eps, (most, plus) = 2.0 ** -23, c["most"]
    low = q["left"] - limit
    slack = eps * ((c["dense"].shape[1] + 8) * q["size"] * most + 4.0 * plus) + 1e-15
    bar = (low - slack - eps * np.abs(low)).astype(np.float32)[:, None]

    def products(a: int, z: int) -> tuple:      # in the same space again and again
        if "s" not in space or space["s"].size < nq * (z - a):
            space["s"], space["near"] = np.empty(nq * (z - a), np.float32), np.empty(nq * (z - a), bool)
        s, near = (space[x][:nq * (z - a)].reshape(nq, z - a) for x in ("s", "near"))
        np.matmul(q["dense"], c["dense"][a:z].T, out=s)
        return s, np.greater_equal(s, bar, out=near)

    found, n = [], 0
    for a in range(0, nc, TILE):
        z = min(a + TILE, nc)
        at = _true(products(a, z)[1])
        found.append((at // (z - a), at % (z - a) + a))
        n += len(at)
        if n > SPARE * nq:
            break
    if n > SPARE * nq:
        s, near = products(0, nc)
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > need + SPARE)
        for k in np.unique(need[many]):
            rows = many[need[many] == k]
            kth = np.partition(s[rows], nc - k, axis=1)[:, nc - k]
            near[rows] &= s[rows] >= (kth - 2.0 * slack[rows] - 2.0 * eps * np.abs(kth) - 2.0 * 10.0 ** -digits).astype(np.float32)[:, None]
        at = _true(near)
        found = [(at // nc, at % nc)]
    r, k = (np.concatenate(x) for x in zip(*found, strict=True))
    size = c["count"][k]
    pair = np.repeat(np.arange(len(r)), size)
    term = (np.cumsum(c["count"]) - c["count"])[k[pair]] + np.arange(len(pair)) - np.repeat(
        np.cumsum(size) - size, size)
    dots = np.bincount(pair, q["full"][r[pair], c["codes"][term]] * c["ws"][term], minlength=len(r))
    return r, k, dots


def _true(near: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of an array with few true values, eight at a time."""
    flat = near.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    word, bit = np.nonzero(flat.reshape(-1, 8)[some])
    return some[word] * 8 + bit


def _pairs(q: dict, c: dict, limit: np.ndarray, need: np.ndarray, digits: int) -> tuple:
    """The same from all products in full."""
    nq, nc = q["n"], c["n"]
    dots = _dots((q["keys"], q["rows"], q["ws"]), (c["keys"], c["rows"], c["ws"]), nq, nc)
    for i in np.flatnonzero([len(x) > 0 for x in q["fkeys"]]):
        allowed = np.zeros(nc, bool)
        allowed[c["rows"][np.isin(c["keys"], q["fkeys"][i])]] = True
        dots[i, ~allowed] = -np.inf
    near = dots >= np.maximum(1.0 - limit - 1e-15, -4.0)[:, None]
    many = np.flatnonzero(np.count_nonzero(near, axis=1) > need)
    for k in np.unique(need[many]):
        rows = many[need[many] == k]
        kth = np.partition(dots[rows], nc - k, axis=1)[:, nc - k]
        near[rows] &= dots[rows] >= kth[:, None] - 2.0 * 10.0 ** -digits
    at = np.flatnonzero(near)
    return at // nc, at % nc, dots.ravel()[at]


def _best(q: dict, c: dict, digits: int, shared: bool = False, space: dict | None = None) -> tuple | None:
    """(rows, ids, rank keys, distances, classes) of each query's ``top_n`` nearest ids among the
    classes, nearest first, and (rows, rank keys, distances, classes) of classes that ran out of ids.
    ``shared``: only classes that share a key with the query (weights are not negative)."""
    nq, nc, top = q["n"], c["n"], q["top"]
    # classes that can matter: within the bound, and among the nearest top_n + excluded ones
    limit = (q["worst"] + 0.5) / 10.0 ** digits + 1e-14
    need = np.minimum(top + np.bincount(q["ex_of"], minlength=nq), nc)
    r, k, dots = _pairs(q, c, limit, need, digits) if space is None else _screened(
        q, c, limit, need, digits, space)
    least = np.nextafter(0.0, 1.0) if shared else -4.0
    own = dots >= np.maximum(1.0 - limit - 1e-15, least)[r]
    r, k, dots = r[own], k[own], dots[own]
    if not len(r):
        return None
    order = np.lexsort((-dots, r))
    last = order[_place(r[order]) == need[r[order]] - 1]      # the last that a query needs
    least = np.full(nq, -np.inf)
    least[r[last]] = dots[last] - 2.0 * 10.0 ** -digits
    own = dots >= least[r]
    r, k, dots = r[own], k[own], dots[own]
    dist = np.maximum(1.0 - dots, 0.0)
    rk = rank_keys(dist, digits)
    # the classes' ids, without the excluded ones
    held = c["held"][k]
    pair = np.repeat(np.arange(len(r)), held)
    one = c["ids"][c["first"][k[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(held) - held, held)]
    if len(q["ex"]):
        known, code = np.unique(np.concatenate([one, q["ex"]]), return_inverse=True)
        gone = np.isin(code[:len(one)] * nq + r[pair], code[len(one):] * nq + q["ex_of"])
        pair, one = pair[~gone], one[~gone]
    left = np.bincount(pair, minlength=len(r))
    short = np.flatnonzero(c["cut"][k] & (left < top[r]))
    order = np.lexsort((one, rk[pair], r[pair]))
    pair, one = pair[order], one[order]
    keep = _place(r[pair]) < top[r[pair]]
    pair, one = pair[keep], one[keep]
    cv = c["cv"][k]
    return ((r[pair], one, rk[pair], dist[pair], cv[pair]), (r[short], rk[short], dist[short], cv[short]))


def _place(row: np.ndarray) -> np.ndarray:
    """The place of each element among the equal ones of a sorted array."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def _score(qdf: pd.DataFrame, cdf: pd.DataFrame, digits: int, shared: bool = False) -> pd.DataFrame:
    """A cell: each query's ``top_n`` nearest ids among the classes, not excluded, with one of its
    ``fkeys`` where it has such, and no farther than its bound ``worst`` (a rank key).

    ``BLOCK`` classes are scored at once; what they hold lowers the bound for those that follow.
    Rows with no ``cand_id`` name classes whose listed ids were not enough.
    """
    if qdf.empty or cdf.empty:
        return _no_hits()
    cdf = cdf.drop_duplicates("cv")
    parts = -(-len(cdf) // (2 * BLOCK))
    step = -(-len(cdf) // parts)
    blocks = [_classes(cdf.iloc[c0:c0 + step]) for c0 in range(0, len(cdf), step)]
    held, space, outs = _hold_densely(blocks), {}, []
    for q in _queries(qdf):
        got = None
        screen = held is not None and not any(len(x) for x in q["fkeys"])
        if screen:
            _centred(q, *held)
        for c in blocks:
            hits = _best(q, c, digits, shared, space if screen else None)
            if hits is None:
                continue
            (rows, *found), (srows, srk, sdist, scv) = hits
            if len(srows):
                outs.append(pd.DataFrame({"query_id": q["ids"][srows], "cv": scv, "cand_id": pd.array(
                    [pd.NA] * len(srows), dtype="Int64"), "rk": srk, "distance": sdist}))
            if got is not None:
                rows, *found = (np.concatenate(x) for x in zip(got, (rows, *found), strict=True))
                order = np.lexsort((found[0], found[1], rows))
                order = order[_place(rows[order]) < q["top"][rows[order]]]
                rows, *found = (x[order] for x in (rows, *found))
            got = (rows, *found)
            last = np.flatnonzero(_place(rows) == q["top"][rows] - 1)
            q["worst"][rows[last]] = np.minimum(q["worst"][rows[last]], found[1][last])
        q.pop("full", None), q.pop("dense", None)       # of one chunk at a time
        if got is not None:
            rows, one, rk, dist, cv = got
            outs.append(pd.DataFrame({"query_id": q["ids"][rows], "cv": cv,
                                      "cand_id": pd.array(one, dtype="Int64"), "rk": rk, "distance": dist}))
    return pd.concat(outs, ignore_index=True) if outs else _no_hits()


def _met(asked: DataFrame, cells: DataFrame, digits: int, shared: bool = False) -> DataFrame:
    """Hits of the queries in their cells; ``asked`` has a row per query and cell."""
    return (asked.groupBy("cell").cogroup(cells.groupBy("cell"))
            .applyInPandas(lambda q, c: _score(q, c, digits, shared), schema=_HITS))


def _grid(asked: DataFrame, classes: DataFrame, n_queries: int, n_classes: int, digits: int) -> DataFrame:
    """Hits of all queries among all classes: a cell is a block of queries beside a block of classes, so
    a row is shuffled once per block of the other side."""
    across = -(-n_classes // GRID)
    down = max(-(-n_queries // GRID), min(-(-n_queries // QUERY_CHUNK), -(-GRID_TASKS // across)))

    def dealt(key: str, own: int, other: int) -> tuple:
        return (F.pmod(F.xxhash64(key), F.lit(own)).alias("_own"),
                F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("_other"))

    q = asked.select("*", *dealt("query_id", down, across)).withColumn(
        "cell", F.col("_own") * across + F.col("_other")).drop("_own", "_other")
    c = classes.select("*", *dealt("cv", across, down)).withColumn(
        "cell", F.col("_other") * across + F.col("_own")).drop("_own", "_other")
    return _met(q, c, digits, shared=True)     # what shares no token is the tail's


# ---------------------------------------------------------------- routing

def _token_homes(index: TokenIndex, q: DataFrame) -> DataFrame:
    """(query_id, cell): the part of the query's heaviest listed token that is nearest to its weight."""
    met = _tokens(q).join(index.parts, "t")
    gap = F.greatest(F.col("lo") - F.col("tw"), F.col("tw") - F.col("hi"), F.lit(0.0))
    best = F.min(F.struct((-F.col("tw")).alias("a"), gap.alias("gap"), "t", "sub", "salts")).alias("b")
    home = met.groupBy("query_id").agg(best).select("query_id", "b.*")
    return home.select("query_id", F.xxhash64("t", "sub", F.pmod(
        F.xxhash64("query_id"), F.col("salts")).cast("int")).alias("cell"))


def _tokens(q: DataFrame) -> DataFrame:
    rows = q.where("norm > 0").select("query_id", "norm", F.explode(F.arrays_zip("keys", "ws")).alias("e"))
    return rows.select("query_id", F.col("e.keys").alias("t"), (F.col("e.ws") / F.col("norm")).alias("tw"))


def _token_parts(index: TokenIndex, q: DataFrame, digits: int) -> DataFrame:
    """The parts of token lists (``n`` rows) that can hold a vector within the query's bound ``worst``."""
    tokens = _tokens(q).join(index.parts.groupBy("t").agg(F.max("df").alias("df")), "t")
    theta = F.least(F.lit(1.0) - (F.col("worst") + 0.5) / 10.0 ** digits - 1e-12, F.lit(1.0))
    tokens = tokens.join(q.select("query_id", "worst", theta.alias("theta")), "query_id")
    # commonest first: those whose squares stay below theta's square can be left out together
    order = Window.partitionBy("query_id").orderBy(F.desc("df"), "t")
    spent = F.sum(F.col("tw") * F.col("tw")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    tokens = tokens.withColumn("spent", spent).where(
        (F.col("theta") <= 0) | (F.col("spent") >= F.col("theta") * F.col("theta") - 1e-12))
    met = tokens.join(index.parts.drop("df"), "t")
    own = F.acos(F.least("tw", F.lit(1.0)))
    gap = F.greatest(F.acos("hi") - own, own - F.acos("lo"), F.lit(0.0))
    return met.where((F.col("theta") <= 0) | (gap <= F.acos(F.greatest("theta", F.lit(0.0))) + 1e-7))


def _token_visits(index: TokenIndex, q: DataFrame, digits: int) -> DataFrame:
    """(query_id, worst, cell): cells that can hold a vector within the query's bound ``worst``."""
    return _token_parts(index, q, digits).select("query_id", "worst", "t", "sub", F.explode(F.sequence(
        F.lit(0), F.col("salts") - 1)).alias("salt")).select(
        "query_id", "worst", F.xxhash64("t", "sub", "salt").alias("cell"))


def _box_bounds(boxes: pd.DataFrame, x: np.ndarray, bounded: np.ndarray) -> np.ndarray:
    """(queries, boxes): no vector of the box is nearer."""
    d = x.shape[1]
    lo = boxes[[f"x{i}_lo" for i in range(d)]].to_numpy(np.float64)
    hi = boxes[[f"x{i}_hi" for i in range(d)]].to_numpy(np.float64)
    gap2 = np.zeros((len(x), len(boxes)))
    for i in range(d):
        g = np.maximum(np.maximum(lo[None, :, i] - x[:, i, None], x[:, i, None] - hi[None, :, i]), 0.0)
        gap2 += g * g
    most = 1.0 + np.maximum(lo * lo, hi * hi).sum(axis=1)
    out = gap2 / ((1.0 + (x * x).sum(axis=1))[:, None] * most[None, :]) / 2.0
    out[~bounded, :] = 0.0
    out[:, ~boxes["bounded"].to_numpy(bool)] = 0.0
    return out


def _box_route(boxes: pd.DataFrame, digits: int, home: bool):
    """Per query its home cells (one of each of its nearest boxes), or all cells that can hold something
    within ``worst``."""
    size, salts, homes = (boxes[c].to_numpy() for c in ("n", "salts", "homes"))

    def run(frames):
        for f in frames:
            for a in range(0, len(f), 256):
                part = f.iloc[a:a + 256]
                x = np.array(part["x"].tolist(), np.float64).reshape(len(part), -1)
                low = _box_bounds(boxes, x, part["bounded"].to_numpy(bool))
                order = np.argsort(low, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                if home:
                    take = np.zeros(low.shape, bool)
                    np.put_along_axis(take, order, before < HOME, axis=1)
                else:
                    limit = (part["worst"].to_numpy(np.float64) + 0.5) / 10.0 ** digits + 1e-13
                    take = low <= limit[:, None]
                r, b = np.nonzero(take)
                if home:
                    own = part[["query_id"]].iloc[r]
                    mixed = own["query_id"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    salt = (mixed >> np.uint64(33)).astype(np.int64) % homes[b]
                    yield own.assign(cell=b.astype(np.int64) * 1_000_000 + salt)
                    continue
                n = salts[b]
                r, b = np.repeat(r, n), np.repeat(b, n)
                salt = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                yield part[["query_id", "worst"]].iloc[r].assign(cell=b.astype(np.int64) * 1_000_000 + salt)

    return run


def _shared_out(visits: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The visits of a cell dealt to parts of about ``MEET`` queries, each with the cell's classes; cells
    that no query visits are left out."""
    n = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("long").alias("_parts"))
    n = stage(n, name="parts")

    def part(number):
        return (F.col("cell") * 100_000 + number).alias("cell")

    v = visits.join(n, "cell").select(*[c for c in visits.columns if c != "cell"], part(
        F.pmod(F.xxhash64("query_id"), F.col("_parts"))))
    c = cells.join(n, "cell").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    return v, c.select(part(F.col("_part")), *[x for x in cells.columns if x != "cell"])


# ---------------------------------------------------------------- the search

def search(index: TokenIndex | BoxIndex, queries: DataFrame, *, exclusions: DataFrame | None = None,
           filters: DataFrame | None = None, only_ok: bool = False,
           digits: int = RANK_DIGITS) -> DataFrame:
    """Exact cosine top-n for a table of query vectors.

    queries     (query_id, key string, w double, top_n int)
    exclusions  (query_id, cand_id) that a query does not take
    filters     (query_id, key): a query that has some takes only candidates with such a key
    only_ok     take only candidates that were indexed with ``ok``
    returns     (query_id, cand_id, distance, rank) with rank <= top_n
    """
    boxed = isinstance(index, BoxIndex)
    if filters is not None and not boxed:
        raise ValueError("filters need a box index")
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"),
                          F.col("key").cast("string").alias("key"),
                          F.col("w").cast("double").alias("w"), F.col("top_n").cast("int").alias("top_n"))
    extra = [F.max("top_n").alias("top_n")]
    if boxed:
        extra += _coordinates(index.dominant, index.box)
    q = packed(rows, "query_id", extra)
    if boxed:
        n_box = len(index.box)
        q = q.select("query_id", "keys", "ws", "norm", "top_n", (F.col("v0") > 0).alias("bounded"),
                     F.array(*_scaled(n_box)).alias("x"))
    none = F.array().cast("array<long>")
    if exclusions is not None:
        ex = exclusions.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(
            F.array_sort(F.collect_set(F.col("cand_id").cast("long"))).alias("excluded"))
        q = q.join(ex, "query_id", "left").withColumn("excluded", F.coalesce("excluded", none))
    else:
        q = q.withColumn("excluded", none)
    if filters is not None:
        own = filters.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(
            F.collect_set(F.xxhash64(F.col("key").cast("string"))).alias("fkeys"))
        q = q.join(own, "query_id", "left").withColumn("fkeys", F.coalesce("fkeys", none))
    else:
        q = q.withColumn("fkeys", none)
    q = stage(_same(q), name="queries")
    every, q = q.select("query_id", "top_n", "excluded", *_SAME), _one_of_each(q)
    q = stage(q, name="asked")
    cells = index.cells.where("ok") if only_ok else index.cells
    fields = ["query_id", "keys", "ws", "norm", "top_n", "excluded", "fkeys", "worst"]
    unbound = F.lit(float(10 ** digits) * 4)            # a cosine distance is 2 at most
    if boxed:
        homes = q.select("query_id", "bounded", "x", unbound.alias("worst")).mapInPandas(
            _box_route(index.boxes, digits, True), "query_id long, cell long")
    else:
        homes = _token_homes(index, q)
    homes = stage(homes, name="homes")
    lived = (index.homes if boxed else cells).join(homes.select("cell").distinct(), "cell", "left_semi")
    first = stage(_met(q.join(homes, "query_id").select(*fields[:-1], unbound.alias("worst"), "cell"),
                       lived, digits).where("cand_id is not null").select("query_id", "rk", "cand_id"),
                  name="near")
    # the top_n-th id found so far bounds what can still enter
    by = Window.partitionBy("query_id").orderBy("rk", "cand_id")
    bound = first.distinct().withColumn("r", F.row_number().over(by)).join(
        q.select("query_id", "top_n"), "query_id").where("r = top_n").select(
        "query_id", F.col("rk").alias("worst"))
    open_ = q.join(bound, "query_id", "left").withColumn("worst", F.coalesce("worst", unbound))
    if boxed:
        visits = open_.select("query_id", "bounded", "x", "worst").mapInPandas(
            _box_route(index.boxes, digits, False), "query_id long, cell long, worst double")
        visits, cells = _shared_out(stage(visits, name="visits"), cells)
    else:
        open_ = stage(open_, name="open")
        n_queries, n_classes = q.count(), index.classes.count()
        pairs = _token_parts(index, open_, digits).agg(F.sum("n")).first()[0] or 0      # one number
        visits = None if pairs > GRID_SHARE * n_queries * n_classes else _token_visits(index, open_, digits)
    if visits is not None:
        hits = _met(visits.join(q, "query_id").select(*fields, "cell"), cells, digits)
    else:       # no bound bites: every pair once, instead of once per shared token
        pool = index.classes.where("ok") if only_ok else index.classes
        hits = _grid(open_.select(*fields), pool.drop("ok"), n_queries, n_classes, digits)
    hits = stage(hits, name="hits")
    asked = q.select("query_id", "top_n")
    found = hits.where("cand_id is not null").drop("cv")
    out_of_ids = hits.where("cand_id is null").drop("cand_id").distinct()
    if not out_of_ids.isEmpty():
        more = out_of_ids.join(index.members, "cv")
        if exclusions is not None:
            more = more.join(q.select("query_id", F.explode("excluded").alias("cand_id")),
                             ["query_id", "cand_id"], "left_anti")
        found = found.unionByName(more.select(found.columns))
    best = _ranked(found, asked)
    if boxed:
        return _for_all(best, every, q)
    # queries with too few vectors that share a token: all others are at distance 1; a query with
    # a bound has enough
    free = q.join(bound, "query_id", "left_anti").select("query_id", "top_n", "excluded")
    n = found.select("query_id", "cand_id").join(free.select("query_id"), "query_id", "left_semi") \
        .distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = free.join(n, "query_id", "left").select(
        "query_id", "excluded", "top_n", F.coalesce("n", F.lit(0)).alias("n")).where("n < top_n")
    if short.isEmpty():
        return _for_all(best, every, q)
    best = stage(best, name="best")
    tail = _at_distance_one(index, stage(short, name="short"), best, only_ok, digits)
    return _for_all(_ranked(best.drop("rank").unionByName(tail), asked), every, q)


_SAME = ["_h1", "_h2"]


def _same(q: DataFrame) -> DataFrame:
    """Equal ``_SAME`` for equal queries: those that exclude up to ``FEW`` ids ask for so many rows more
    instead (``_asks``) and take theirs out afterwards."""
    few = F.size("excluded") <= FEW
    own = ["keys", "ws", F.when(few, F.array().cast("array<long>")).otherwise(F.col("excluded")), "fkeys",
           F.col("top_n") + F.when(few, F.size("excluded")).otherwise(F.lit(0))]
    return q.withColumn("_h1", F.xxhash64(*own)).withColumn("_h2", F.xxhash64(*own, F.lit(1)))


def _one_of_each(q: DataFrame) -> DataFrame:
    """One of the queries that are equal, under the smallest query_id."""
    names = [c for c in q.columns if c not in ("query_id", *_SAME)]
    one = q.groupBy(*_SAME).agg(F.min("query_id").alias("query_id"), *[F.any_value(c).alias(c) for c in names])
    few = F.size("excluded") <= FEW
    return one.withColumn("top_n", F.col("top_n") + F.when(few, F.size("excluded")).otherwise(F.lit(0))).withColumn(
        "excluded", F.when(few, F.array().cast("array<long>")).otherwise(F.col("excluded")))


def _for_all(best: DataFrame, every: DataFrame, q: DataFrame) -> DataFrame:
    """The rows found for one of the equal queries as rows of each, without what it excludes."""
    found = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id", "distance"))).alias("found"))
    found = found.join(q.select("query_id", *_SAME), "query_id").drop("query_id")
    rows = every.join(found, _SAME)
    own = F.when(F.size("excluded") <= FEW, F.filter("found", lambda x: ~F.array_contains("excluded", x["cand_id"]))) \
        .otherwise(F.col("found"))
    rows = rows.select("query_id", F.posexplode(F.slice(own, F.lit(1), F.col("top_n"))).alias("at", "e"))
    return rows.select("query_id", "e.cand_id", "e.distance", (F.col("at") + 1).alias("rank"))


def _ranked(found: DataFrame, asked: DataFrame) -> DataFrame:
    """The first ``top_n`` ids of each query; an id found in several cells counts once."""
    # one shuffle, by query, serves both steps
    one = found.repartition("query_id").groupBy("query_id", "cand_id").agg(
        F.min("rk").alias("rk"), F.min("distance").alias("distance"))
    # equal vectors can be at -1e-16
    one = one.withColumn("distance", F.when(F.col("distance") < 0, 0.0).otherwise(F.col("distance")))
    by = Window.partitionBy("query_id").orderBy("rk", "cand_id")
    return one.withColumn("rank", F.row_number().over(by)).join(asked, "query_id").where(
        F.col("rank") <= F.col("top_n")).select("query_id", "cand_id", "distance", "rank", "rk")


def _at_distance_one(index: TokenIndex, short: DataFrame, best: DataFrame, only_ok: bool,
                     digits: int) -> DataFrame:
    """Rows at distance 1 for ``short`` queries: the smallest ids that are neither found nor excluded.

    The first ``top_n`` + excluded + found ids hold enough of them, so a query looks at that many.
    """
    pool = index.classes.where("ok") if only_ok else index.classes
    ids = pool.select(F.explode("ids").alias("cand_id")).union(
        index.members.join(pool.select("cv"), "cv", "left_semi").select("cand_id")).distinct()
    need = F.col("top_n") + F.size("excluded") + F.col("n")
    most = short.agg(F.max(need)).first()[0]              # one number
    low = ids.orderBy("cand_id").limit(most)
    low = low.withColumn("at", F.row_number().over(Window.orderBy("cand_id")))    # ``most`` rows
    rows = short.select("query_id", "excluded", F.explode(F.sequence(F.lit(1), need)).alias("at"))
    rows = rows.join(low, "at").where(~F.array_contains("excluded", F.col("cand_id")))
    rows = rows.join(best, ["query_id", "cand_id"], "left_anti")
    return rows.select("query_id", "cand_id", F.lit(1.0).alias("distance"),
                       F.lit(float(10 ** digits)).alias("rk"))
