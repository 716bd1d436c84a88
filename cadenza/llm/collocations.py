r"""Phrase collocations by multikey quicksort of suffix pointers.

1. A map task cuts texts into pieces and words and forms, at each word, the suffix of at most four
   words within its piece.  Equal suffixes of a chunk are counted before they leave the task, so a
   line or passage that many texts share costs a chunk one row.  Beside them go the chunk's counts
   of single words and of all words.
2. Suffixes are routed by (language, first two words) to buckets of about ``BUCKET`` bytes of text.
   Pairs (triples) of words that would overfill a bucket are routed by their third (fourth) word too.
   They are found on a sample, kept as bits in tables of ``SLOTS`` slots (a fixed size), and decide
   nothing but the routing: a slot that is set without need only means more partial counts.
3. A bucket is sorted by multikey three-way quicksort to a depth of four words, all partitions of a
   round at a time: each is split by its middle pointer's word into less, equal and greater; the
   weight of an equal partition is the count of its words.  A partition of less than ``LEAST`` is
   abandoned, unless its words were routed apart and its count is a part only.
4. Counts of parts add up; phrases join their halves' counts, the worst cut scores, phrases held by a
   longer one at 80 percent go, and each language's first ``TOP`` are ranked in two steps.

Scale: one shuffle of pre-aggregated suffixes, then tables of frequent phrases only.  A bucket's rows
are bounded by the routing; the driver holds the bit tables and one sum.

Defined results: null text is empty; a null lang is ``und``; repeated rows count as often as they
stand; ties as the query's contract states; an empty table gives an empty result; other columns are
ignored.  Words are compared as texts, never by hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import staged, text_or_empty
from cadenza.llm.near_dup import _odd, _powers, mix

DEPTH = 4
LEAST = 30
TOP = 2000
HELD = 80               # percent of a phrase's occurrences in a longer one that drop it
CHUNK = 3_000_000       # characters that a task combines at once
BUCKET = 2_000_000      # bytes of text to a bucket
SLOTS = 1 << 20
SAMPLE_ROWS, SAMPLE_SHARE = 5000, 0.001


def string_hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of strings, the same in every task."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    ends = ends.astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=total[1:])
    return mix((total[ends[1:]] - total[ends[:-1]]) * inverse[ends[:-1]])


def route_hashes(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of a language and leading words."""
    odd = _odd(DEPTH + 1, 21)
    out = lang * odd[0]
    for k, w in enumerate(words):
        out = out + w * odd[k + 1]
    return mix(out)


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


# -- words of a chunk ---------------------------------------------------------------------

def _distinct(at: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct tuple of keys, and its count; sorted, which holds less than hash tables."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(fresh)
    return at[order[first]], np.diff(np.append(first, len(order)))


class Chunk:
    """Words of some texts: ``lang`` and ``word`` (codes), and ``next[k]``, the word k places
    on in the same piece (-1: none)."""

    def __init__(self, langs: list[str], texts: list[str]):
        data = np.frombuffer("\n".join(texts).encode(), np.uint8)
        size = np.array([len(t.encode()) for t in texts], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        stops, blanks = np.zeros(256, bool), np.zeros(256, bool)
        stops[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
        blanks[[0x20, 0x09]] = True
        data = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
        stop = stops[data]
        apart = stop | blanks[data]
        edge = np.diff(np.concatenate([[True], apart, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        piece = np.cumsum(stop, dtype=np.int32)[starts] if len(starts) else starts
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        every = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets),
                                            pa.py_buffer(data[~apart].tobytes()))
        every = every.dictionary_encode()
        self.words = every.dictionary
        self.word = every.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        code, names = pd.factorize(pd.Series(langs, dtype="object"))
        self.langs = pa.array(list(names), pa.string())
        self.lang = code[np.searchsorted(begin, starts, "right") - 1].astype(np.int32) \
            if len(starts) else np.zeros(0, np.int32)
        self.next = [self.word]
        for k in range(1, DEPTH):
            on = np.full(len(starts), -1, np.int32)
            if len(starts) > k:
                on[:-k] = np.where(piece[k:] == piece[:-k], self.word[k:], -1)
            self.next.append(on)
        self.hash = np.append(string_hashes(self.words), np.uint64(0))  # [-1]: no word
        self.lang_hash = string_hashes(self.langs)

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        return route_hashes(self.lang_hash[self.lang[at]],
                            [self.hash[self.next[k][at]] for k in range(width)])

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct suffix of two words or more, and its count."""
        at = np.flatnonzero(self.next[1] >= 0)
        if not len(at):
            return at, at
        v = len(self.words) + 1
        lead = (self.lang[at].astype(np.int64) * v + self.word[at]) * v + self.next[1][at]
        return _distinct(at, lead, (self.next[2][at].astype(np.int64) + 1) * v + self.next[3][at] + 1)

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct (language, word), and its count."""
        return _distinct(np.arange(len(self.word)), self.lang.astype(np.int64) * (len(self.words) + 1) + self.word)

    def text(self, at: np.ndarray, width: int) -> pa.StringArray:
        """The first ``width`` words at the places, joined by spaces."""
        parts = []
        for k in range(width):
            w = self.next[k][at]
            parts.append(self.words.take(pa.array(w, mask=w < 0)))
        return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def chunks(batches, size: int):
    """(languages, texts) of about ``size`` characters from (lang, text) batches."""
    langs, texts, held = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            langs.append(lang.as_py())
            texts.append(text.as_py())
            held += len(texts[-1]) + 1
            if held >= size:
                yield langs, texts
                langs, texts, held = [], [], 0
    if texts:
        yield langs, texts


# -- routing ------------------------------------------------------------------------------

def crowded(rows: DataFrame, n_rows: int, share: float) -> list[np.ndarray]:
    """Slots of pairs and of triples of words with more than ``share`` of a sample's words."""
    part = min(1.0, max(SAMPLE_SHARE, SAMPLE_ROWS / max(n_rows, 1)))

    def run(batches):
        for langs, texts in chunks(batches, CHUNK):
            c = Chunk(langs, texts)
            for width in (2, 3):
                at = np.flatnonzero(c.next[width - 1] >= 0)
                n = np.bincount(slot_of(c.hashes(at, width)), minlength=1)
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({
                    "width": pa.array(np.full(len(found), width), pa.int32()),
                    "slot": pa.array(found), "n": pa.array(n[found].astype(np.int64))})
            yield pa.RecordBatch.from_pydict({
                "width": pa.array([0], pa.int32()), "slot": pa.array([0], pa.int64()),
                "n": pa.array([len(c.word)], pa.int64())})

    counts = rows.sample(part, seed=13) if part < 1 else rows
    counts = staged(counts.mapInArrow(run, "width int, slot long, n long")
                    .groupBy("width", "slot").agg(F.sum("n").alias("n")), "slots")
    total = counts.filter("width = 0").agg(F.sum("n")).first()[0] or 0
    over = counts.filter((F.col("width") > 0) & (F.col("n") > share * total)).select(
        "width", "slot").collect()  # 2 * SLOTS rows at most
    return [np.array(sorted(r["slot"] for r in over if r["width"] == w), np.int64) for w in (2, 3)]


def open_words(pair: np.ndarray, triple: np.ndarray, has_third: np.ndarray,
               slots: list[np.ndarray]) -> np.ndarray:
    """The number of leading words whose count is dealt out: 0, 2 or 3."""
    two = np.isin(slot_of(pair), slots[0])
    return np.where(two & has_third & np.isin(slot_of(triple), slots[1]), 3, np.where(two, 2, 0))


def _rows(c: Chunk, buckets: int, slots: list[np.ndarray]) -> list[pa.RecordBatch]:
    """A chunk's rows: lang, bucket, suffix, n; and its languages' numbers of words."""
    if not len(c.word):
        return []
    at, n = c.suffixes()
    pair, triple = c.hashes(at, 2), c.hashes(at, 3)
    dealt = open_words(pair, triple, c.next[2][at] >= 0, slots)
    route = np.where(dealt == 3, c.hashes(at, 4), np.where(dealt == 2, triple, pair))
    del pair, triple, dealt
    one, m = c.singles()
    lang = np.concatenate([c.lang[at], c.lang[one]])
    bucket = (np.concatenate([route, c.hashes(one, 1)]) % np.uint64(buckets)).astype(np.int64)
    n = np.concatenate([n, m])
    order = np.lexsort((bucket, lang))
    lang, bucket, n = lang[order], bucket[order], n[order]
    first = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0))
    offsets = pa.array(np.append(first, len(order)), pa.int32())
    text = pa.concat_arrays([c.text(at, DEPTH), c.text(one, 1)]).take(pa.array(order))
    words = np.bincount(c.lang, minlength=len(c.langs))
    names = ["lang", "bucket", "suffix", "n"]
    return [
        pa.RecordBatch.from_arrays(
            [c.langs.take(pa.array(lang[first])), pa.array(bucket[first]),
             pa.ListArray.from_arrays(offsets, text),
             pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))], names),
        pa.RecordBatch.from_arrays(
            [c.langs, pa.array(np.full(len(words), -1)),
             pa.array([[""]] * len(words), pa.list_(pa.string())),
             pa.array(words[:, None].astype(np.int64).tolist(), pa.list_(pa.int64()))], names)]


def routed(rows: DataFrame, buckets: int, slots: list[np.ndarray]) -> DataFrame:
    """lang, bucket, suffix (array), n (array) - combined by chunk; bucket -1 has all words."""
    def run(batches):
        for langs, texts in chunks(batches, CHUNK):
            # nothing of a chunk but its rows is held while they are sent and the next one is read
            yield from _rows(Chunk(langs, texts), buckets, slots)

    return rows.mapInArrow(run, "lang string, bucket long, suffix array<string>, n array<long>")


# -- multikey quicksort -------------------------------------------------------------------

def frequent_prefixes(words: np.ndarray, weight: np.ndarray, dealt: np.ndarray, least: int = LEAST):
    """(row, length, count) of the prefixes of the rows of ``words`` (codes, 0 behind the end).

    All partitions of a round are split at once.  ``dealt`` rows count in parts up to that many
    words: such prefixes are given whatever their count.  A row of one word is that word's count.
    """
    ptr = np.arange(len(words))
    size, depth = np.array([len(words)]), np.array([0])
    out = []
    while len(ptr):
        seg = np.repeat(np.arange(len(size)), size)
        start = np.cumsum(size) - size
        key = words[ptr, depth[seg]]
        pivot = key[start + size // 2]
        side = (key >= pivot[seg]).astype(np.int64) + (key > pivot[seg])  # 0 less, 1 equal, 2 more
        part = seg * 3 + side
        n = np.bincount(part, minlength=3 * len(size))
        # a stable three-way partition of every segment
        place = np.empty(len(ptr), np.int64)
        base = np.cumsum(n) - n
        for s in range(3):
            mine = np.flatnonzero(side == s)
            of = part[mine]
            fresh = np.flatnonzero(np.diff(of, prepend=-1))
            rank = np.arange(len(of)) - np.repeat(fresh, np.diff(np.append(fresh, len(of))))
            place[mine] = base[of] + rank
        moved = np.empty_like(ptr)
        moved[place] = ptr
        some = np.flatnonzero(n)
        total = np.add.reduceat(weight[moved], base[some])
        most = np.maximum.reduceat(dealt[moved], base[some])
        own, equal = some // 3, some % 3 == 1
        d, last = depth[own], pivot[own] == 0
        head = moved[base[some]]
        length = np.where(last, d, d + 1)
        done = equal & np.where(last, d == 1, d > 0) & ((total >= least) | (dealt[head] >= length))
        out.append((head[done], length[done], total[done]))
        # equal partitions go on with the next word; small ones that are whole are abandoned
        d = d + equal
        go = ((total >= least) | (most > d)) & (d < words.shape[1]) & ~(equal & last)
        keep = np.zeros(len(n), bool)
        keep[some[go]] = True
        ptr = moved[np.repeat(keep, n)]
        size, depth = n[some[go]], d[go]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sort(slots: list[np.ndarray], least: int):
    def run(key, table):
        lang = key[0].as_py()
        suffix = pc.list_flatten(table.column("suffix").combine_chunks())
        if isinstance(suffix, pa.ChunkedArray):
            suffix = suffix.combine_chunks()
        weight = pc.list_flatten(table.column("n").combine_chunks())
        weight = weight.to_numpy(zero_copy_only=False).astype(np.int64)
        if key[1].as_py() < 0:  # all words of a language
            rows = [lang], [""], [0], [int(weight.sum())]
        else:
            split = pc.split_pattern(suffix, " ")
            size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.list_flatten(split).dictionary_encode()
            row = np.repeat(np.arange(len(size)), size)
            col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            words = np.zeros((len(size), DEPTH), np.int64)
            words[row, col] = code.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
            own = np.append(np.uint64(0), string_hashes(code.dictionary))
            h = [own[words[:, k]] for k in range(3)]
            lead = np.full(len(size), string_hashes(pa.array([lang], pa.string()))[0], np.uint64)
            dealt = open_words(route_hashes(lead, h[:2]), route_hashes(lead, h), words[:, 2] > 0, slots)
            dealt[words[:, 1] == 0] = 0
            at, length, n = frequent_prefixes(words, weight, dealt, least)
            parts = [code.dictionary.take(pa.array(
                words[at, k] - 1, mask=(k >= length) | (words[at, k] == 0))) for k in range(DEPTH)]
            rows = ([lang] * len(at),
                    pc.binary_join_element_wise(*parts, " ", null_handling="skip"), length, n)
        return pa.table({"lang": pa.array(rows[0], pa.string()),
                         "phrase": rows[1] if isinstance(rows[1], pa.Array) else pa.array(rows[1]),
                         "words": pa.array(rows[2], pa.int32()), "f": pa.array(rows[3], pa.int64())})

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, bucket: int = BUCKET) -> DataFrame:
    """lang, phrase, words, f: phrases of one to four words found ``least`` times or more, and
    each language's number of words as the phrase of no words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       text_or_empty().alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.octet_length("text")).alias("bytes")).first()  # one row
    buckets = max(1, math.ceil((size["bytes"] or 0) / bucket))
    slots = crowded(rows, size["n"], 1 / (2 * buckets))
    parts = routed(rows, buckets, slots).groupBy("lang", "bucket").applyInArrow(
        _sort(slots, least), "lang string, phrase string, words int, f long")
    counts = parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return staged(counts.filter((F.col("words") == 0) | (F.col("f") >= least)), "phrases")


# -- scores -------------------------------------------------------------------------------

def _cuts(words) -> DataFrame:
    """Structs (k, left, right) for each cut of an array of words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("left"),
        F.array_join(F.slice(words, k + 1, F.size(words) - k), " ").alias("right")))


def _inner(words) -> DataFrame:
    """The shorter phrases of two words or more inside an array of words."""
    return F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size(words) - n + 1),
        lambda i: F.array_join(F.slice(words, i, n), " "))))


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score by the worst cut (the first of equal ones)."""
    own = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    own = own.withColumn("c", F.explode(_cuts(F.split("phrase", " ")))).select(
        "lang", "phrase", "words", "a", "c.*")
    part = counts.filter("words > 0")
    own = own.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")),
                   ["lang", "left"])
    own = own.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")),
                   ["lang", "right"])
    wide = [F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")]
    score = F.lit(2000000).cast("decimal(19,0)") * wide[0]
    own = own.withColumn("score", score).withColumn("both", wide[1] + wide[2]).withColumn(
        "score", F.expr("score div both"))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("w")
    return own.groupBy("lang", "phrase", "words", "a").agg(worst).select(
        "lang", "phrase", "words", "a", "w.l", "w.r", "w.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, held: int = HELD,
                 bucket: int = BUCKET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score - each language's first ``top`` phrases."""
    counts = phrase_counts(docs, least, bucket)
    longer = counts.filter("words > 2").select(
        "lang", F.explode(F.array_distinct(_inner(F.split("phrase", " ")))).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    rows = scored(counts).join(longer, ["lang", "phrase"], "left")
    rows = rows.filter(F.coalesce(
        F.lit(100).cast("decimal(19,0)") * F.col("most").cast("decimal(19,0)")
        < F.lit(held).cast("decimal(19,0)") * F.col("a").cast("decimal(19,0)"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of each of some parts of a language, then of the language
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = Window.partitionBy("lang", "part").orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(few)).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    n = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return rows.filter(F.col("rank") <= top).join(n, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
        F.col("score").cast("long").alias("score"))


ORACLE = r"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) p from d),
w as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') ws from p),
n as (select lang, sum(len(ws)) n from w group by 1),
f as (select lang, m, array_to_string(ws[i:i + m - 1], ' ') phrase, count(*) f
  from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) i
    from w, (select unnest([1, 2, 3, 4]) m) where len(ws) >= m) group by all having count(*) >= 30),
c as (select lang, phrase, m, f a, string_split(phrase, ' ') ws from f where m > 1),
k as (select *, unnest(range(1, m)) k from c),
s as (select k.lang, k.phrase, k.a, k.k, l.f l, r.f r,
    (2000000::hugeint * k.a) // (l.f::hugeint + r.f) score
  from k join f l on l.lang = k.lang and l.phrase = array_to_string(ws[1:k.k], ' ')
    join f r on r.lang = k.lang and r.phrase = array_to_string(ws[k.k + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, a, ws, o, unnest(range(1, len(ws) - o + 2)) i
  from c, (select unnest([2, 3]) o) where o < m),
x as (select lang, array_to_string(ws[i:i + o - 1], ' ') phrase, max(a) most from i group by all)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase))
    rank, b.phrase, a, l, r, n::bigint n, score::bigint score
from b join n using (lang) left join x on x.lang = b.lang and x.phrase = b.phrase
where x.most is null or 100 * x.most < 80 * a
qualify rank <= 2000
"""
