r"""Benchmark decontamination by winnowing (native).

A window is ``width`` consecutive words of an item; an item of fewer words is one window of its own
width.  For each width in use, ``k = (width + 1) // 2``: every run of ``k`` words has a hash, and the
fingerprint of a window is the least of its ``width - k + 1`` hashes.  Equal windows have equal
fingerprints, so every shared span of ``width`` words or more is found; neighbouring windows mostly
share one fingerprint, so a text keeps a run (fingerprint, first start, last start) for about one word
in ``(width - k + 2) / 2``.

1. One pass over the texts forms each row's text key (128 bits), number of words and runs.
2. Runs meet the items' fingerprints: up to ``LITERALS`` of them go with the plan as a set, so the
   same pass keeps the hit runs and stages their windows' words; more of them are joined with staged
   runs, and the texts that have hits are read again.
3. The windows of the hit runs are compared, as words, with the items' windows.  Adjoining occurrences
   are extended to maximal spans.

Scale: with items of usual benchmark sizes only windows that share a fingerprint leave the pass over
the texts.  Beyond, a document's runs are shuffled (16 bytes for about 3.5 words of width 10), or the
fingerprints are broadcast if they are small enough; Spark decides by size and splits skewed
partitions.  The items of a window are kept once per distinct set of items, so a window that many items
share costs a text one row.  The driver holds the distinct widths (``width`` at most) and that set.

Defined results: words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; null or
wordless text has no words, is not hit and, as an item, has no window; an item with a null item_id
makes words hit but is not counted; rows of one item_id are one item; repeated documents get equal
rows; an empty table of items leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import ascii_lower, staged, text_or_empty

WIDTH = 10
LITERALS = 20_000
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["k1", "k2"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAPS), "")


def with_words(rows: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, the text's key, its words and their number."""
    rows = rows.select(*keep, text_or_empty().alias("t"))
    names = [c for c in rows.columns if c != "t"]
    rows = rows.select(*names, F.xxhash64("t").alias("k1"), F.xxhash64("t", F.lit(1)).alias("k2"),
                       words_of(F.col("t")).alias("words"))
    return rows.select("*", F.size("words").alias("n"))


def with_fingerprints(rows: DataFrame, width: int, name: str) -> DataFrame:
    """Adds ``name``: the fingerprint of each window of ``width`` words, in order."""
    k = (width + 1) // 2
    w = width - k + 1
    grams = F.when(F.col("n") >= width, F.transform(
        F.sequence(F.lit(1), F.col("n") - k + 1),
        lambda i: F.xxhash64(F.slice("words", i, k))))
    if w == 1:
        return rows.withColumn(name, grams)
    # two references: the hashes stay a column of their own and are computed once
    rows = rows.withColumn("_grams", grams)
    least = F.when(F.size("_grams") >= w, F.transform(
        F.sequence(F.lit(1), F.size("_grams") - w + 1),
        lambda i: F.array_min(F.slice("_grams", i, w))))
    return rows.withColumn(name, least).drop("_grams")


def with_runs(rows: DataFrame, width: int, name: str) -> DataFrame:
    """Adds ``name``: runs (width, f, a, b) of windows a to b (from 0) with fingerprint f."""
    rows = with_fingerprints(rows, width, "_least")
    least = F.col("_least")
    rows = rows.withColumn("_starts", F.when(F.size(least) > 0, F.filter(
        F.sequence(F.lit(0), F.size(least) - 1),
        lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)))))
    runs = F.transform("_starts", lambda s, j: F.struct(
        F.lit(width).alias("width"), F.get(least, s).alias("f"), s.alias("a"),
        (F.coalesce(F.get(F.col("_starts"), j + 1), F.size(least)) - 1).alias("b")))
    return rows.withColumn(name, runs).drop("_least", "_starts")


def item_windows(items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, list[int]]:
    """(width, f, gram, items_id) per distinct window, (items_id, items) per distinct set of items
    that hold a window, and the widths in use."""
    rows = with_words(items, F.col("item_id").cast("string").alias("item_id")).filter("n > 0")
    rows = staged(rows.select("item_id", "words", "n", F.least(F.col("n"), F.lit(width))
                              .alias("width")), "items")
    widths = sorted(r["width"] for r in rows.select("width").distinct().collect())  # <= width
    found = None
    for m in widths:
        part = with_fingerprints(rows.filter(F.col("width") == m), m, "f")
        part = part.select("item_id", "width", "words", F.posexplode("f").alias("a", "f")).select(
            "item_id", "width", "f",
            F.array_join(F.slice("words", F.col("a") + 1, m), " ").alias("gram"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.sparkSession.createDataFrame(
            [], "item_id string, width int, f long, gram string")
    found = found.groupBy("width", "f", "gram").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))
    found = staged(found.withColumn("items_id", F.xxhash64("items")).withColumn(
        "items_id2", F.xxhash64("items", F.lit(1))), "windows")
    sets = found.groupBy("items_id", "items_id2").agg(F.any_value("items").alias("items"))
    return found.drop("items"), staged(sets, "item-sets"), widths


def grams_of(runs: Column) -> Column:
    """Structs (start, width, gram) of the windows of some runs."""
    return F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(r["a"], r["b"]), lambda i: F.struct(
            i.alias("start"), r["width"].alias("width"),
            F.array_join(F.slice("words", i + 1, r["width"]), " ").alias("gram")))))


def occurrences(docs: DataFrame, items: DataFrame, width: int = WIDTH):
    """(rows, found, sets): ``rows`` is doc_id, k1, k2, n_words per document; ``found`` has the
    distinct places (k1, k2, start, width, items_id, items_id2) at which a text holds an item's
    window; ``sets`` resolves the items."""
    windows, sets, widths = item_windows(items, width)
    prints = staged(windows.select("width", "f").distinct(), "prints")
    known = prints.select("f").limit(LITERALS + 1).collect()  # by its bound
    few = len(known) <= LITERALS
    rows = with_words(docs, F.col("doc_id"))
    for m in widths:
        rows = with_runs(rows, m, f"runs{m}")
    none = F.array().cast("array<struct<width:int,f:bigint,a:int,b:int>>")
    runs = F.concat(none, *[F.coalesce(F.col(f"runs{m}"), none) for m in widths])
    names = ["doc_id", *KEY, F.col("n").cast("long").alias("n_words")]
    if few:
        held = sorted({r["f"] for r in known})
        rows = rows.withColumn("runs", F.filter(runs, lambda r: r["f"].isin(held)))
        rows = staged(rows.select(*names, grams_of(F.col("runs")).alias("grams")), "grams")
        seen = rows.select(*KEY, F.inline("grams"))
    else:
        rows = staged(rows.select(*names, runs.alias("runs")), "runs")
        hits = rows.select(*KEY, F.inline("runs")).join(prints, ["width", "f"], "left_semi")
        hits = staged(hits.groupBy(*KEY).agg(
            F.collect_set(F.struct("width", "a", "b")).alias("runs")), "hits")
        seen = with_words(docs).join(hits, KEY).select(*KEY, F.inline(grams_of(F.col("runs"))))
    found = seen.join(windows.drop("f"), ["width", "gram"]).select(
        *KEY, "start", "width", "items_id", "items_id2").distinct()
    return rows.select("doc_id", *KEY, "n_words"), staged(found, "occurrences"), sets


def spans(found: DataFrame) -> DataFrame:
    """k1, k2, first, last (words from 0, last excluded): occurrences extended to maximal spans."""
    order = Window.partitionBy(*KEY).orderBy("start", "width")
    end = F.col("start") + F.col("width")
    rows = found.select(*KEY, "start", "width", end.alias("end")).distinct()
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    rows = rows.withColumn("span", F.sum("new").over(order))
    return rows.groupBy(*KEY, "span").agg(F.min("start").alias("first"),
                                          F.max("end").alias("last")).drop("span")


def contaminated_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, first, last: the spans of words to cut from each document."""
    rows, found, _ = occurrences(docs, items, width)
    return rows.join(spans(found), KEY).select("doc_id", "first", "last")


def scan_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated - one row per document."""
    rows, found, sets = occurrences(docs, items, width)
    hit = spans(found).groupBy(*KEY).agg(
        F.sum(F.col("last") - F.col("first")).cast("long").alias("n_hit"))
    held = found.select(*KEY, "items_id", "items_id2").distinct().join(
        sets, ["items_id", "items_id2"]).select(*KEY, F.explode("items").alias("item"))
    held = held.groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = staged(hit.join(held, KEY, "left"), "contaminated")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(result, KEY, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


ORACLE = r"""
with d as (select row_number() over () rid, doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from documents),
b as (select item_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from benchmark),
i as (select item_id, ws, least(len(ws), 10) m from b where len(ws) > 0),
g as (select distinct item_id, m, array_to_string(ws[p:p + m - 1], ' ') gram
  from (select *, unnest(range(1, len(ws) - m + 2)) p from i)),
p as (select rid, ws, m, unnest(range(1, len(ws) - m + 2)) p
  from d, (select distinct m from g) where len(ws) >= m),
o as (select rid, p, w.m, item_id
  from (select rid, p, m, array_to_string(ws[p:p + m - 1], ' ') gram from p) w
  join g on g.m = w.m and g.gram = w.gram),
h as (select rid, count(distinct q) n from (select rid, unnest(range(p, p + m)) q from o) group by 1),
n as (select rid, count(distinct item_id) n,
    string_agg(distinct item_id::varchar, ',' order by item_id::varchar) s from o group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(h.n, 0)::bigint n_hit,
  coalesce(n.n, 0)::bigint n_items, sha256(coalesce(n.s, '')) items_sha256,
  h.n is not null contaminated
from d left join h using (rid) left join n using (rid)
"""
