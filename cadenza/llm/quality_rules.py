"""Quality rules: document rules, then host verdicts from shrunken failure rates (native).

``rule_metrics`` computes the document rules with built-in functions over whole texts: few words or
many repeated ones (``base_failed``, which decides alone), and also many symbols or repeated lines
(``rule_failed``, which tells a host's quality).
``host_verdicts`` counts rows and failures of any rule by host, fits a beta prior to the hosts' rates by
moments (the binomial part of their spread taken out) and shrinks each rate towards it: a host
with few documents needs more evidence than one with many.  ``quality_rules`` joins the verdicts
back to the documents.

Scale: texts are read once and never shuffled; the metrics (tens of bytes a document) are staged
in the shared folder.  The host table comes from one partial aggregate.  The join back salts hosts
(``salts`` copies of the host table, which holds one narrow row per host), so that a host with a
third of all documents lands in ``salts`` tasks; Spark broadcasts the host table instead where
its written size is below the broadcast threshold.

Defined results: null or empty text counts no words and fails; a null host has no verdict (its
documents are judged alone); repeated rows count as often as they stand; an empty table gives an
empty result; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import SPACE, WORD, staged, text_or_empty

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 10     # of the words' characters
MAX_DUP_LINE_PERCENT = 30   # of the lines with a word
WINDOW = 8
MAX_HOST_RATE = 0.75
SALTS = 32


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _window_keys(words: Column, n_words: Column, width: int) -> Column:
    """xxhash64 of each window of ``width`` words (none where there are fewer than two)."""
    return F.when(n_words > width, F.transform(
        F.sequence(F.lit(1), n_words - (width - 1)),
        lambda i: F.xxhash64(F.slice(words, i, width))))


def _covered(keys: Column, width: int) -> tuple:
    """Steps from window keys to the words lying in windows found twice or more."""
    pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))

    def starts(s):
        return F.sort_array(F.array_compact(F.transform(s, lambda x, i: F.when(
            (x["k"] == F.get(s, i - 1)["k"]) | (x["k"] == F.get(s, i + 1)["k"]), x["p"]))))

    def total(p):
        steps = F.transform(p, lambda x, i: F.least(
            F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return pairs, starts, total


def rule_metrics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"),
                 width: int = WINDOW) -> DataFrame:
    """``keep`` columns plus the rule columns; windows are compared by their 64-bit hash."""
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), text_or_empty().alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        "row", words_of(F.col("t")).alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    rows = rows.select(
        "row", "n_symbols", F.size("words").alias("n"), "words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    rows = rows.withColumn("keys", _window_keys(F.col("words"), F.col("n"), width)).drop("words")
    # only texts in which some window repeats are sorted
    rows = rows.withColumn("keys", F.when(
        F.size(F.array_distinct("keys")) < F.size("keys"), F.col("keys")))
    pairs, starts, total = _covered(F.col("keys"), width)
    rows = rows.withColumn("pairs", pairs).drop("keys")
    rows = rows.withColumn("at", starts(F.col("pairs"))).drop("pairs")
    rows = rows.withColumn("n_repeat_words",
                           F.when(F.col("at").isNotNull(), total(F.col("at")))
                           .otherwise(F.lit(0).cast("long")))
    n = F.col("n").cast("long")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    also = failed | (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")) | (
        100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    return rows.select("row.*", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", failed.alias("base_failed"), also.alias("rule_failed"))


def host_verdicts(metrics: DataFrame, host: str = "source",
                  max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunk), host_failed - one row per non-null host."""
    hosts = staged(
        metrics.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum(F.col("rule_failed").cast("long")).alias("n_failed")), "hosts")
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    # one row: totals and the spread of the rates
    total = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count(F.lit(1)).alias("h"),
                      F.sum(f * f / n).alias("ff")).first()
    a, b = beta_prior(total["n"], total["f"], total["h"], total["ff"])
    rate = (f + F.lit(a)) / (n + F.lit(a + b))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("host_rate"),
                        (rate > F.lit(max_rate)).alias("host_failed"))


def beta_prior(n, f, h, ff) -> tuple[float, float]:
    """Beta parameters by moments from sums over hosts: rows, failures, hosts, sum(f*f/n)."""
    if not n:
        return 1.0, 1.0
    mean = min(max(f / n, 1e-6), 1 - 1e-6)
    spread = max(ff / n - (f / n) ** 2, 0.0) - mean * (1 - mean) * h / n
    strength = mean * (1 - mean) / spread - 1 if spread > 1e-12 else 1e4
    strength = min(max(strength, 2.0), 1e4)
    return mean * strength, (1 - mean) * strength


def with_verdict(metrics: DataFrame, verdicts: DataFrame, host: str = "source",
                 salts: int = SALTS) -> DataFrame:
    """``metrics`` plus host_failed and kept; the host side is copied to ``salts`` salts."""
    side = verdicts.filter("host_failed").select(
        F.col("host").alias("_host"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    names = metrics.columns
    left = metrics.select(F.struct("*").alias("_row"), F.col(host).alias("_host"),
                          F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts))
                          .cast("int").alias("_salt"))
    joined = left.join(side.withColumn("_bad", F.lit(True)), ["_host", "_salt"], "left")
    bad = F.coalesce(F.col("_bad"), F.lit(False))
    return joined.select(*[F.col("_row")[c].alias(c) for c in names], bad.alias("host_failed"),
                         (~F.col("_row")["base_failed"] & ~bad).alias("kept"))


def quality_rules(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, source, the rule columns, base_failed, rule_failed, host_failed, kept."""
    metrics = staged(rule_metrics(docs), "rules")
    return with_verdict(metrics, host_verdicts(metrics, max_rate=max_rate))


def keep_documents(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rows of ``docs`` (all its columns) that the rules keep.

    The rows are staged once with their metrics, without the texts of rows that fail alone.
    """
    names = docs.columns
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("source"),
                       F.struct(*[F.col(c) for c in names]).alias("_doc"))
    rows = rule_metrics(rows, keep=("doc_id", "source", "_doc"))
    rows = rows.withColumn("_doc", F.when(~F.col("base_failed"), F.col("_doc")))
    rows = staged(rows, "ruled")
    verdicts = host_verdicts(rows, max_rate=max_rate)
    kept = with_verdict(rows.filter(~F.col("base_failed")), verdicts).filter("kept")
    return kept.select(*[F.col("_doc")[c].alias(c) for c in names])


ORACLE = r"""
with d as (select row_number() over () rid, doc_id, source, coalesce(text, '') t from documents),
w as (select rid, doc_id, source, t,
        list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls
      from d),
g as (select rid, i, array_to_string(ws[i:i + 7], ' ') g
      from (select rid, ws, unnest(range(1, len(ws) - 6)) i from w)),
r as (select rid, i from g qualify count(*) over (partition by rid, g) > 1),
c as (select rid, sum(step) n from (
        select rid, least(8, coalesce(lead(i) over (partition by rid order by i) - i, 8)) step
        from r) group by rid),
m as (select w.rid, doc_id, source, len(ws) n_words, length(array_to_string(ws, '')) word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols,
        len(ls) - len(list_distinct(ls)) n_dup_lines, len(ls) n_lines, coalesce(c.n, 0) n_repeat_words
      from w left join c using (rid)),
a as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from m),
b as (select *, base_failed or 100 * n_symbols > 10 * word_chars or 100 * n_dup_lines > 30 * n_lines
  rule_failed from a),
h as (select source, count(*) n, sum(rule_failed::int) f from b where source is not null group by 1),
t as (select sum(n) n, sum(f) f, count(*) h, sum(f * f / n::double) ff from h),
p as (select *, least(greatest(f / n, 1e-6), 1 - 1e-6) mean,
        greatest(ff / n - (f / n) ** 2, 0) spread from t),
q as (select mean, spread - mean * (1 - mean) * h / n net from p),
s as (select mean, least(greatest(case when net > 1e-12 then mean * (1 - mean) / net - 1
        else 1e4 end, 2), 1e4) k from q),
v as (select source, (f + mean * k) / (n + k) > 0.75 bad from h, s)
select doc_id, b.source, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars,
  cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
  cast(n_repeat_words as bigint) n_repeat_words, base_failed, rule_failed,
  coalesce(bad, false) host_failed, not base_failed and not coalesce(bad, false) kept
from b left join v on b.source = v.source
"""
