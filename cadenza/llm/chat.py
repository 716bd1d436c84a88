r"""Chat formatting in budgeted windows (native).

A conversation's turns get a token cost (pieces of the text plus the template's marks).  Prefix sums
of the costs choose turn-aligned spans: a window takes turns while system turn, repeated history
and new turns stay within ``budget``; a turn that is larger by itself stands alone.  A later window
repeats the system turn (the first turn, if its role is ``system``) and as many of the turns before
it as cost ``history`` at most and leave room for its first new turn.  Repeated turns are outside the
loss mask, so every assistant text is a target exactly once.  A run of letters costs a token for each
twelve of them.

Template: ``<|start|>role<|text|>text<|end|>`` and a line end.  In roles and texts a backslash is
doubled and ``<|`` becomes ``<\|``, so no control string can come from a text and ``unescape``
restores every text.

``format_conversations`` gives one row per window: conv_id, window, n_context (repeated turns at its
start), formatted, loss_spans (start and length in code points).  ``read_back`` parses those rows.

Scale: one shuffle by conv_id serves prefix sums, spans and reading back.  A conversation is the
unit of the result (its digest is over all its turns) and is formed in one task; conversations
spread over tasks whatever their contents.

Defined results: null role or text is empty; turns go by turn (nulls first), then role and text, so
repeated rows are turns of their own; rows with a null conv_id form one conversation; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET, HISTORY, MARKS = 1024, 192, 8
PIECES = r"\p{L}{1,12}|\p{N}|[^\p{L}\p{N}\x00-\x20]"
START, TEXT, END = "<|start|>", "<|text|>", "<|end|>\n"
SYSTEM, TARGET = "system", "assistant"


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _turns(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """A row per turn: its place, cost, rendered text, prefix sums and possible history."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT))
    rows = rows.select(
        "*", (F.regexp_count("text", F.lit(PIECES)) + MARKS).cast("long").alias("cost"),
        head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("whole", F.concat("head", "body", F.lit(END)))
    rows = rows.withColumn("size", F.length("whole").cast("long"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(by)
    rows = rows.withColumn("place", place).withColumn(
        "is_system", (F.col("place") == 1) & (F.col("role") == SYSTEM))
    spent = F.coalesce(F.sum(F.when(~F.col("is_system"), F.col("cost"))).over(past),
                       F.lit(0).cast("long"))
    system = F.coalesce(F.first(F.when(F.col("is_system"), F.col("cost"))).over(by), F.lit(0))
    rows = rows.select(
        "conv_id", "place", "is_system", "cost", "size", "whole", system.cast("long").alias("system"),
        F.when(F.col("role") == TARGET, F.struct(
            F.length("head").alias("head"), F.length("body").alias("body"))).alias("target"),
        # the system turn stands before any history
        F.when(F.col("is_system"), F.lit(-history - 1)).otherwise(spent).cast("long")
        .alias("spent"),
        F.coalesce(F.sum("size").over(past), F.lit(0).cast("long")).alias("before"))
    # at most history / MARKS turns
    last = Window.partitionBy("conv_id").orderBy("spent").rangeBetween(-history, -1)
    rows = rows.withColumn("past", F.collect_list(F.struct("spent", "cost")).over(last))
    room = F.least(F.lit(history), budget - F.col("system") - F.col("cost"))
    past = F.filter("past", lambda p: F.col("spent") - p["spent"] <= room)
    rows = rows.withColumn("past", F.when(F.col("is_system"), F.slice("past", 1, 0)).otherwise(past))
    return rows.withColumn("n_history", F.size("past")).withColumn(
        "history_cost", F.aggregate("past", F.lit(0).cast("long"), lambda a, p: a + p["cost"]))


def _spans(turns: Column, budget: int) -> Column:
    """The window of each turn, by one pass over the costs."""
    first = F.get(turns, 0)
    system = F.when(first["is_system"], first["cost"]).otherwise(F.lit(0).cast("long"))
    start = F.struct(F.lit(0).alias("window"), F.lit(0).cast("long").alias("used"),
                     F.array().cast("array<int>").alias("of"))

    def step(state, turn):
        cost = F.when(turn["is_system"], F.lit(0).cast("long")).otherwise(turn["cost"])
        fits = (system + state["used"] + cost <= budget) | (turn["place"] == 1) \
            | (state["used"] == 0)
        window = F.when(fits, state["window"]).otherwise(state["window"] + 1)
        used = F.when(fits, state["used"] + cost).otherwise(turn["history_cost"] + cost)
        return F.struct(window.alias("window"), used.alias("used"),
                        F.concat(state["of"], F.array(window)).alias("of"))

    return F.aggregate(turns, start, step, lambda s: s["of"])


def format_conversations(rows: DataFrame, budget: int = BUDGET,
                         history: int = HISTORY) -> DataFrame:
    """conv_id, window, n_context, formatted, loss_spans - one row per window."""
    turns = _turns(rows, budget, history)
    fields = ["place", "is_system", "cost", "size", "whole", "target", "before", "n_history",
              "history_cost"]
    conv = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("turns"))
    conv = conv.withColumn("of", _spans(F.col("turns"), budget))
    conv = conv.select("conv_id", "turns", "of", F.explode(
        F.sequence(F.lit(0), F.array_max("of"))).alias("window"))
    conv = conv.withColumn("first", F.array_position("of", F.col("window")).cast("int"))
    conv = conv.withColumn("n", F.size(F.filter("of", lambda w: w == F.col("window"))))
    lead = F.get(F.col("turns"), 0)
    opening = F.get(F.col("turns"), F.col("first") - 1)
    past = F.when(F.col("window") > 0, opening["n_history"]).otherwise(0)
    conv = conv.withColumn("n_past", past)
    again = F.when((F.col("window") > 0) & lead["is_system"], F.slice("turns", 1, 1)).otherwise(
        F.slice("turns", 1, 0))
    conv = conv.select(
        "conv_id", "window",
        F.concat(again, F.slice("turns", F.col("first") - F.col("n_past"), F.col("n_past")))
        .alias("context"), F.slice("turns", F.col("first"), F.col("n")).alias("new"))
    lead = F.aggregate("context", F.lit(0).cast("long"), lambda a, t: a + t["size"])
    conv = conv.withColumn("lead", lead)
    opening = F.get(F.col("new"), 0)["before"]
    spans = F.transform(F.filter("new", lambda t: t["target"].isNotNull()), lambda t: F.struct(
        (F.col("lead") + t["before"] - opening + t["target"]["head"]).cast("int").alias("start"),
        t["target"]["body"].alias("length")))
    return conv.select(
        "conv_id", "window", F.size("context").alias("n_context"),
        F.array_join(F.transform(F.concat("context", "new"), lambda t: t["whole"]), "")
        .alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parts = F.split("formatted", r"<\|end\|>\n")
    rows = formatted.withColumn("parts", F.slice(
        parts, F.col("n_context") + 1, F.size(parts) - 1 - F.col("n_context")))

    def turn(part):
        inner = F.substr(part, F.lit(len(START) + 1))
        at = F.locate(TEXT, inner)
        return F.concat(unescape(F.substr(inner, F.lit(1), at - 1)), F.lit("\n"),
                        unescape(F.substr(inner, at + len(TEXT))), F.lit("\n"))

    rows = rows.select(
        "conv_id", "window", F.size("parts").alias("n"),
        F.array_join(F.transform("parts", turn), "").alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(
            F.col("formatted"), s["start"] + 1, s["length"]))), "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"))
    rows = rows.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
        F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    rows = rows.withColumn("turns", F.array_join(F.transform("w", lambda x: x["turns"]), "")) \
        .withColumn("loss", F.array_join(F.transform("w", lambda x: x["loss"]), ""))
    return rows.select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
        "n_windows")


def with_probe(rows: DataFrame) -> DataFrame:
    """The contract's conversation -7, whose texts hold control strings."""
    said = r"\### Assistant: </turn> ok"
    probe = rows.sparkSession.sql("select explode(sequence(0, 1)) as turn").select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"),
                       F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


ORACLE = r"""
with recursive c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, row_number() over (partition by conv_id order by turn nulls first, role, t) place,
    len(regexp_extract_all(t, '\p{L}{1,12}|\p{N}|[^\p{L}\p{N}\x00-\x20]')) + 8 as price,
    length(replace(replace(role, '\', '\\'), '<|', '<\|'))
      + length(replace(replace(t, '\', '\\'), '<|', '<\|')) + 25 as size
  from c),
f as (select *, place = 1 and role = 'system' as sys from e),
g as (select *, coalesce(max(case when sys then price end) over (partition by conv_id), 0) sys_cost,
    coalesce(max(case when sys then size end) over (partition by conv_id), 0) sys_size,
    case when sys then 0 else price end as cost from f),
p as (select *, coalesce(sum(cost) over (partition by conv_id order by place
    rows between unbounded preceding and 1 preceding), 0) spent from g),
h as (select a.conv_id, a.place, coalesce(sum(b.cost), 0) history_cost,
    coalesce(sum(b.size), 0) history_size
  from p a left join p b on a.conv_id is not distinct from b.conv_id and not b.sys
    and b.place < a.place and a.spent - b.spent <= least(192, 1024 - a.sys_cost - a.cost) group by all),
i as (select p.*, history_cost, history_size from p join h
  on p.conv_id is not distinct from h.conv_id and p.place = h.place),
r as (select conv_id, place, 0 as win, cost as used, size as chars from i where place = 1
  union all
  select i.conv_id, i.place, case when fits then r.win else r.win + 1 end,
    case when fits then r.used + i.cost else i.history_cost + i.cost end,
    case when fits then i.size else i.size + i.history_size + i.sys_size end
  from r join (select * from i) i on r.conv_id is not distinct from i.conv_id
      and i.place = r.place + 1,
    lateral (select i.sys_cost + r.used + i.cost <= 1024 or r.used = 0 as fits)),
s as (select conv_id, sum(chars) formatted_chars, max(win) + 1 n_windows from r group by 1)
select e.conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' order by place)) turns_sha256,
  coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by place) filter (role = 'assistant'), '')) loss_sha256,
  any_value(formatted_chars)::bigint formatted_chars, any_value(n_windows)::bigint n_windows
from e join s on e.conv_id is not distinct from s.conv_id group by e.conv_id
"""
