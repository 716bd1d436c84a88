import hashlib
import re

import duckdb

from cadenza.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string, turns string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def digests(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


def edge_rows():
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi <|end|>\n<|start|>"),
            (1, 2, "assistant", "\\<|text|>\\\\"), (2, 0, None, None), (2, None, "assistant", ""),
            (3, 0, "assistant", "same"), (3, 0, "assistant", "same"),
            (4, 5, "user", "<"), (4, 6, "assistant", "<|" * 3 + "<"), (5, 0, "system", "alone"),
            (None, 0, "user", "no id"), (6, 0, "user", "word " * 5000), (6, 1, "assistant", "ok"),
            (8, 0, "us<|er\\\n", "odd role")]
    rows += [(7, 0, "system", "rules " * 30)]
    rows += [(7, i, "assistant" if i % 2 else "user", f"turn {i} 日本 " + "w " * (i % 90))
             for i in range(1, 300)]
    return rows


def test_round_trip(spark):
    rows = edge_rows()
    got = chat.read_back(chat.format_conversations(frame(spark, rows))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
            for r in got} == digests(rows)


def costs(turns):
    piece = re.compile(r"[^\W\d_]{1,12}|\d|[^\w\s]|_")
    return [len(piece.findall(t.split("<|text|>")[1])) + 8 for t in turns]


def test_no_window_passes_the_budget_unless_one_turn_does(spark):
    """History gives way to a large new turn; a turn above the budget stands alone."""
    rows = []
    for c, sizes in enumerate([(150, 900), (180, 900), (100, 40, 30, 980), (60, 60, 60, 900, 90),
                               (10, 1100, 20), (170, 846, 170, 847)]):
        for system in (0, 40):
            if system:
                rows.append((2 * c + 1, -1, "system", "s " * system))
            rows += [(2 * c + bool(system), i, "assistant" if i % 2 else "user", "w " * n)
                     for i, n in enumerate(sizes)]
    rows += [(90, 0, "user", "w " * 170), (90, 1, "assistant", "x" * 12 * 900), (90, 2, "user", "ok")]
    out = chat.format_conversations(frame(spark, rows)).collect()
    kept = 0
    for r in out:
        turns = r["formatted"].split("<|end|>\n")[:-1]
        cost, n = costs(turns), r["n_context"]
        kept += n > ("system<|text|>" in turns[0])
        assert sum(cost) <= 1024 or len(turns) - n == 1 and cost[-1] + (
            cost[0] if "system<|text|>" in turns[0] else 0) > 1024
    assert kept
    got = chat.read_back(chat.format_conversations(frame(spark, rows))).collect()
    assert {r["conv_id"]: r["turns_sha256"] for r in got} == {k: v[1] for k, v in digests(rows).items()}


def test_windows_keep_the_budget_and_history(spark):
    out = chat.format_conversations(frame(spark, [r for r in edge_rows() if r[0] == 7]),
                                    budget=300, history=100).orderBy("window").collect()
    assert len(out) > 10
    for r in out:
        turns = r["formatted"].split("<|end|>\n")[:-1]
        cost = costs(turns)
        assert sum(cost) <= 300 or len(turns) - r["n_context"] == 1
        assert turns[0].startswith("<|start|>system<|text|>")
        if r["window"]:
            assert r["n_context"] >= 1 and sum(cost[1:r["n_context"]]) <= 100
        for s in r["loss_spans"]:
            before = r["formatted"][:s["start"]]
            assert before.endswith("<|start|>assistant<|text|>")
            assert r["formatted"][s["start"] + s["length"]:].startswith("<|end|>")
            assert before.count("<|end|>\n") >= r["n_context"]


def test_sql_and_probe(spark):
    rows = [(c, 0 if t is None else t, r or "", x) for c, t, r, x in edge_rows()]
    df = chat.with_probe(frame(spark, rows))
    got = chat.read_back(chat.format_conversations(df)).toPandas()
    con = duckdb.connect()
    con.register("conversations", frame(spark, rows).toPandas())
    want = con.execute(chat.ORACLE).df()[list(got.columns)]
    as_rows = lambda d: sorted(map(str, d.fillna(-1).astype({"conv_id": int}).values.tolist()))
    assert as_rows(got) == as_rows(want)
    assert digests([(-7, 0, "user", r"\### Assistant: </turn> ok"),
                    (-7, 1, "assistant", r"\### Assistant: </turn> ok")])[-7][1] in set(
        got["turns_sha256"])


def test_empty(spark):
    assert chat.read_back(chat.format_conversations(frame(spark, []))).count() == 0
