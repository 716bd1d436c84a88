import re

import pytest

from llm_cases import EDGES, documents, make  # noqa: F401
from cadenza.llm import licenses as L


def words(text):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]


def grams(text):
    w = words(text)
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def brute_force(text):
    """Templates of which some window holds 80 percent of the shingles."""
    own, out = grams(text), set()
    for g in L.groups_of(L.TEMPLATES, 80):
        for t, _ in g.members:
            want = set(grams(L.TEMPLATES[t][1]))
            for a in range(0, len(own), g.step):
                if 100 * len(want & set(own[a:a + g.width])) >= 80 * len(want):
                    out.add(t)
    return out


def cases():
    noise = " ".join(f"n{i}" for i in range(300))
    out = [(None, noise)]
    for k, (_, text) in enumerate(L.TEMPLATES):
        w = text.split()
        out += [(100 + k, text), (200 + k, f"{noise} {text} {noise}"),
                (300 + k, "\n".join("# " + x for x in [noise, text.upper()])),
                (400 + k, " ".join(w[:len(w) // 2])),
                (500 + k, f"{noise} " + " ".join(x if i != 1 else "changed" for i, x in enumerate(w)))]
    return out


def test_templates_are_found(make):
    pairs = [*EDGES, *cases()]
    got = L.scan_documents(make(pairs)).collect()
    want = sorted((i, t) for i, x in pairs for t in brute_force(x))
    assert sorted((r["doc_id"], r["template"]) for r in got) == want
    assert {r["doc_id"] for r in got} >= {200 + k for k in range(len(L.TEMPLATES))}
    for r in got:
        assert r["license"] == L.TEMPLATES[r["template"]][0] and 0.8 <= r["containment"] <= 1
    assert L.scan_documents(make([])).count() == 0


def test_documents(documents):
    rows = documents.select("doc_id", "text").collect()
    want = sorted((r["doc_id"], t) for r in rows for t in brute_force(r["text"]))
    got = L.scan_documents(documents).collect()
    assert want and sorted((r["doc_id"], r["template"]) for r in got) == want


def test_bands_and_bad_templates(spark, documents):
    assert 1 - (1 - 0.4) ** L.bands_needed(0.4, 1, 1e-4) >= 1 - 1e-4
    with pytest.raises(ValueError):
        L.scan_documents(documents, [("x", "too short")])
    with pytest.raises(ValueError):
        L.scan_documents(documents, [("x", "word " * (L.MAX_TEMPLATE_WORDS + 1))])


#: The license-like lines of the supplied documents, copied from them, and their licenses.
LINES = {
    "All rights reserved.": "LicenseRef-All-Rights-Reserved",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_finds_the_lines_of_the_documents(spark, sf):
    from cadenza.llm.queries import op10_license_scan
    rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select(
        "doc_id", "text").collect()
    want = {(r["doc_id"], name) for r in rows for line, name in LINES.items()
            if line in (r["text"] or "").split("\n")}
    got = op10_license_scan(spark, f"/root/testdata/{sf}").collect()
    assert "LicenseRef-All-Rights-Reserved" in {name for _, name in want}
    assert {(r["doc_id"], r["license"]) for r in got} == want


def test_short_notices_are_exact_runs(make):
    short = [("one", "Proprietary"), ("three", "All rights reserved."), ("four", "a b c d")]
    n = len(L.TEMPLATES)
    pairs = [*EDGES, (100, "All rights reserved."), (101, "x (c) ALL\n# RIGHTS -- reserved, all rights reserved"),
             (102, "all rights are reserved"), (103, "all rights"), (104, "reserved."),
             (105, "proprietary"), (106, "z a b c d"), (107, "a b c"), (108, "d all"), (109, "rights reserved")]
    got = L.scan_documents(make(pairs), short=short).collect()
    assert sorted((r["doc_id"], r["license"], r["template"], r["containment"], r["first_word"])
                  for r in got) == [(100, "three", n + 1, 1.0, 0), (101, "three", n + 1, 1.0, 2),
                                    (105, "one", n, 1.0, 0), (106, "four", n + 2, 1.0, 1)]
    for bad in ("", "...", "one two three four five"):
        with pytest.raises(ValueError):
            L.scan_documents(make(pairs), short=[("x", bad)])


def test_no_notice_is_found_in_that_of_another_license():
    groups, short = L.groups_of(L.TEMPLATES, 80), L.short_runs(L.SHORT, len(L.TEMPLATES))
    every = [*L.TEMPLATES, *L.SHORT]
    found = {(d, t) for d, t, _, _ in L.scan(groups, [x for _, x in every], 80, short)}
    assert found >= {(k, k) for k in range(len(every))}
    assert not [(d, t) for d, t in found if every[d][0] != every[t][0]]
