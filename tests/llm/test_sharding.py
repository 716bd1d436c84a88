import zlib

from llm_cases import EDGES, documents, make  # noqa: F401
from cadenza.llm import sharding as S


def check(rows, pairs, shards=S.SHARDS):
    assert len(rows) == len(pairs)
    want = sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
                  for i, t in pairs)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == want
    load = {}
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        load.setdefault(r["shard"], []).append(r)
    for own in load.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    size = [sum(r["size"] for r in load.get(k, [])) for k in range(shards)]
    assert max(size) - min(size) <= 2 * max(r["size"] for r in rows)


def test_edges_and_copies(make):
    copies = [(1000 + i, "the same text again and again") for i in range(900)]
    other = [(5000 + i, f"text {i} " * (i % 50)) for i in range(900)]
    pairs = [*EDGES[:8], *EDGES[10:], *copies, *other, (77, "twice"), (77, "twice")]
    rows = S.shard_documents(make(pairs)).collect()
    check(rows, pairs)
    place = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    hit = sorted(place[1000 + i][0] for i in range(900))
    assert len(set(hit)) <= hit[-1] - hit[0] + 1  # equal texts fill a run of shards


def test_empty_and_single(make):
    assert S.shard_documents(make([])).count() == 0
    check(S.shard_documents(make([(1, "x")])).collect(), [(1, "x")])


def test_overfull_ranges_are_subdivided(make):
    pairs = [(i, "hot") for i in range(3000)]
    slim = S._slim(make(pairs)).checkpoint()
    bounds = S.splitters(slim, 50, 3000 * 19, draws=2)
    sizes = slim.groupBy(S._range_of(bounds).alias("r")).count().collect()
    assert max(r["count"] for r in sizes) <= 2 * 3000 / 50 + 1


def test_documents(documents):
    rows = documents.select("doc_id", "text").collect()
    check(S.shard_documents(documents).collect(), [(r["doc_id"], r["text"]) for r in rows])
