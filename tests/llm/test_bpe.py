import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_cases import EDGES, make  # noqa: F401
from cadenza.llm import bpe

HARD = ["", "it's we'll they've I'm 's'tall ''s 're \n's  's\t'd", "  a  b\n\n c \t d   ",
        "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>\n", "a" * 999,
        "日本語 テキスト 漢字123４５Ⅷ²  x", "!!!???'''s 'S 'LL don't", "  x 　y z",
        "😀😀👩‍👩‍👧 é", "x'", "'", "'l", "a'l", "a'll", " 'll", "12'34's", "\x1c\x1d a\x85b",
        "     ", "     a", "\n\n\n", "=" * 200, "aaa" + " " + "the" * 7, "x" * 70_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(bpe.DEFAULT_PATH)


def same(vocab, library, texts):
    ids, at, word_at, _ = bpe.encode_texts(vocab, texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == want[i], t[:80]
    assert word_at[-1] == len(ids)


def test_hard_texts(vocab, library):
    rng = random.Random(1)
    parts = ["a", "'", "s", "t", "l", "e", "r", "v", " ", "  ", "\n", "1", "é", "!", ".",
             "<|endoftext|>", "日", "the", "ing"]
    same(vocab, library, HARD + ["".join(rng.choices(parts, k=rng.randint(0, 30)))
                                 for _ in range(3000)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_texts(texts):
    same(bpe.vocabulary(bpe.DEFAULT_PATH),
         Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), texts)


def test_pairs_against_exact_merging(vocab):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50256, (2, 4000))
    got = bpe.compatible(vocab, a, b)
    want = [bpe.merge_exactly(vocab, vocab.bytes[x] + vocab.bytes[y]) == [x, y]
            for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert got.tolist() == want


def test_rows_against_exact_merging(vocab):
    words = [("ab" * n + "the" * (n % 7)).encode() for n in range(1, 40)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    ids, n = bpe.exact_words(vocab, data, ends - [len(w) for w in words], ends)
    want = [bpe.merge_exactly(vocab, w) for w in words]
    assert ids.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]


def test_documents(make, library):
    pairs = [*EDGES, *[(100 + i, t) for i, t in enumerate(HARD)]]
    want = sorted((i or -1, len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode())
                   .hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False)
                                                .encode()).hexdigest())
                  for (i, _), e in zip(pairs, library.encode_batch(
                      [t or "" for _, t in pairs], add_special_tokens=False), strict=True))
    got = bpe.round_trip_digests(make(pairs)).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                  for r in got) == want
    assert bpe.round_trip_digests(make([])).count() == 0
    two = bpe.decode(bpe.encode(make(pairs))).collect()
    assert sorted(map(str, two)) == sorted(map(str, bpe.round_trip(make(pairs)).collect()))


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([(1, [50256, 99999999, -1, None]), (2, None), (3, [157])],
                               "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(df).collect()}
    assert got == {1: "<|endoftext|>", 2: "", 3: "�"}


def test_slices_bound_a_batch():
    import pyarrow as pa
    runs = list(bpe.slices(pa.array(["ab", "c", "", "defgh", "i"]), 3))
    assert runs == [(0, ["ab", "c", ""]), (3, ["defgh"]), (4, ["i"])]
