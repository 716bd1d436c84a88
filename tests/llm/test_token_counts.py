import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from llm_cases import EDGES, documents, make  # noqa: F401
from cadenza.llm import token_counts as T


def library(vocab, byte_fallback=True):
    tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))
    tok.pre_tokenizer = pre_tokenizers.Metaspace()
    return tok


def texts(n):
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "é", "日", "▁", "the", "ing", "<s>", "<0x0A>", "x", "1", "😀"]
    return ["", " ", "  "] + ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(n)]


def test_counts_match_the_library(make):
    vocab = T.pieces()
    tok = library(vocab)
    pairs = [*EDGES, *[(100 + i, t) for i, t in enumerate(texts(800))]]
    want = sorted((i or -1, len(e.ids)) for (i, _), e in zip(pairs, tok.encode_batch(
        [t or "" for _, t in pairs], add_special_tokens=False), strict=True))
    got = T.token_counts(make(pairs)).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == want
    assert T.token_counts(make([])).count() == 0


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_ties_and_unknown_runs(byte_fallback):
    vocab = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("b", -2.0), ("ab", -3.0),
             ("▁a", -2.0), ("aab", -5.0), ("▁the", -2.5), ("t", -3.0)]
    if byte_fallback:
        vocab += [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    tok, counter = library(vocab, byte_fallback), T.Counter(vocab)
    rng = random.Random(4)
    for _ in range(1500):
        t = "".join(rng.choices(["a", "b", "t", "the", "é", "日", " ", "zz"], k=rng.randint(0, 12)))
        assert T.count_texts(counter, [t])[0][0] == len(
            tok.encode(t, add_special_tokens=False).ids), t


def test_score_is_the_best(make):
    vocab = T.pieces()
    own = dict(vocab)
    counter = T.Counter(vocab)
    for t in ("hello world", "the theme", "xyzzy"):
        ids = library(vocab).encode(t, add_special_tokens=False).tokens
        if all(x in own and not x.startswith("<0x") for x in ids):
            assert T.count_texts(counter, [t])[1][0] == sum(own[x] for x in ids)


def test_documents(documents):
    rows = documents.select("doc_id", "text").collect()
    want = {r["doc_id"]: len(e.ids) for r, e in zip(rows, library(T.pieces()).encode_batch(
        [r["text"] or "" for r in rows], add_special_tokens=False), strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in T.token_counts(documents).collect()} == want
