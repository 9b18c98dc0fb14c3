import random

import pytest
import tiktoken

from communa.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("t", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})


def test_replay_matches_single_word_encoder(coder):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aabbcdeèé ñtheon.,'s\n 中文0123") for _ in range(rng.randrange(1, 90))) for _ in range(3000)]
    texts += ["a" * 700, "ab" * 300, "    \n\n  x", "'s't're"]
    codes = bpe.Encoder(bpe.default_path(), bpe.default_pattern()).texts(texts)
    for text, code in zip(texts, codes, strict=True):
        want = coder.encode_ordinary(text)
        assert list(memoryview(code).cast("I")) == want, text


def test_odd_documents(odd_docs, coder):
    rows = bpe.encode(odd_docs).collect()
    want = sorted((str(r.doc_id), tuple(coder.encode_ordinary(r.text or ""))) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in rows) == want
    assert sorted(bytes(r.decoded) for r in rows) == sorted((r.text or "").encode() for r in odd_docs.collect())
    assert sorted(bytes(r.decoded) for r in bpe.decode(bpe.encode(odd_docs)).collect()) == sorted(bytes(r.decoded) for r in rows)


def test_empty_table(no_docs):
    assert bpe.encode(no_docs).collect() == []
