import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from communa.llm import repeats


def naive(texts, length):
    """Per text (bytes removed, runs, what is left)."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        out.append((int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), bytes(b for b, c in zip(t, cover, strict=False) if not c)))
    return out


def made(seed, n=60, alphabet=4):
    rng = random.Random(seed)
    pool = [bytes(rng.randrange(97, 97 + alphabet) for _ in range(rng.randrange(20, 160))) for _ in range(12)]
    out = []
    for _ in range(n):
        t = b"".join(rng.choice(pool) if rng.random() < 0.5 else bytes(rng.randrange(97, 97 + alphabet) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6)))
        if out and rng.random() < 0.4:
            t = bytearray(rng.choice(out) or b"x")
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = 120
            t = bytes(t)
        out.append(t)
    return [*out, b"ab" * 90, b"a" * 300, b"ab" * 50 + b"c" + b"ab" * 40]


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(40):
        strings = [bytes(rng.randrange(2) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 7))]
        got = repeats.RunLengthIndex(strings).statistics()
        all_ = [s[i:] for s in strings for i in range(len(s))]

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        want = [max((common(a, b) for j, b in enumerate(all_) if j != i), default=0) for i, a in enumerate(all_)]
        assert got.tolist() == want, strings


@pytest.mark.parametrize(("crowd", "shard", "piece"), [(1024, 1 << 19, 1 << 19), (1, 1 << 19, 1 << 19), (3, 500, 90), (1024, 1, 1 << 19)])
def test_against_all_windows(spark, monkeypatch, crowd, shard, piece):
    monkeypatch.setattr(repeats, "_PIECE", piece)
    texts = made(crowd + piece)
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(df, 48, 16, crowd, shard).collect()}
    assert [got[i] for i in range(len(texts))] == naive(texts, 48)
    assert sum(r[0] for r in got.values()) > 1000


def test_odd_documents(odd_docs, no_docs):
    rows = odd_docs.collect()
    want = Counter((r.doc_id, hashlib.sha256(x[2]).hexdigest(), *x[:2]) for r, x in zip(rows, naive([(r.text or "").encode() for r in rows], 400), strict=True))
    got = repeats.remove_repeats(odd_docs).collect()
    assert Counter((r.doc_id, hashlib.sha256(bytes(r.kept)).hexdigest(), r.n_removed, r.n_spans) for r in got) == want
    assert sum(r.n_removed for r in got) > 10000
    assert repeats.remove_repeats(no_docs).collect() == []
