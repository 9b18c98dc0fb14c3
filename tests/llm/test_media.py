import random

import numpy as np

from communa.llm import media


def test_round_trip(odd_docs):
    rows = media.features(media.store(odd_docs)).collect()
    want = sorted(media.padded((r.text or "").encode()) for r in odd_docs.collect())
    assert sorted(bytes(r.payload) for r in rows) == want
    assert all(len(p) % 64 == 0 and p for p in want)


def test_chunks_do_not_show(monkeypatch):
    rng = random.Random(2)
    x = bytes(rng.randrange(256) for _ in range(40000))
    whole = media.peaks(x)
    monkeypatch.setattr(media, "_CHUNK", 7)
    assert all((a == b).all() for a, b in zip(whole, media.peaks(x), strict=True))


def test_pairs_against_loops():
    rng = random.Random(5)
    x = (128 + 90 * np.sin(np.arange(9000) * 0.3) * np.sin(np.arange(9000) * 0.01)).astype(np.uint8).tobytes() + bytes(rng.randrange(256) for _ in range(2000))
    t, f = media.peaks(x)
    want = []
    for i in range(len(t)):
        later = [j for j in range(len(t)) if t[j] > t[i]][: media.FAN]
        want += [int(t[i]) << 32 | int(f[i]) << 20 | int(f[j]) << 8 | int(t[j] - t[i]) for j in later if t[j] - t[i] <= media.REACH]
    assert media.pairs(t, f).tolist() == sorted(want) and len(want) > 50


def test_empty_table(no_docs):
    assert media.features(media.store(no_docs)).collect() == []
