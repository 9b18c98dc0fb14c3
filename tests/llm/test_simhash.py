import random
import re

import numpy as np
import pytest
import xxhash

from communa.llm import simhash


def naive(text, n=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(rows, bits=3):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f, least.get(find(i))) for i, (d, f) in enumerate(rows)), key=str)


@pytest.mark.parametrize("bucket", [simhash.BUCKET_ROWS, 2])
def test_odd_documents(odd_docs, bucket):
    got = simhash.near_duplicates(odd_docs, shingle_words=3, bucket_rows=bucket).collect()
    rows = [(r.doc_id, naive(r.text)) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("bucket", [simhash.BUCKET_ROWS, 3])
def test_links_of_crowded_keys(spark, bucket):
    rng = random.Random(3)
    fps = {0}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    rows = list(enumerate(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges = simhash.links(df, bucket_rows=bucket).collect()
    assert all((e.u ^ e.v) % 2**64 == 0 or ((e.u ^ e.v) % 2**64).bit_count() <= 3 for e in edges)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[find(e.u % 2**64)] = find(e.v % 2**64)
    mine = {}
    for d, f in rows:
        mine.setdefault(find(f), []).append(d)
    assert sorted(((d, f, min(mine[find(f)])) for d, f in rows), key=str) == brute(rows)


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
