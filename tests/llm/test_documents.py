import random

import pytest

import corpus_pipeline
from communa.llm import simhash
from tests.llm.test_lines import shingles


def jaccard(a, b):
    a, b = shingles(a, 5), shingles(b, 5)
    return len(a & b) / len(a | b)


def naive(rows):
    """rows of (doc_id, text), doc_ids distinct and not null -> those that match none before."""
    rows = sorted(rows)
    sets = [shingles(t or "", 5) for _, t in rows]
    return [r for i, r in enumerate(rows) if not any(len(sets[i] & x) * 5 >= len(sets[i] | x) * 4 for x in sets[:i])]


def changed(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(1 << 30)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def pairs():
    """(copies, least similarity) -> pairs of texts of 200 words of about so much similarity."""
    rng, out = random.Random(5), {}
    for level, n in ((0.95, 1), (0.9, 2), (0.8, 4)):
        out[level] = []
        while len(out[level]) < 25:
            text = "\n".join(" ".join(f"w{rng.randrange(400)}" for _ in range(40)) for _ in range(5))
            other = changed(rng, text, n)
            if level <= jaccard(text, other) < level + 0.05:
                out[level].append((text, other))
    return out


def test_all_pairs_are_found(spark, pairs):
    texts = [x for found in pairs.values() for pair in found for x in pair]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.dedup_documents(spark, df, "").collect()}
    assert got == set(range(0, len(texts), 2))
    met = {k: sum((simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)).bit_count() <= 3 for a, b in found) for k, found in pairs.items()}
    print("pairs of 25 linked at 3 bits of SimHash:", met)


def test_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.6:
            text = changed(rng, rng.choice(rows)[1], rng.randrange(3))
        else:
            text = " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([4, 6, 20, 60, 120])))
        rows.append((i, text))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = naive(rows)
    assert 20 < len(want) < 140
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_documents(spark, df, "").collect()) == want


def test_nulls_and_repeats(spark):
    rows = [(3, "One two\nthree"), (3, "One two\nthree"), (4, "one TWO three"), (None, "one two three"), (None, "other"), (None, "other"), (5, None), (2, ""), (None, " \t"), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = corpus_pipeline.dedup_documents(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == [(2, ""), (3, "One two\nthree"), (None, "other")]


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    assert corpus_pipeline.dedup_documents(spark, no_docs, "").collect() == []
    got = corpus_pipeline.dedup_documents(spark, odd_docs, "").collect()
    assert sorted(r.doc_id for r in got) == [0, 3, 6, 7, 9, 12, 13, 14]


def test_simhash_links_are_checked_and_settle_first(spark, monkeypatch):
    """Documents that SimHash links and an exact check confirms are not asked for in the join; linked ones that don't match stay."""
    from communa.llm import lines

    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(400)}" for _ in range(400))
    rows = [(1, text), (2, text.replace(" ", "  ") + " end"), (3, " ".join(f"w{rng.randrange(400)}" for _ in range(400)))]
    asked, known = [], []
    candidates, settled = lines._candidates, lines._known
    monkeypatch.setattr(lines, "_candidates", lambda rows, *a: (asked.append(rows.filter("asked").select("sid").distinct().count()), candidates(rows, *a))[1])
    monkeypatch.setattr(lines, "_known", lambda docs, told, *a: (known.append({tuple(r) for r in told.collect()}), settled(docs, told.union(spark.createDataFrame([(3, 1)], "doc long, earlier long")), *a))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, df, "").collect()) == [1, 3]
    assert known == [{(2, 1)}] and asked[0] == 2
