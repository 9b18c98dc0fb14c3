import random
from collections import Counter
from fractions import Fraction

import pytest

from communa.llm import lines


def shingles(line, width):
    words = line.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def naive(rows, least=3, width=5):
    """rows of (doc_id, text) -> kept text of each, by comparing each line with all before it."""
    last = 1 << 70
    todo = sorted({(d if d is not None else last, t) for d, t in rows if t is not None}, key=lambda x: x[0])
    before, out = [], {}
    for d, t in todo:
        left = []
        for line in t.encode().split(b"\n"):
            if len(line.split()) < least:
                left.append(line)
                continue
            words = shingles(line, width)
            if not any(len(words & b) * 5 >= len(words | b) * 4 for b in before):
                left.append(line)
            before.append(words)
        out[d, t] = b"\n".join(left).decode()
    return Counter((d, None if t is None else out[d if d is not None else last, t]) for d, t in rows)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 6
    made, rows = [], []
    for i in range(160):
        text = []
        for _ in range(rng.randrange(1, 6)):
            if made and rng.random() < 0.5:
                words = list(rng.choice(made))
                for _ in range(rng.randrange(3)):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            else:
                words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 9, 14, 30]))]
            made.append(words)
            text.append(" ".join(words))
        made = made[-40:]
        text += [""] * (i % 3 == 0)
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize(("buckets", "leaders", "width"), [(1 << 17, 2, 5), (64, 1, 1), (1 << 17, 2, 2), (1 << 17, 1, 1)])
def test_against_all_pairs(spark, copies, buckets, leaders, width, monkeypatch):
    monkeypatch.setattr(lines, "LEADERS", leaders)
    monkeypatch.setattr(lines, "_AT_ONCE", 100)
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    got = lines.dedup_lines(df, shingle=width, buckets=buckets).collect()
    assert Counter((r.doc_id, r.kept_text) for r in got) == naive(copies, width=width)
    assert sum(r.n_removed for r in got) > 50


def test_odd_documents(odd_docs, no_docs):
    got = lines.dedup_lines(odd_docs).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter((r.doc_id, r.kept_text) for r in got) == naive(rows)
    assert lines.dedup_lines(no_docs).collect() == []


def test_threshold_is_exact(spark):
    df = spark.createDataFrame([(0, "a b c d"), (1, "a b c d e"), (2, "a b c d e f g")], "doc_id long, text string")
    assert [r.kept_text for r in lines.dedup_lines(df, shingle=1).orderBy("doc_id").collect()] == ["a b c d", "", "a b c d e f g"]
    assert [r.kept_text for r in lines.dedup_lines(df, Fraction(5, 7), shingle=1).orderBy("doc_id").collect()] == ["a b c d", "", ""]
