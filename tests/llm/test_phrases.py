import random
import re
from collections import Counter, defaultdict

import numpy as np

from communa.llm import phrases


def naive(docs, least, depth=5, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        often = {p: n for p, n in c.items() if n >= least and len(p) > 1}
        lost = {p[i : i + k] for p, n in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if n >= c[p[i : i + k]]}
        rows = []
        for p, a in often.items():
            if p not in lost:
                score, k = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def run(spark, docs, **kw):
    held = spark.createDataFrame([(t, g, 1, "y", 2) for t, g in docs], "text string, lang string, n long, phrase string, a int").repartition(4)
    return sorted(tuple(r) for r in phrases.collocations(held, **kw).collect())


def corpus(rng, n):
    words = ["a", "B", "the", "é", "x\x1cy", "中文", "Of", "z\x85", "long" * 40, "q"]
    out = []
    for _ in range(n):
        parts = rng.choices([*words, "the quick brown Fox", "quick brown", "new york city", "\t", "  ", ".", ", ", "\n", "a b c d e f g", ";:"], k=rng.randrange(60))
        out.append((" ".join(parts), rng.choice(["en", "en", "de", None, "und"])))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 700)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 64)
    docs = corpus(random.Random(4), 300) + [(None, "en"), ("", None), ("hot phrase here. " * 200, "fr"), ("hot phrase here", "fr")] + [("same copy of a text", "en")] * 60
    want = naive(docs, 10)
    assert run(spark, docs, least=10) == want and len(want) > 200
    assert run(spark, docs, least=10, top=7) == [r for r in want if r[1] <= 7]


def test_scores_beyond_64_bits(spark):
    docs = [("p q " * 100_000 + "r s. " * 5, "en")] * 12
    assert run(spark, docs, least=50) == naive(docs, 50)
    big = spark.createDataFrame([("en", "p q", 2, 10**12)], "lang string, phrase string, words int, a long")
    counts = spark.createDataFrame([("en", "p", 10**13 + 1), ("en", "q", 10**12 + 7)], "lang string, phrase string, n long")
    found = phrases.scored(big, counts, spark.createDataFrame([("en", 3 * 10**14)], "lang string, n long")).first()
    assert found.score == 1000 * 10**12 * 3 * 10**14 // ((10**13 + 1) * (10**12 + 7))


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("one two", "en")]) == []


def test_automaton_is_one():
    """States are the classes of phrases with the same ends, links lead to the longest shorter suffix of another class."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, 300).astype(np.int32)
    got = phrases.Automaton.of(words, 4)
    ends = defaultdict(set)
    for e in range(len(words)):
        for k in range(1, 5):
            w = tuple(words[max(0, e - k + 1) : e + 1].tolist())
            if len(w) == k and 0 not in w:
                ends[w].add(e)
    # suffixes of one another with the same ends are one class
    classes = defaultdict(list)
    for w, e in ends.items():
        classes[frozenset(e)].append(w)
    assert len(got.length) == len(classes)
    for n, link, count, end in zip(got.length, got.link, got.count, got.end, strict=True):
        longest = tuple(words[end - n + 1 : end + 1].tolist())
        assert max(classes[frozenset(ends[longest])], key=len) == longest and count == len(ends[longest])
        shorter = [w for k in range(1, n) if ends[w := longest[n - k :]] != ends[longest]]
        assert (link < 0) == (not shorter)
        if shorter:
            at, m = got.end[link], got.length[link]
            assert tuple(words[at - m + 1 : at + 1].tolist()) == max(shorter, key=len)
    assert {tuple(words[e - k + 1 : e + 1].tolist()): c for k, at, n in got.phrases() for e, c in zip(at, n)} == {w: len(e) for w, e in ends.items()}


def test_filter_holds_what_it_was_given(spark):
    keys = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 9000)
    held = phrases.Bloom.of(spark.createDataFrame([(int(k),) for k in keys[:6000]], "key long").repartition(3))
    assert held.holds(keys[:6000].view(np.uint64)).all() and held.holds(keys[6000:].view(np.uint64)).mean() < 0.1
    words = ["é", "abcdefghijkl" * 9, "w"]
    spark_keys = [r.k for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64('en', w) as k").collect()]
    assert phrases.word_keys("en", [w.encode() for w in words]).view(np.int64).tolist() == spark_keys
