import random
import re
from itertools import permutations

from communa.llm import filters


def naive(docs, labels):
    """Rows (doc_id, text, lang) and (doc_id, quality, toxic) -> rows of SCHEMA."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    failing = []
    for d, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = d is not None and any(o is not None and o < d and (t or "") == text for o, t, _ in docs)
        failing.append((d, lang or "", {k for k, v in fails.items() if v}))
    out = []
    for part in {p for _, p, _ in failing}:
        rows, sums = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [(d, f) for d, p, f in failing if p == part]
            whole = left
            for step, name in enumerate(order, 1):
                now, left = [x for x in left if name in x[1]], [x for x in left if name not in x[1]]
                sums[name] += len(now)
                redundant = sum(name in f for _, f in whole) - len(now)
                rows.append((part, "".join(order), step, name, len(left), len(now), redundant, sum(f == {name} for _, f in whole), sum(d in good for d, _ in now), sum(d in toxic for d, _ in now)))
        out += [(*r, sums[r[3]]) for r in rows]
    return sorted(out)


def run(spark, docs, labels):
    held = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, part string, mask int").repartition(5)
    return sorted(tuple(r) for r in filters.audit(held, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filters, "HELD_BYTES", 2000)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    long = [" ".join(rng.sample(words, 250)), " ".join(rng.choices(words[:20], k=300)), "A" * 30 + " x" * 400, "\x1c \x0b\x85 é" * 90]
    texts = [*long, "", None, "#", "One Two", "one | two", *[" ".join(rng.choices(words, k=rng.randrange(190, 400))) + rng.choice(["", "%"]) for _ in range(20)]]
    docs = [(rng.randrange(60), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)] + [(d, long[0], "en") for d in range(100, 180)] + [(None, long[0], None), (None, None, None), (3, long[0], "en"), (3, long[0], "en")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 170, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    assert run(spark, docs, labels) == naive(docs, labels)


def test_very_long_empty_and_no_rows(spark, no_docs):
    huge = "word " * 400_000
    docs = [(1, huge, "en"), (2, huge, "en"), (3, huge + "x", "en")]
    found = {r[1:4]: r for r in run(spark, docs, [(2, 1, 1)])}
    assert found["EABCD", 1, "E"][4:] == (2, 1, 0, 0, 1, 1, found["EABCD", 1, "E"][-1]) and len(found) == 600
    assert filters.audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_equal_fingerprints_are_told_apart():
    chains = filters.Chains()
    out = [x for raw, number in ((b"a", 5), (b"b", 3), (b"a", 4), (b"b", 9), (b"a", 4)) for x in chains.add(7, raw, number, {("", 0): 1})]
    assert out == [(5, {("", 0): 1}), (9, {("", 0): 1})] and chains.of[7] == [[b"a", 4, {("", 0): 2}], [b"b", 3, {("", 0): 1}]]
