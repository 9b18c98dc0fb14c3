import random
import zlib

import numpy as np

from communa.llm import langid

SYLLABLES = {"aa": "the ing er an on th re ha tion ed".split(), "bb": "der ung sch ein ge ver lich keit zu äu".split(), "cc": "que ción los ar mente ó ñ do es la".split()}


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        out.append((" ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 120))), lang))
    return out


def test_kernel_against_sets():
    sample = corpus(30, 1)
    model = langid.train(sample, landmarks=9)

    def grams(x):
        s = [int(v) for v in model.symbols[[ord(c) for c in f" {x.lower()} "]]]
        s = [v for i, v in enumerate(s) if v or not i or s[i - 1]]
        return {tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {(0,)}

    by = [[x for x, y in sample if y == lang] for lang in model.langs]
    marks = [rows[k] for k in range(3) for rows in by]
    tests = ["The thing, 12 %% is!", "ein äußerst", "中文 и русский", sample[0][0]]
    got = model.kernels(tests)
    want = [[len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5 for b in marks] for a in tests]
    assert np.allclose(got, want, atol=1e-6)


def test_held_out_accuracy(spark):
    rows = [(i, x, y) for i, (x, y) in enumerate(corpus(600, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, ~langid.held_out(), per_lang=60, landmarks=24)
    got = langid.identify(docs, model).withColumn("held_out", langid.held_out()).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 100 and sum(r.lang_pred == rows[r.doc_id][2] for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_documents(odd_docs, no_docs):
    got = langid.identify(odd_docs, langid.fit(odd_docs, ~langid.held_out())).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id is not None:
            lettered = any(map(str.isalpha, texts[r.doc_id] or ""))
            assert (r.lang_pred == "und") == (not lettered) and (r.score > 0) == lettered
    assert langid.identify(no_docs, langid.fit(no_docs)).collect() == []
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.fit(no_docs)).collect()} == {"und"}
