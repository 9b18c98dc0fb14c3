import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from communa.llm import langid, packing, secrets, simhash
from tests.llm.test_documents import naive as naive_documents
from tests.llm.test_lines import naive as naive_lines
from tests.llm.test_secrets import naive as naive_secrets

SF = "/root/testdata/sf0.001"


def ordered(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def masked(text, model):
    base, added = naive_secrets(text, model)
    out, at = [], 0
    for start, _, end in sorted(base + added):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(9001, "The there thing, password: hunter22hunter and so on.", "en", "src0", 10), (9002, "9%", "en", "src0", 2)], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "documents", "secrets", "packing"]

    got = stages["language"](spark, docs, SF).cache()
    rows = ordered(docs)
    lang, score = langid.fit(docs).predict([t for _, t in rows])
    assert ordered(got) == [r for r, y, s in zip(rows, lang, score, strict=True) if y != "und" and s >= corpus_pipeline.LEAST_SCORE]
    assert got.columns == docs.columns and got.count() > 190

    rows, got = ordered(got), stages["lines"](spark, got, SF).cache()
    assert Counter(ordered(got)) == naive_lines(rows, least=1, width=1) and got.columns == docs.columns
    assert got.filter("n_chars <> length(text)").count() == 0

    rows, got = ordered(got), stages["documents"](spark, got, SF).cache()
    assert ordered(got) == naive_documents(rows) and got.columns == docs.columns

    rows, model, got = ordered(got), secrets.fit(got), stages["secrets"](spark, got, SF).cache()
    assert ordered(got) == [(d, masked(t, model)) for d, t in rows] and got.columns == docs.columns
    assert any(a != b for a, b in zip(rows, ordered(got), strict=True))

    rows, found = ordered(got), stages["packing"](spark, got, SF).collect()
    tok = Tokenizer.from_file(packing.default_path())
    tok.encode_special_tokens = True
    want = Counter()
    for d, t in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), 2048):
            part = ids[i : i + 2048]
            want[d, i // 2048, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(a[0] + a[1] == b[0] for x in bins.values() for a, b in zip(sorted(x), sorted(x)[1:], strict=False))
    assert all(min(x)[0] == 0 and sum(n for _, n in x) <= 2048 for x in bins.values())


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        got = docs
        for name, stage in corpus_pipeline.STAGES:
            before, got = got, stage(spark, got, SF).cache()
            if name != "packing":
                assert got.columns == docs.columns and got.count() <= before.count()
        assert (got.count() > 0) == (docs is odd_docs)


#: Names that helper columns of some operator have or had.
CLASHES = ["score", "lang_pred", "row", "_rid", "_kept", "rid", "rid2", "kept", "_id", "_n", "_text", "id", "n", "a", "b", "_t", "_base", "_added", "_judged", "_spans", "_heads", "t", "base", "judged", "spans", "heads", "key", "sid", "at", "salt"]


def test_clashing_columns_pass_through(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *(f"{c} of {r.doc_id}" for c in CLASHES)) for r in rows], schema)
    got = docs
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, SF).cache()
        assert got.count() > 20
        if name != "packing":
            assert got.columns == docs.columns
            assert all(r[c] == f"{c} of {r.doc_id}" for r in got.collect() for c in CLASHES), name
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) > 20 and all(r[c] == f"{c} of {r.doc_id}" for r in kept for c in CLASHES)
