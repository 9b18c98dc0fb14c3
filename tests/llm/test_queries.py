"""Each query against its contract, naively, on the smallest tables; and against SQL where there is some."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from communa.llm import bpe, chat, langid, media, packing, queries, secrets
from tests.llm.test_filters import naive as naive_filters
from tests.llm.test_lines import naive as naive_lines
from tests.llm.test_neardup import naive as naive_links
from tests.llm.test_phrases import naive as naive_phrases
from tests.llm.test_repeats import naive as naive_repeats
from tests.llm.test_secrets import naive as naive_secrets
from tests.llm.test_simhash import brute as brute_links, naive as naive_fingerprint
from tests.llm.test_vectors import brute as brute_neighbours
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    df = queries.queries()[name](spark, SF)
    return df.dtypes, df.collect()


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.queries()} <= names and sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    compare(spark, connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name])


def test_op1(spark, texts):
    dtypes, rows = run(spark, "op1_simhash")
    assert dtypes[:3] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows) == sorted(brute_links([(d, naive_fingerprint(t)) for d, t in texts.items()]))
    assert all(len(r.fingerprint) == 16 == len(r.fingerprint.lower()) for r in rows)


def test_op2(spark, texts):
    dtypes, rows = run(spark, "op2_repeats")
    assert dtypes[:5] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    want = dict(zip(texts, naive_repeats([t.encode() for t in texts.values()], 400), strict=True))
    assert len(rows) == len(texts) and sum(r.n_removed for r in rows) > 0
    for r in rows:
        raw, (removed, number, kept) = texts[r.doc_id].encode(), want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), removed, number, sha(kept))
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]
        ends = [0, *(x for s in spans for x in s), len(raw)]
        pieces = [raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]
        assert b"".join(pieces) == kept and len(spans) == number and r.text == "".join(p.decode("utf-8", "ignore") for p in pieces)


def test_op3(spark):
    dtypes, rows = run(spark, "op3_langid")
    assert dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    learned = {r.lang for r in docs.values() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    tested = [r for r in rows if r.held_out and docs[r.doc_id].lang and any(map(str.isalpha, docs[r.doc_id].text or ""))]
    for r in rows:
        text = docs[r.doc_id].text or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred in learned if any(map(str.isalpha, text)) else r.lang_pred == "und"
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in tested)
    print("held out", len(tested), "right", right)
    assert len(tested) > 30 and right >= 0.95 * len(tested)


def test_op3_learns_from_no_held_out_row(spark, tmp_path):
    """Other languages of held-out rows change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 3 = 1, 'xx', lang) as lang", "'s' as source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    other = {(r.doc_id, r.lang_pred, r.score) for r in langid.op3_langid(spark, str(tmp_path)).collect()}
    assert other == {(r.doc_id, r.lang_pred, r.score) for r in run(spark, "op3_langid")[1]}


def test_op4(spark, texts):
    dtypes, rows = run(spark, "op4_bpe")
    assert dtypes[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    coder = tiktoken.Encoding("t", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})
    assert len(rows) == len(texts)
    for r in rows:
        ids = coder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[r.doc_id].encode()))


def test_op5(spark):
    sf = SF.replace("0.001", "0.01")  # the smallest tables hold no secrets
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    df = queries.queries()["op5_secrets"](spark, sf)
    dtypes, rows = df.dtypes, df.collect()
    assert dtypes[:6] == [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    model = secrets.fit(docs)
    kinds = ["assign", "access", "hex", "random"]
    said = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        base, added = naive_secrets(texts[r.doc_id], model)
        number = Counter(k for _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (number[0], number[1], number[2])
        assert r.base_sha256 == sha(said(base).encode()) and r.spans == said(sorted(base + added))


def test_op6(spark, texts):
    dtypes, rows = run(spark, "op6_packing")
    assert dtypes[:7] == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    tok = Tokenizer.from_file(packing.default_path())
    tok.encode_special_tokens = True
    want, bins = Counter(), defaultdict(list)
    for d, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), 2048):
            want[d, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        ends = np.cumsum([n for _, n in sorted(x)])
        assert [a for a, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 2048
    counts = Counter(n for x in bins.values() for _, n in x)
    assert packing.lower_bound(counts, 2048) <= len(bins) <= sum(c for _, c in packing.best_fit(counts, 2048))


def test_op7(spark):
    dtypes, rows = run(spark, "op7_vectors")
    assert dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    data = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], np.float64)
    want = brute_neighbours(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want) and all([k for k, _, _ in v] == list(range(1, 21)) for v in got.values())
    assert np.mean([len({v for _, v, _ in got[q]} & {v for _, v in want[q]}) / 20 for q in want]) >= 0.95
    exact = {(q, v): -s for q in want for s, v in want[q]}
    assert all(abs(exact[q, v] - s) < 1e-12 for q in got for _, v, s in got[q] if (q, v) in exact)


def test_op8(spark, texts):
    dtypes, rows = run(spark, "op8_media")
    assert dtypes[:8] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
    assert len(rows) == len(texts)
    same = defaultdict(set)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        wav = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), sha(wav))
        t, f = media.peaks(payload)
        code = media.pairs(t, f).tolist()
        assert r.times == t.tolist() and r.pairs == code
        assert r.feature == f"{len(t)}:{len(code)}:{sha(','.join(f'{x:X}' for x in code).encode())}"
        same[raw].add(str(r[1:]))
    assert all(len(x) == 1 for x in same.values())


def test_op9(spark, texts):
    rows = run(spark, "op9_lines")[1]
    want = {d: t for d, t in naive_lines(list(texts.items()), least=1, width=1)}
    for r in rows:
        assert r.kept_sha256 == sha(want[r.doc_id].encode()) and r.n_lines == texts[r.doc_id].count("\n") + 1
    assert len(rows) == len(texts) and sum(r.n_removed for r in rows) > 0


def test_op10(spark):
    rows = run(spark, "op10_chat")[1]
    talks = spark.read.parquet(f"{SF}/conversations.parquet")
    want = {r.conv_id: sum(len(x.lines) for x in r.all) for r in chat.as_transcripts(talks).groupBy("conv_id").agg({"*": "count"}).select("conv_id").join(
        chat.as_transcripts(talks).selectExpr("conv_id", "struct(lines) as s").groupBy("conv_id").agg({"s": "collect_list"}).toDF("conv_id", "all"), "conv_id").collect()}
    got = Counter()
    for r in rows:
        got[r.conv_id] += r.n_lines
        assert r.held_out == (zlib.crc32(str(r.conv_id).encode()) % 3 == 1) and r.n_turns == len([x for x in r.roles.split(",") if x])
    assert got == want
    lines, right = (sum(r[c] for r in rows if r.held_out) for c in ("n_lines", "n_right"))
    print("held-out lines", lines, "right", right)
    assert right >= 0.95 * lines > 0


def test_op11(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = run(spark, "op11_filters")[1]
    assert sorted(map(tuple, rows)) == naive_filters([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_op12(spark):
    rows = run(spark, "op12_embeddings")[1]
    assert sorted((tuple(r) for r in rows), key=str) == naive_links([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_op13(spark):
    dtypes, rows = run(spark, "op13_phrases")
    assert dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
    assert sorted(map(tuple, rows)) == naive_phrases([(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 100)


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    found = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    key = lambda r: r[:5]
    assert sorted(map(key, found)) == sorted(key(tuple(r)) for r in docs.collect()) and len(found) > 100


def test_null_and_empty_tables(spark, tmp_path):
    """No query falls over a table without rows, or of null texts and ids."""
    rng = random.Random(1)
    for k, rows in enumerate(([], [(None, None, None, None, None), (1, None, "en", "a", 0), (1, None, "en", "a", 0), (None, "word " * 9, None, None, None), (3, "\n", "de", "a", 1)])):
        sf = tmp_path / str(k)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(sf / "documents.parquet"))
        vectors = [] if not rows else [(None, [1.0], 1), (20, None, 1), (40, [0.0, 0.0], None), (60, [rng.random(), 1.0], 2)]
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(sf / "embeddings.parquet"))
        spark.createDataFrame([] if not rows else [(1, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
        talks = [] if not rows else [(None, None, None, None), (1, None, None, None), (1, None, None, None), (2, 0, "user", "")]
        spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(str(sf / "conversations.parquet"))
        for name, f in {**queries.queries(), "pipeline": corpus_pipeline.run}.items():
            number = f(spark, str(sf)).count()
            if name == "op11_filters" and rows:
                assert number == 600 * 3
            elif name == "op12_embeddings":
                assert number == len(vectors)
            elif name not in ("op7_vectors", "op10_chat", "op11_filters", "op13_phrases", "pipeline"):
                assert number == len(rows), name
            elif not rows:
                assert number == 0, name
