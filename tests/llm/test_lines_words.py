import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from communa.llm import lines
from tests.llm.test_lines import copies, naive  # noqa: F401

WORDS = [f"w{i}" for i in range(20)]


def stage_texts(spark, rows):
    """doc_id -> text after the pipeline's stage."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}


def query(spark, tmp_path, rows):
    """doc_id -> (lines, lines removed, digest of the text kept) of op9_lines."""
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in lines.op9_lines(spark, str(tmp_path)).collect()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_one_inner_word_replaced(spark, tmp_path):
    rows = [(0, " ".join(WORDS)), (1, " ".join([*WORDS[:9], "other", *WORDS[10:]])), (2, " ".join([*WORDS[:4], "a", "b", "c", *WORDS[7:]]))]
    assert query(spark, tmp_path, rows) == {0: (1, 0, digest(rows[0][1])), 1: (1, 1, digest("")), 2: (1, 0, digest(rows[2][1]))}
    assert stage_texts(spark, rows) == {0: rows[0][1], 1: "", 2: rows[2][1]}


def test_query_and_stage_are_on_word_sets(spark, tmp_path, copies):  # noqa: F811
    want = {d: t for d, t in naive(copies, least=1, width=1)}
    assert want != {d: t for d, t in naive(copies, least=1, width=5)}
    assert {d: x[2] for d, x in query(spark, tmp_path, copies).items()} == {d: digest(t) for d, t in want.items()}
    assert stage_texts(spark, copies) == want


def test_lines_of_one_and_two_words(spark, tmp_path):
    rows = [(0, "Read more\n\nhttps://example.org/a\n我们今天去公园散步"), (1, "Read more\n\n \nhttps://example.org/a"), (2, "我们今天去公园散步\nread  MORE\nhttps://example.org/b")]
    want = {0: rows[0][1], 1: "\n ", 2: "https://example.org/b"}
    assert query(spark, tmp_path, rows) == {0: (4, 0, digest(want[0])), 1: (4, 2, digest(want[1])), 2: (3, 2, digest(want[2]))}
    assert stage_texts(spark, rows) == want


@pytest.mark.parametrize(("crowd", "buckets"), [(2, 64), (5, 1 << 17), (40, 1 << 10)])
def test_crowded_shingles(spark, copies, crowd, buckets):  # noqa: F811
    """Families of near-copies, one of them a third of all lines: pairs of shingles and parts, with the same result."""
    rng = random.Random(6)
    family = [" ".join([*WORDS[:12], f"x{i}"]) for i in range(120)] + [" ".join([*WORDS[:5], f"y{i % 9}", *WORDS[6:16], f"z{i}"]) for i in range(60)]
    texts = [t for _, t in copies] + family
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lines.dedup_lines(df, shingle=1, least=1, buckets=buckets, crowd=crowd).collect()
    assert {r.doc_id: r.kept_text for r in got} == {d: t for d, t in naive(rows, least=1, width=1)}


def test_order_of_a_group_is_by_document_line_and_parities():
    """One number for each row where it fits one, and a sort by every column where rows are alike or numbers are large: the same order."""
    rng = np.random.default_rng(3)
    for docs, lines_ in ((1000, 50), (3, 2), (1 << 40, 50), (1000, 1 << 20)):
        group = np.sort(rng.integers(0, 40, 600))
        base = np.stack([rng.permutation(600), rng.integers(0, docs, 600), rng.integers(0, lines_, 600) << 32 | 7, rng.integers(-9, 9, 600), rng.integers(-9, 9, 600)], axis=1)
        want = sorted(range(600), key=lambda i: (group[i], base[i, 1], base[i, 2] >> 32, base[i, 3], base[i, 4]))
        assert lines._in_order(group, base)[:600].tolist() == want


def test_counts_of_a_task_come_in_blocks(spark):
    """A task sends its counters in rows of a block, not a row for each counter, and the codes are those of the counts."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 50 + 1))) for i in range(400)], "doc_id long, text string").repartition(4)
    codes = lines.rarity(docs, 1 << 14, 1, 1)
    total = np.zeros(1 << 14, np.int64)
    for r in docs.collect():
        for _, _, size, words in lines.Shingles(1, 1).lines([r["text"].encode()]):
            np.add.at(total, (lines.Shingles(1, 1).hashes(size, words)[1] & np.uint64((1 << 14) - 1)).astype(np.int64), 1)
    assert codes.tolist() == [lines._code(n) if n else 0 for n in total.tolist()]
