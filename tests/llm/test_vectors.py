import duckdb
import numpy as np
import pytest

from communa.llm import queries, vectors

SF = "/root/testdata/sf0.01"


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        score = [(-float(np.einsum("i,i->", x[i], y)), int(j)) for j, y in zip(ids, x, strict=True) if j != ids[i]]
        out.setdefault(int(ids[i]), []).extend(sorted(score)[:k])
    return out


def rows(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], np.float64)
    got = rows(vectors.neighbours(df, df.filter("vec_id % 20 = 0")))
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    assert set(got) == set(want)
    hit = [len({v for _, v, _ in got[q]} & {v for _, v in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.95
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(abs(s - x[list(ids).index(q)] @ x[list(ids).index(v)]) < 1e-12 for _, v, s in found)


def test_error_bounds_choose_well():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((5000, 48)), rng.standard_normal((40, 48))
    book = vectors.codebook(x[:800])
    got = vectors.search_block(np.arange(5000), x, *book.encode(x), -1 - np.arange(40), q, book, 10)
    best = set(zip(got[0].tolist(), got[1].tolist(), strict=True))
    want = {(-1 - i, int(j)) for i in range(40) for j in np.argsort(-(q[i] @ x.T))[:10]}
    assert len(best & want) / len(want) > 0.97


@pytest.mark.parametrize("block", [vectors.BLOCK_ROWS, 7])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    same = [1.0, 2.0, 0.0]
    data = [(i, same) for i in range(30)] + [(30, [0.0] * 3), (31, None), (32, [1.0, None, 2.0]), (33, [float("nan"), 1.0, 1.0]), (34, [float("inf"), 1.0, 1.0]), (None, same), (36, [1.0, 2.0]), (40, [5.0, 5.0, 5.0]), (41, [-1.0, 0.5, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in data], "vec_id long, embedding array<double>, cell int, query string, score double")
    got = rows(vectors.neighbours(df, df.filter("vec_id % 20 = 0")))
    assert set(got) == {0, 20, 40}
    assert [v for _, v, _ in got[0]] == [40, *range(1, 20)]
    assert [v for _, v, _ in got[20]] == [40, *range(19)]
    assert [v for _, v, _ in got[40]] == list(range(20)) and got[40][0] == (1, 0, 15.0)
    assert vectors.neighbours(df.limit(0)).collect() == []
    two = df.filter("vec_id in (0, 40)")
    assert rows(vectors.neighbours(two)) == {0: [(1, 40, 15.0)], 40: [(1, 0, 15.0)]}


def test_recall_at_another_size(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], np.float64)
    got, want = rows(vectors.neighbours(df, df.filter("vec_id % 20 = 0"))), brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    recall = np.mean([len({v for _, v, _ in got[q]} & {v for _, v in want[q]}) / 20 for q in want])
    print("rows", len(ids), "recall", recall)
    assert set(got) == set(want) and recall >= 0.95


@pytest.mark.parametrize("d", [3, 64, 100, 130])
def test_estimates_from_packed_bits(d):
    """Counts over planes of bits are the inner products of codes with the rounded query."""
    rng = np.random.default_rng(d)
    x, q = rng.standard_normal((50, d)), rng.standard_normal(d)
    book = vectors.codebook(x)
    bits, length, fit = book.encode(x)
    turned = q @ book.rotation
    low, step = turned.min(), (turned.max() - turned.min()) / (2**vectors.QUERY_BITS - 1)
    rounded = low + step * np.round((turned - low) / step)
    signs = np.unpackbits(bits, axis=1, count=d) * 2.0 - 1
    want = signs @ rounded * length / fit / np.sqrt(d)
    assert np.allclose(vectors.Block(np.arange(50), x, bits, length, fit).estimates(turned), want)


def test_a_query_whose_id_repeats_is_asked_once(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(60)]
    rows += [rows[20], rows[20], (40, rows[7][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    (tmp_path / "embeddings").mkdir()
    found = vectors.op7_vectors(spark, str(tmp_path)).collect()
    for q in (0, 20, 40):
        own = sorted((r["rank"], r.vec_id) for r in found if r.query_id == q)
        assert [k for k, _ in own] == list(range(1, 21)) and q not in {v for _, v in own}
        assert len({v for _, v in own}) >= 18  # but for candidates that repeat
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(a, b, c) for a, b, c, _ in con.sql(queries.oracle_sql()["op7_vectors"]).fetchall()}
    assert {(r.query_id, r["rank"], r.vec_id) for r in found} == want and len(found) == 60
