import math

import numpy as np

from communa.llm import neardup


def naive(rows, threshold=0.9):
    """(vec_id, vector or None) -> (vec_id, n_links, component_id, kept)."""
    most = max((len(v) for i, v in rows if i is not None and v), key=lambda n: (sum(len(v or ()) == n for _, v in rows), n), default=0)
    able = [k for k, (i, v) in enumerate(rows) if i is not None and v and len(v) == most and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    if able:
        x = np.array([rows[k][1] for k in able], np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                near[able[a]].add(able[b])
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        low = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((i, len(near[k]), low, i == low))
    return sorted(out, key=str)


def run(spark, rows):
    held = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, cls string").repartition(3)
    return sorted((tuple(r) for r in neardup.near_duplicates(held).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 60)
    monkeypatch.setattr(neardup, "TILE_ROWS", 16)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 40)) * np.geomspace(3, 0.1, 40)
    x = [c + rng.standard_normal(40) * s for c, s in zip(centres[rng.integers(0, 20, 300)], rng.choice([0.02, 0.1, 0.3], 300))]
    x += [x[7] * 3] * 40 + [x[7]] * 30 + [x[9] * 1e200, x[9] * 1e-200, -x[9]]
    rows = [(int(i), list(map(float, v))) for i, v in zip(rng.permutation(len(x)), x)]
    rows += [(1000, None), (1001, [0.0] * 40), (1002, [float("nan")] + [1.0] * 39), (1003, [float("inf")] + [1.0] * 39), (1004, [None] + [1.0] * 39), (1005, [1.0, 2.0]), (1006, [1.0, 2.0]), (None, rows[7][1]), (5, rows[7][1]), (5, rows[12][1]), (1007, [])]
    found = run(spark, rows)
    assert found == naive(rows)
    assert sum(r[1] for r in found) > 5000 and any(not r[3] for r in found)


def test_bounds_lose_no_pair():
    """The tiles find what all products in full do."""
    rng = np.random.default_rng(2)
    for d in (1, 3, 16, 17, 100):
        x = rng.standard_normal((200, d)) * np.geomspace(2, 0.01, d)
        x = np.r_[x, x + rng.standard_normal(x.shape) * 0.3 * np.geomspace(2, 0.01, d)]
        turn = neardup.axes(x[:50])
        u = neardup.unit(x)
        i, j = neardup.linked(neardup.Tile(x, turn), neardup.Tile(x, turn), 0.9)
        want = u @ u.T >= 0.9
        got = np.zeros_like(want)
        got[i, j] = True
        assert (got == want).all() and got.sum() >= 400


def test_the_edge_counts_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, math.sqrt(1 - 0.81)]), (3, [9.0, 4.4])]
    assert [r[0:2] for r in run(spark, rows)][0] == (1, naive(rows)[0][1])
    assert run(spark, []) == [] and run(spark, [(4, None)]) == [(4, 0, 4, True)]
