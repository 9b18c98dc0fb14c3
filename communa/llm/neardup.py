"""Embedding near-duplicates: every pair of vectors whose cosine reaches a threshold, by PCA-ordered tiled comparison.

Unit vectors are turned to principal axes, so that the leading components hold most of a product. A tile of pairs is one matrix product of
the leading components with the norm of what follows as one more column: by Cauchy and Schwarz that is an upper bound of the cosine, and
pairs whose bound is under the threshold are done with. The others go on, some components at a time, each with the bound by the norms of what is left; those that pass
all of them are computed anew from the vectors as they are, in double precision.

Equal vectors are one class with a count. Classes lie in cells along the first axis; two cells further apart than a pair of
that cosine can be are never compared. Cells are cut into blocks of about ``BLOCK_ROWS`` by hash, and each pair of blocks is a task of its own, which returns
sums and a spanning forest, never the pairs. The work is the product of the rows but for the cells told apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communa.llm.common import small_batches, table
from communa.llm.vectors import sound
from communa.operators.components import component_edges
from communa.operators.ordering import number_rows
from communa.storage import materialize, owned

THRESHOLD = 0.9
#: Bound of the sample whose principal axes are taken; they decide on speed alone.
SAMPLE_ROWS = 4096
#: Cells along the first axis, rows of a block, and rows of a tile within it.
CELLS, BLOCK_ROWS, TILE_ROWS = 64, 4096, 1024
#: Components in the first product, and in each of the following sums.
LEADING, MORE = 16, 16
#: What single precision may lose of a bound.
SLACK = 1e-4
SEED = 11


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever the size of their components."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes as columns, the one of most weight first."""
    x = unit(sample)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


class Tile:
    """Vectors, their turned forms and the norms of what follows each step."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        self.x, self.turned = x, unit(x) @ turn
        d = self.turned.shape[1]
        self.steps = [*range(min(LEADING, d), d, MORE), d]
        left = np.cumsum(self.turned[:, ::-1] ** 2, 1)[:, ::-1]
        self.rest = [np.sqrt(left[:, k]) if k < d else np.zeros(len(x)) for k in self.steps]
        self.first = np.c_[self.turned[:, : self.steps[0]], self.rest[0]].astype(np.float32)


def linked(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs whose cosine is threshold or more."""
    i, j = np.nonzero(a.first @ b.first.T >= threshold - SLACK)
    done = a.steps[0]
    sums = np.einsum("ij,ij->i", a.turned[i, :done], b.turned[j, :done])
    for step, upto in enumerate(a.steps[1:], 1):
        if not len(i):
            break
        sums = sums + np.einsum("ij,ij->i", a.turned[i, done:upto], b.turned[j, done:upto])
        stay = sums + a.rest[step][i] * b.rest[step][j] >= threshold - 1e-9
        i, j, sums, done = i[stay], j[stay], sums[stay], upto
    p, q = (x / np.abs(x).max(1, keepdims=True) for x in (a.x[i], b.x[j]))
    cosine = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
    return i[cosine >= threshold], j[cosine >= threshold]


def _lowered(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of the components that links i-j join, from the labels so far: the least index of each."""
    while True:
        least = np.minimum(low[i], low[j])
        if (low[i] == low[j]).all():
            return low
        np.minimum.at(low, low[i], least)
        np.minimum.at(low, low[j], least)
        while (low[low] != low).any():
            low = low[low]


def compared(x: np.ndarray, n: np.ndarray, split: int | None, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows linked to each of x, least index it is joined with): each pair of x once, or with ``split`` the pairs of rows before it with those after."""
    links, low = np.zeros(len(x), np.int64), np.arange(len(x))
    cuts = [range(0, len(x), TILE_ROWS)] * 2 if split is None else [range(0, split, TILE_ROWS), range(split, len(x), TILE_ROWS)]
    ends = [len(x)] * 2 if split is None else [split, len(x)]
    tiles = {(a, min(a + TILE_ROWS, end)): None for starts, end in zip(cuts, ends, strict=True) for a in starts}
    tiles = {k: Tile(x[k[0] : k[1]], turn) for k in tiles}
    for s in cuts[0]:
        for t in cuts[1]:
            if split is None and t < s:
                continue
            i, j = linked(tiles[s, min(s + TILE_ROWS, ends[0])], tiles[t, min(t + TILE_ROWS, ends[1])], threshold)
            i, j = i + s, j + t
            if s == t:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            low = _lowered(low, i, j)
    return links, low


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _blocks(classes: DataFrame, d: int, threshold: float) -> tuple[DataFrame, np.ndarray]:
    """(a, z, own, cls, n, embedding): classes in each pair of blocks that they are compared in, and the axes."""
    spark = classes.sparkSession
    total = classes.count()
    share = F.pmod(F.xxhash64("cls", F.lit(SEED)), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * SAMPLE_ROWS / total) + 1)
    sample = np.array([r[0] for r in classes.filter(share).select("embedding").limit(2 * SAMPLE_ROWS).collect() or [classes.select("embedding").first()]])
    turn = axes(sample)
    along = np.sort(unit(sample) @ turn[:, 0])
    cells = min(CELLS, len(along), -(-total // BLOCK_ROWS))
    cuts = [float(along[len(along) * k // cells]) for k in range(1, cells)]
    # the first coordinate of the unit vector, for cells only
    scaled = F.transform("embedding", lambda v: v / F.col("top"))
    size = F.sqrt(F.aggregate("part", F.lit(0.0), lambda s, v: s + v * v))
    along_first = F.aggregate(F.zip_with("part", F.array(*map(F.lit, turn[:, 0].tolist())), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    placed = classes.withColumn("top", F.array_max(F.transform("embedding", F.abs))).withColumn("part", scaled).withColumn("place", along_first / size)
    cell = sum((F.when(F.col("place") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = materialize(placed.select("cls", "n", "embedding", cell.alias("cell")))
    number = {r["cell"]: r["k"] for r in placed.groupBy("cell").agg(F.count("*").alias("k")).collect()}
    parts = [-(-number.get(c, 0) // BLOCK_ROWS) for c in range(cells)]
    base = np.cumsum([0, *parts]).tolist()
    reach, edges = np.sqrt(2 - 2 * threshold) + 1e-9, [-np.inf, *cuts, np.inf]
    near = [[o for o in range(cells) if max(edges[o] - edges[c + 1], edges[c] - edges[o + 1]) <= reach] for c in range(cells)]  # a run of cells
    low, high = ([base[o[0]] for o in near], [base[o[-1] + 1] - 1 for o in near])
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("cell") + 1)
    own = pick(base[:-1]) + F.pmod(F.xxhash64("cls"), pick([max(1, p) for p in parts]))
    spread = placed.select("cls", "n", "embedding", own.alias("own"), F.explode(F.sequence(pick(low), pick(high))).alias("other"))
    return spread.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("z"), "own", "cls", "n", "embedding"), turn


def links(classes: DataFrame, d: int, threshold: float) -> DataFrame:
    """(cls, links, low) of classes (cls, n, embedding): rows that a block pair links to those of cls, and a class it is joined with."""
    pairs, turn = _blocks(classes, d, threshold)
    shared = classes.sparkSession.sparkContext.broadcast(turn)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own = rows.column("own").to_numpy()
        order = np.lexsort((rows.column("cls").to_numpy(), own))
        own = own[order]
        cls, n, x = rows.column("cls").to_numpy()[order], rows.column("n").to_numpy()[order], _stack(rows.column("embedding"))[order]
        one = key[0].as_py() == key[1].as_py()
        found, low = compared(x, n, None if one else int(np.searchsorted(own, key[1].as_py())), shared.value, threshold)
        some = found > 0
        return pa.table({"cls": cls[some], "links": found[some], "low": cls[low[some]]})

    small_batches(classes.sparkSession)
    return pairs.groupBy("a", "z").applyInArrow(run, "cls long, links long, low long")


@owned
def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, embedding, ...) -> (vec_id, n_links, component_id, kept), a row for each row: the other rows that its cosine with is ``threshold`` or
    more, the least vec_id reachable by such links, and whether that is its own.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do those of another length than most (the longer, on a
    tie) or without a vec_id; the last have no component and are kept. Rows that repeat are vectors each and link with each other. Vectors of any length are compared
    whole; an empty table gives no rows. Other columns are left out."""
    spark = vectors.sparkSession
    rows = sound(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    finite = sound(vectors.select("vec_id", "embedding")).filter(F.size("embedding") == d)
    name = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")]
    held = materialize(finite.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).select("*", *name))
    numbers = materialize(number_rows(held.select("first", "k1", "k2"), "first", "k1", "k2", name="cls"))
    classes = materialize(held.join(numbers.select("k1", "k2", "cls"), ["k1", "k2"]).select("cls", "n", "embedding"))
    found = materialize(links(classes, d, threshold)) if sizes else spark.createDataFrame([], "cls long, links long, low long")
    stars = component_edges(found.filter("cls <> low").select(F.col("cls").alias("u"), F.col("low").alias("v")))
    root = stars.join(numbers.select(F.col("cls").alias("component"), F.col("first").alias("least")), "component").select(F.col("u").alias("cls"), "least")
    sums = found.groupBy("cls").agg(F.sum("links").alias("links"))
    counts = held.select("k1", "k2", "n").join(numbers, ["k1", "k2"]).join(sums, "cls", "left").join(root, "cls", "left")
    told = counts.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    able = F.col("vec_id").isNotNull() & (F.size("embedding") == d) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = wide.select("vec_id", *[F.when(able, k).alias(n) for k, n in zip((F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")), ("k1", "k2"), strict=True)])
    out = keyed.join(told, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
