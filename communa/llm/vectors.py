"""Approximate nearest neighbours by inner product over randomly rotated one-bit codes.

Of a vector less a common centre, randomly rotated, the signs are kept as packed bits, with its length and the correction
that makes the estimate of an inner product unbiased (RaBitQ; Gao and Long, 2024). A query, rotated too, is rounded to ``QUERY_BITS`` bits a
component; its estimates with all codes of a block are counts of the bits that codes share with the planes of these numbers, so codes are
never unpacked. Of its ``FIRST`` best estimates it computes the inner products exactly, and then of all whose
error bound, at ``EPSILON`` standard deviations, reaches the k-th best of these; exact values rank the result.

Every code is looked at, in blocks of about ``BLOCK_ROWS`` rows that hashes of the ids deal out, so equal vectors are spread like any others.
A vector crosses the shuffle once; a task holds the vectors of one block while the queries pass by, in batches, and takes of them those that
the bounds choose. Coarser cells are left out on purpose: on vectors without much structure half of all cells must be read for a recall of 0.9.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from communa.llm.common import small_batches, table

K = 20
#: Bound of the sample whose mean is the centre.
SAMPLE_ROWS = 4096
#: Rows of a block, and bits that a component of a query is rounded to.
BLOCK_ROWS, QUERY_BITS = 16384, 4
#: Estimates computed exactly at first, for each query and block; standard deviations of the error bound.
FIRST, EPSILON = 64, 3.0
SEED = 5


@dataclass
class Codebook:
    rotation: np.ndarray
    centre: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed sign bits, lengths less the centre, and inner products of the unit vectors with their codes."""
        left = (x - self.centre) @ self.rotation
        length = np.linalg.norm(left, axis=1)
        exact = np.abs(left).sum(1) / np.sqrt(left.shape[1]) / np.where(length > 0, length, 1)
        return np.packbits(left > 0, axis=1), length, np.where(length > 0, exact, 1.0)


def codebook(sample: np.ndarray, seed: int = SEED) -> Codebook:
    d = sample.shape[1]
    return Codebook(np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0], sample.mean(0))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in one order whatever the batch."""
    return np.einsum("ij,ij->i", q, x)


def _words(bits: np.ndarray) -> np.ndarray:
    """Packed bits, a row each -> 64-bit words, a column each."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.ascontiguousarray(wide.view(np.uint64).T)


class Block:
    """Vectors of a block, their codes and corrections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bits: np.ndarray, length: np.ndarray, fit: np.ndarray):
        self.ids, self.x, self.words = ids, x, _words(bits)
        d = x.shape[1]
        self.ones = np.bitwise_count(self.words).sum(0, dtype=np.int64)
        self.scale = length / fit / np.sqrt(d)
        self.wide = EPSILON * length * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(d - 1, 1))

    def estimates(self, turned: np.ndarray) -> np.ndarray:
        """Of the inner products of a rotated query with the vectors less the centre."""
        low = float(turned.min())
        step = (float(turned.max()) - low) / ((1 << QUERY_BITS) - 1) or 1.0
        level = np.round((turned - low) / step).astype(np.uint8)
        shared = np.zeros(len(self.ids), np.int64)
        for j in range(QUERY_BITS):
            plane = _words(np.packbits(level >> j & 1)[None])
            for word, mask in zip(self.words, plane[:, 0], strict=True):
                shared += np.bitwise_count(word & mask).astype(np.int64) << j
        return self.scale * (2 * (low * self.ones + step * shared) - (low * len(turned) + step * level.sum(dtype=np.int64)))

    def nearest(self, q: np.ndarray, turned: np.ndarray, centre: float, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact inner products of the best k found, but for the id ``own``."""
        if len(self.ids) > FIRST + k:
            guess = self.estimates(turned)
            best = np.argpartition(guess, -FIRST)[-FIRST:]
            score = exact_scores(np.broadcast_to(q, (FIRST, len(q))), self.x[best])
            score[self.ids[best] == own] = -np.inf
            floor = np.partition(score, -min(k, FIRST))[-min(k, FIRST)] - centre
            keep = guess + np.linalg.norm(q) * self.wide >= floor - 1e-9
            keep[best] = True
            found = np.flatnonzero(keep)
        else:
            found = np.arange(len(self.ids))
        found = found[self.ids[found] != own]
        score = exact_scores(np.broadcast_to(q, (len(found), len(q))), self.x[found])
        if len(found) > k:
            top = score >= np.partition(score, -k)[-k]
            found, score = found[top], score[top]
        order = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found[order]], score[order]


def search_block(ids: np.ndarray, x: np.ndarray, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, qids: np.ndarray, q: np.ndarray, book: Codebook, k: int) -> list[np.ndarray]:
    """Best k of a block for each query: query ids, ids, scores."""
    return _searched(Block(ids, x, bits, length, fit), qids, q, book, k)


def _searched(block: Block, qids: np.ndarray, q: np.ndarray, book: Codebook, k: int) -> list[np.ndarray]:
    centre, turned = q @ book.centre, q @ book.rotation
    out = []
    for i, own in enumerate(qids.tolist()):
        ids, score = block.nearest(q[i], turned[i], float(centre[i]), own, k)
        out.append((np.full(len(ids), own), ids, score))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.filter(finite & F.exists("embedding", lambda v: v != 0))


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = K) -> DataFrame:
    """(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): the k rows of largest inner product found for each query, its own
    vec_id left out; ties go to the smaller vec_id. ``queries`` has the same columns; without it every row is a query.

    Rows with a null vec_id, and vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
    another length than most (the longer, on a tie). Candidates that repeat a vec_id count once each; of queries that do, the least vector is asked, once. Fewer than k candidates are all
    returned, equal vectors like any others; an empty table gives none. Vectors of any length are taken whole. Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = sound(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes[0]["d"], sizes[0]["n"]
    rows = rows.filter(F.size("embedding") == d)
    share = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * SAMPLE_ROWS / n) + 1)
    sample = rows.filter(share).dropDuplicates(["vec_id"]).limit(2 * SAMPLE_ROWS).collect() or [rows.first()]
    shared = spark.sparkContext.broadcast(codebook(np.array([r["embedding"] for r in sample])))
    asked = rows if queries is None else sound(queries).filter(F.size("embedding") == d)
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))  # a query for each id
    blocks = -(-n // BLOCK_ROWS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits, length, fit = shared.value.encode(_stack(batch.column(1)))
                yield pa.record_batch([*batch.columns, pa.array(list(map(bytes, bits)), pa.binary()), pa.array(length), pa.array(fit)], ["vec_id", "embedding", "bits", "length", "fit"])

    coded = rows.mapInArrow(encode, "vec_id long, embedding array<double>, bits binary, length double, fit double")
    held = coded.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(0).alias("turn"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "bits", "length", "fit")
    passing = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("turn"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    passing = passing.select("*", F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("double").alias("length"), F.lit(None).cast("double").alias("fit"))
    names = ["query_id", "vec_id", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = -1, [], None  # the block at hand: first its vectors come, then the queries
        for batch in batches:
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            for a in np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else ():
                part = batch.slice(a, int(np.searchsorted(key, key[a], "right")) - a)
                if key[a] // 2 != now:
                    now, parts, block = key[a] // 2, [], None
                ids, vectors_ = part.column(2).to_numpy(), _stack(part.column(3))
                if key[a] % 2 == 0:
                    bits = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(len(ids), -1)
                    parts.append((ids, vectors_, bits, part.column(5).to_numpy(), part.column(6).to_numpy()))
                elif parts or block:
                    if parts:
                        block, parts = Block(*(np.concatenate(c) for c in zip(*parts, strict=True))), []
                    yield pa.record_batch([pa.array(c) for c in _searched(block, ids, vectors_, shared.value, k)], names)

    small_batches(spark)
    dealt = held.union(passing).repartition("block").sortWithinPartitions("block", "turn")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other rows, for the rows whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
