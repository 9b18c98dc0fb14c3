"""SimHash near-duplicate detection.

Fingerprints of 64 bits are linked at ``max_bits`` differing bits or fewer. The bits are cut into ``blocks``
blocks; two linked fingerprints agree on ``blocks - max_bits`` whole blocks at least (pigeonhole), so each choice
of that many blocks is a join key and every link meets its partner under one of them. Distinct fingerprints
alone take part, so exact copies cost nothing. Under a key, pairs are compared in memory and only a spanning
forest of the true links leaves the task. A key held by more than ``bucket_rows`` fingerprints is not compared:
its fingerprints go through :func:`_ball_edges`, which is linear in their number and as exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communa.llm.common import BATCH_ROWS, batch_rows, map_batches, table, whole_row
from communa.operators.components import component_edges
from communa.storage import drop, materialize, owned

SEED = 42
MAX_BITS = 3
BLOCKS = 6
#: Fingerprints under one key that one task compares with each other.
BUCKET_ROWS = 16384
_CHUNK = 1 << 17


def fingerprint(text: bytes | None, shingle_words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the lower-cased word shingles, repeats included; 0 for null or wordless text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total, ones = len(words) - shingle_words + 1, np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + shingle_words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle_words)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (ones * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp long), one row per input row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(x, shingle_words) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, "doc_id long, fp long")


def _masks(max_bits: int, blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [int(np.uint64(sum(x)).view(np.int64)) for x in combinations(block, blocks - max_bits)]


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among a key's fingerprints, compared one against all later ones."""
    root = np.arange(len(fps))
    out = []
    for i in range(len(fps) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= max_bits)
        if len(near):
            near = near[np.unique(root[near], return_index=True)[1]]
            for j in near[root[near] != root[i]]:
                root[root == root[j]] = root[i]
                out.append((i, int(j)))
    return out


def _cold_edges(keys: DataFrame, max_bits: int) -> DataFrame:
    """(k, m, fp) rows, in whole keys -> (u, v) links; rows are streamed in key order and a key is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k = rest_f = np.empty(0, np.int64)

        def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch | None:
            cut = np.flatnonzero((k[1:] != k[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(k)]
            size = ends - starts
            bits, pairs = f.view(np.uint64), []
            two = starts[size == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= max_bits]
            pairs.append(np.stack([f[two], f[two + 1]], 1))
            for a, b in zip(starts[size > 2], ends[size > 2], strict=True):
                if found := forest(bits[a:b], max_bits):
                    pairs.append(f[a + np.array(found)])
            both = np.concatenate(pairs)
            return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"]) if len(both) else None

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False)
            k, f = np.concatenate([rest_k, k]), np.concatenate([rest_f, f])
            whole = np.flatnonzero(k != k[-1])
            split = whole[-1] + 1 if len(whole) else 0
            rest_k, rest_f = k[split:], f[split:]
            if split and (out := links(k[:split], f[:split])) is not None:
                yield out
        if len(rest_k) and (out := links(rest_k, rest_f)) is not None:
            yield out

    return keys.mapInArrow(run, "u long, v long")


def _ball_edges(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among crowded fingerprints, without pairs: equal words at ``near`` flips from one and ``max_bits - near``
    from the other prove a distance of max_bits at most, and every such distance has such a word between. All that meet
    at a word are chained to the least of those that reach it by the smaller number of flips."""
    near = max_bits // 2
    far = max_bits - near
    flips = [[int(np.uint64(sum(1 << b for b in c)).view(np.int64)) for n in range(most + 1) for c in combinations(range(64), n)] for most in (near, far)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.array(x) for x in flips]
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(f), 256):
                part = f[at : at + 256]
                for side, m in enumerate(masks):
                    w = (part[:, None] ^ m).ravel()
                    yield pa.record_batch([pa.array(w), pa.array(np.repeat(part, len(m))), pa.array(np.full(len(w), side == 0))], ["w", "fp", "near"])

    met = fps.mapInArrow(run, "w long, fp long, near boolean")
    hub = met.filter("near").groupBy("w").agg(F.min("fp").alias("hub"))
    return met.join(hub, "w").filter("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) -> written (u, v) pairs whose components are those of the full link graph."""
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(max_bits, blocks)])).alias("m", "k"))
    sizes = keys.groupBy("m", "k").agg(F.count("*").alias("n")).filter("n > 1")
    met = keys.join(sizes, ["m", "k"])
    # the mask number is mixed into the key, so one long tells keys apart but for chance meetings, which only add comparisons
    cold = met.filter(F.col("n") <= bucket_rows).select(F.xxhash64("m", "k").alias("k"), "fp").repartition("k").sortWithinPartitions("k")
    hot = materialize(met.filter(F.col("n") > bucket_rows).select("fp").distinct())
    with batch_rows(fps.sparkSession, 65536):
        out = materialize(_cold_edges(cold, max_bits).union(_ball_edges(hot, max_bits)))
    drop(hot)
    return out


@owned
def near_duplicates(docs: DataFrame, shingle_words: int = 5, max_bits: int = MAX_BITS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp long, component_id long), a row per input row.

    component_id is the least doc_id that links lead to, the row's own included. Null and wordless texts have
    fingerprint 0 and are linked like any others; rows that repeat a doc_id stay; a null doc_id gets the least
    doc_id of its component, null if there is none. A very long text is hashed in chunks. Other columns are left out. An empty table gives no rows.
    """
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        fps = materialize(fingerprints(docs, shingle_words))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = component_edges(links(distinct.select("fp"), max_bits, blocks, bucket_rows))
    named = distinct.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


@owned
def one_of_each(docs: DataFrame, shingle_words: int = 5, max_bits: int = MAX_BITS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that have the least doc_id of their group of near-duplicates; of rows that repeat doc_id
    and text one stays, and so does one of each text without doc_id in a group that has none."""
    found = near_duplicates(docs, shingle_words, max_bits, blocks, bucket_rows)
    stay = materialize(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")))
    kept = docs.select(whole_row(docs)).join(stay.hint("merge"), F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")))
    again = kept.filter("n > 1").withColumn("a", F.xxhash64("row.text")).withColumn("b", F.xxhash64(F.lit(1), "row.text")).dropDuplicates(["id", "a", "b"])
    return kept.filter("n = 1").select("row.*").union(again.select("row.*"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`near_duplicates` of documents on three-word shingles, the fingerprint as 16 hexadecimal digits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
