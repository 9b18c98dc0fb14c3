"""Byte-level BPE by corpus-level merge replay.

Every distinct pre-token of the rows in hand is laid end to end in one array of token ids. An inverted index leads
from the rank of a mergeable pair to the positions where it stands; ranks are replayed from the least, all
positions of a rank left to right, and each merge touches only the two neighbouring pairs. A merge that brings
up a pair of lower rank puts that rank back in front for its word, as a tokenizer working on one word would.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communa.llm.common import small_batches, table

#: Pre-tokens that a worker remembers; past it the memory starts anew.
REMEMBERED = 1_000_000
#: Words laid end to end at once: few enough to stay near the processor.
AT_ONCE = 4000
#: Longer pre-tokens are not remembered.
LONG = 64
#: Pairs whose rank is remembered.
_PAIRS = 2_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class MergeReplay:
    """Encodes many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.table = np.array(self.pieces, object)
        self.single = np.array([ranks[bytes([i])] for i in range(256)])
        self.of_bytes = np.array([ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)])
        self.pair: dict[int, int] = {}

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        if len(self.pair) > _PAIRS:
            self.pair.clear()
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if not n:
            return [b""] * len(words)
        last = np.zeros(n, bool)
        last[ends[size > 0] - 1] = True
        starts = np.r_[True, last[:-1]]
        rank_at = np.full(n, -1)
        rank_at[:-1] = self.of_bytes[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        rank_at[last] = -1
        spots = np.flatnonzero(rank_at >= 0)
        spots = spots[np.argsort(rank_at[spots], kind="stable")]
        there, first = np.unique(rank_at[spots], return_index=True)
        index = dict(zip(there.tolist(), (x.tolist() for x in np.split(spots, first[1:])), strict=False)) if len(spots) else {}
        ids, pair_at = self.single[raw].tolist(), rank_at.tolist()  # pair_at: rank of the pair that begins here; -2 where a token was swallowed
        after, before = np.where(last, -1, np.arange(1, n + 1)).tolist(), np.where(starts, -1, np.arange(-1, n - 1)).tolist()
        pieces, get, rank_of, pair = self.pieces, self.pair.get, self.ranks.get, self.pair
        come, grown = sorted(index), set()
        lower: list[tuple[int, int]] = []  # pairs that a merge brought up at the rank in hand or below: they come before its next position
        while come:
            now = heappop(come)
            todo = index.pop(now)
            if now in grown:
                todo.sort()
            for spot in todo:
                rank, i = now, spot
                while True:
                    if pair_at[i] == rank:
                        j = after[i]
                        ids[i] = rank
                        pair_at[j] = -2
                        k = after[i] = after[j]
                        x = -1
                        if k >= 0:
                            before[k] = i
                            code = rank << 20 | ids[k]
                            if (x := get(code)) is None:
                                x = pair[code] = rank_of(pieces[rank] + pieces[ids[k]], -1)
                        pair_at[i] = x
                        at = i
                        for _ in (0, 1):
                            if x >= 0:
                                if x <= now:
                                    heappush(lower, (x, at))
                                elif x in index:
                                    index[x].append(at)
                                    grown.add(x)
                                else:
                                    index[x] = [at]
                                    heappush(come, x)
                            at, x = before[i], -1
                            if at < 0 or _:
                                break
                            code = ids[at] << 20 | rank
                            if (x := get(code)) is None:
                                x = pair[code] = rank_of(pieces[ids[at]] + pieces[rank], -1)
                            pair_at[at] = x
                    if not lower:
                        break
                    rank, i = heappop(lower)
        left = np.array(pair_at) != -2
        held = np.r_[0, np.cumsum(left)][np.r_[0, ends]] * 4
        code = np.array(ids)[left].astype("<u4").tobytes()
        return [code[a:b] for a, b in zip(held[:-1].tolist(), held[1:].tolist(), strict=True)]


class Encoder:
    """Whole texts to ids, with a bounded memory of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.replay, self.find, self.known = MergeReplay(load_ranks(path)), regex.compile(pattern).findall, {}

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [self.find(x) if x else [] for x in texts]
        known = self.known
        fresh = [w for w in set().union(*split) if w not in known]
        raw = [w.encode("utf-8") for w in fresh]
        own = dict(zip(fresh, (c for at in range(0, len(raw), AT_ONCE) for c in self.replay.encode(raw[at : at + AT_ONCE])), strict=True))
        known.update((w, c) for w, c in own.items() if len(w) <= LONG)
        long = {w: c for w, c in own.items() if len(w) > LONG}
        if long:
            return [b"".join([known.get(w) or long[w] for w in words]) for words in split]
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.replay.table[np.frombuffer(ids, "<u4")].tolist())


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for a worker process: what it remembers serves its next tasks too."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, ids array<int>, decoded binary), a row per input row; with ``digest`` the
    columns (doc_id, n_tokens, ids_sha256, decoded_sha256) instead.

    Null and empty texts have no ids. Texts are encoded whole, however long; special tokens are ordinary text. Repeated rows stay, equal texts have
    equal ids, a null doc_id stays null, an empty table gives no rows; other columns are left out.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            codes = coder.texts(batch.column(1).to_pylist())
            decoded = map(coder.decode, codes)
            if digest:
                yield pa.record_batch(
                    [batch.column(0), pa.array([len(x) // 4 for x in codes], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in codes], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                ids = pa.array([np.frombuffer(x, "<i4") for x in codes], pa.list_(pa.int32()))
                yield pa.record_batch([batch.column(0), ids, pa.array(list(decoded), pa.binary())], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded binary")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, ...) -> (doc_id, decoded binary); null ids decode to no bytes."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = MergeReplay(load_ranks(path)).pieces
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([b"".join([pieces[i] for i in x or ()]) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    small_batches(tokens.sparkSession)
    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, decoded binary")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of :func:`encode` over documents."""
    return encode(table(spark, sf_dir, "documents"), digest=True)
