"""Line deduplication by an exact set-similarity join.

A line is its set of tokens: lower-cased words, or with a ``shingle`` over 1 runs of so many, all the words where there are fewer. Tokens
are ordered by rarity (counts over the whole corpus in ``buckets`` hashed counters, then by hash), so two lines of Jaccard
similarity ``threshold`` or more share a shingle of both prefixes. Equal sets meet under their hash first; distinct
sets meet under the shingles of their prefixes, pass length and positional filters and a bound from the parities of
hashed bits, and are verified on their whole sets. A line goes if an earlier line, by (doc_id, line number), matches it.

Of the sets that pass under a shingle, each is first checked against the ``LEADERS`` earliest alone, which settles families of
many near-copies in linear work; a pair whose prefixes agree in the shingle before too was met there. Sets that this leaves
standing, and that passed with more, are then checked against all. Shingles in more than ``CROWD`` prefixes are split, see :class:`_Keys`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from communa.llm.common import batch_rows, map_batches, release_memory, small_batches, table, whole_row
from communa.storage import drop, materialize, owned

THRESHOLD = Fraction(4, 5)
#: Words of a token, where a caller names no other number.
SHINGLE = 5
#: The same for op9_lines and the pipeline, whose relation is on single words.
WORD = 1
#: Lines of fewer words are never removed, where a caller names no other number.
LEAST_WORDS = 3
#: The same for op9_lines and the pipeline: every line with a word takes part.
ANY_WORDS = 1
#: Hashed counters of the rarity table, least and most: as many as there are documents, in powers of two. A byte each on the driver and on each
#: worker, eight bytes that a task sends where it is used.
BUCKETS = 1 << 17, 1 << 20
#: Counters that a task sends in one row.
_BLOCK = 1 << 12
#: Earlier sets that each set is first checked against.
LEADERS = 2
#: Sets under one key that one task scans: more are met under two tokens each, and what is still crowded is dealt into parts of about so many.
CROWD = 1 << 11
#: Rows of one long that are broadcast at most.
_FEW = 1_000_000
#: Bytes of text taken at once.
_AT_ONCE = 1 << 20
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: The first bytes of a word of eight, by how many of them count; words of more bytes than _WIDE are hashed one by one.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_WIDE = 64


#: Two hashes of doc_id and text, 128 bits together, name a row: the same for rows that repeat both.
KEY = ["rid", "rid2"]


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """columns of docs, rid and rid2."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(*columns, F.xxhash64(doc, text).alias("rid"), F.xxhash64(F.lit(1), text, doc).alias("rid2"))


class Shingles:
    """Hashed shingles of the lines of texts."""

    def __init__(self, shingle: int, least: int):
        self.shingle, self.least = shingle, least

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of text that ends with a line feed: (line of each word, hash of each word, places of the line feeds)."""
        n = len(raw)
        low = raw.lower() + b"\0" * 8
        x = np.frombuffer(low, np.uint8)[:n]
        space = (x == 32) | (x - np.uint8(9) < 5)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = edge if space[0] else np.r_[0, edge]
        start, end = edge[::2], edge[1::2]
        size, eight = end - start, np.ndarray((n,), "<u8", low, 0, (1,))  # the eight bytes from each place
        h = (size.astype(np.uint64) * _PRIME ^ eight[start] & _HEAD[np.minimum(size, 8)]) * _MIX
        h ^= h >> np.uint64(31)
        more, at = np.flatnonzero(size > 8), 8
        while len(more) and at < _WIDE:
            g = (h[more] ^ eight[start[more] + at] & _HEAD[np.minimum(size[more] - at, 8)]) * _MIX
            h[more] = g ^ g >> np.uint64(31)
            at += 8
            more = more[size[more] > at]
        if len(more):
            h[more] = [xxhash.xxh3_64_intdigest(low[a:b]) for a, b in zip(start[more].tolist(), end[more].tolist(), strict=True)]
        h *= _PRIME
        h ^= h >> np.uint64(29)
        feeds = np.flatnonzero(x == 10)
        return np.searchsorted(feeds, start), h, feeds

    def hashes(self, size: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines of so many words each -> (line number, shingle) in order, repeats included."""
        number = np.maximum(size - self.shingle + 1, 1)
        line = np.repeat(np.arange(len(size)), number)
        first = np.arange(len(line)) + np.repeat(np.cumsum(size) - size - (np.cumsum(number) - number), number)
        width = np.minimum(size, self.shingle)[line]
        h = width.astype(np.uint64)
        padded = np.r_[words, np.zeros(self.shingle, np.uint64)]
        short = width < self.shingle
        for k in range(self.shingle):
            new = (h ^ padded[first + k]) * _PRIME
            h = np.where(short & (k >= width), h, new ^ new >> np.uint64(31))
        return line, h

    def lines(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text numbers, line numbers, words in each, words) of the lines that take part, about _AT_ONCE bytes at a time."""
        group, total = [], 0
        for i, text in enumerate(texts):
            if text:
                group.append(i)
                total += len(text)
            if group and (total > _AT_ONCE or i == len(texts) - 1):
                line, words, feeds = self.words(b"".join(x for j in group for x in (texts[j], b"\n")))
                size = np.bincount(line, minlength=len(feeds))
                ends = np.cumsum([len(texts[j]) + 1 for j in group])
                owner = np.searchsorted(ends, feeds, "right")
                number = np.arange(len(feeds)) - np.r_[0, np.searchsorted(feeds, ends[:-1])][owner]
                taken = size >= self.least
                if taken.any():
                    yield np.array(group)[owner[taken]], number[taken], size[taken], words[taken[line]]
                group, total = [], 0


def _code(count: int) -> int:
    return min(255, 1 + int(6 * np.log2(count)))


def rarity(docs: DataFrame, buckets: int | None = None, shingle: int = SHINGLE, least: int = LEAST_WORDS) -> np.ndarray:
    """A byte for each of ``buckets``, a power of two, of shingle hashes: 0 unused, then :func:`_code` of its count over the corpus."""
    buckets = buckets or min(BUCKETS[1], max(BUCKETS[0], 1 << (docs.count() - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, total = Shingles(shingle, least), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, size, words in maker.lines(batch.column(0).to_pylist()):
                total += np.bincount((maker.hashes(size, words)[1] & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        for at in range(0, buckets, _BLOCK):
            if total[at : at + _BLOCK].any():
                yield pa.record_batch([pa.array([at]), pa.array([total[at : at + _BLOCK].tobytes()], pa.binary())], ["at", "counts"])
        release_memory()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts, np.int64)
        for at, n in sums.items():
            code = np.where(n > 0, np.minimum(255, 1 + (6 * np.log2(np.maximum(n, 1))).astype(np.int64)), 0).astype(np.uint8)
            yield pa.record_batch([pa.array([at]), pa.array([code.tobytes()], pa.binary())], ["at", "codes"])

    small_batches(docs.sparkSession)
    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "at long, counts binary").repartition("at").mapInArrow(add, "at long, codes binary")
    codes = np.zeros(buckets, np.uint8)
    for r in counts.collect():  # a byte each of ``buckets``
        codes[r["at"] : r["at"] + _BLOCK] = np.frombuffer(r["codes"], np.uint8)
    return codes


class LineSets:
    """Shingle sets of lines, in rarity order."""

    def __init__(self, codes: np.ndarray, threshold: Fraction, shingle: int, least: int, crowd: int):
        self.codes, self.threshold, self.maker, self.rare = codes, threshold, Shingles(shingle, least), _code(crowd)

    def sets(self, size: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(set hash, size, number of shingles too rare to be crowded, prefix offsets, shingles by place, parities) of the lines. The shingles are the
        prefix and one more, where there is one; a set too small to match any but its equal has none."""
        line, h = self.maker.hashes(size, words)
        code = self.codes[(h & np.uint64(len(self.codes) - 1)).astype(np.int64)]
        key = line.astype(np.uint64) << np.uint64(40) | code.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
        order = np.argsort(key)
        tied = key[order][1:] == key[order][:-1]
        if (tied & (h[order][1:] != h[order][:-1])).any():
            order = np.lexsort((h, key))
        line, h = line[order], h[order]
        one = np.r_[True, (line[1:] != line[:-1]) | (h[1:] != h[:-1])]
        line, h = line[one], h[one]
        rare = np.bincount(line[(key[order][one] >> np.uint64(32) & np.uint64(255)) < self.rare], minlength=len(size))
        n = np.bincount(line, minlength=len(size))
        start = np.cumsum(n) - n
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        place = np.arange(len(line)) - start[line]
        p, q = self.threshold.numerator, self.threshold.denominator
        prefix = np.where(n * q >= (n + 1) * p, np.minimum(n - -(-p * n // q) + 2, n), 0)
        taken = place < prefix[line]
        bit = np.uint64(1) << (mixed & np.uint64(63))
        part = mixed >> np.uint64(6) & np.uint64(1)
        parity = np.stack([np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), start) for k in range(2)])
        return np.add.reduceat(mixed, start).view(np.int64), n, rare, np.r_[0, np.cumsum(prefix)], h[taken].view(np.int64), parity.view(np.int64)


_FIRST = "struct<doc:long,line:int,rid:long,rid2:long>"
_PARITY = ["even", "odd"]


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc, rid, rid2, text binary); a null doc_id comes last."""
    last = (1 << 63) - 1
    keyed = _keyed(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc"), F.col("text").cast("binary").alias("text"))
    return keyed.select("doc", *KEY, "text")


def line_sets(docs: DataFrame, codes: np.ndarray, threshold: Fraction, shingle: int, least: int, crowd: int) -> DataFrame:
    """Distinct shingle sets: (s set hash, n, rare: how many of its words can't be crowded, first (doc, line, rid, rid2) of its earliest line, words: prefix shingles by place and one more,
    parities of 128 hashed bits). Sets are equal if size, hash and parities are: 192 bits."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = LineSets(shared.value, threshold, shingle, least, crowd)
        for batch in batches:
            doc, rid, rid2 = (batch.column(i).to_numpy() for i in range(3))
            for row, line, size, words in sets.maker.lines(batch.column(3).to_pylist()):
                s, n, rare, offset, taken, parity = sets.sets(size, words)
                first = pa.StructArray.from_arrays([pa.array(doc[row]), pa.array(line.astype(np.int32)), pa.array(rid[row]), pa.array(rid2[row])], ["doc", "line", *KEY])
                prefix = pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(taken))
                yield pa.record_batch([pa.array(s), pa.array(n.astype(np.int32)), pa.array(rare.astype(np.int32)), first, prefix, *map(pa.array, parity)], ["s", "n", "rare", "first", "words", *_PARITY])
        release_memory()

    small_batches(docs.sparkSession)
    lines = _ordered(docs).mapInArrow(run, f"s long, n int, rare int, first {_FIRST}, words array<long>, " + ", ".join(f"{c} long" for c in _PARITY))
    return lines.groupBy("s", "n", "rare", *_PARITY).agg(F.min("first").alias("first"), F.first("words").alias("words"))


_ROW = ["key", "base", "place", "prev", "sid", "parts"]


def _exploded(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """A row for each set and shingle of its prefix: columns of _ROW, words and rare."""
    p, q = threshold.numerator, threshold.denominator
    prefix = F.col("n") - F.ceil(F.col("n") * p / F.lit(q)).cast("int") + 1
    rows = sets.filter(F.size("words") > 0).select("sid", "words", "rare", "base", prefix.alias("prefix"), F.posexplode("words").alias("place", "key")).filter("place < prefix")
    prev = F.when(F.col("place") > 0, F.get("words", F.col("place") - 1)).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("prev", prev).withColumn("parts", F.lit(1).cast("long")).drop("prefix")


class _Keys:
    """The keys that sets meet under.

    Keys are the shingles of the prefix. A shingle in more than ``crowd`` prefixes gives way to pairs of it and a later one of the prefix longer by
    one: lines that match share two shingles of those, and meet under the first two that they share. Pairs that are crowded too, as in families of
    near-copies, are dealt into ``parts`` of about ``crowd`` sets."""

    def __init__(self, sets: DataFrame, threshold: Fraction, crowd: int):
        self.threshold = threshold
        some = _exploded(sets, threshold).filter("place >= rare")
        self.often = materialize(some.groupBy("key").agg(F.count("*").alias("often")).filter(F.col("often") > crowd))
        self.crowded, self.split = self.often.limit(1).count() > 0, False
        if self.crowded:
            later = F.explode(F.slice("words", F.col("place") + 2, F.greatest(F.size("words") - F.col("place") - 1, F.lit(0))))
            rows = _small(self.often.select("key"), some.join, "key", "left_semi").select(*_ROW, later.alias("later"))
            pairs = materialize(rows.withColumn("key", F.xxhash64("key", "later")).drop("later"))
            again = pairs.groupBy("key").agg(F.count("*").alias("often")).filter(F.col("often") > crowd)
            again = materialize(again.select("key", F.ceil(F.col("often") / crowd).alias("many")))
            self.split = again.limit(1).count() > 0
            self.pairs = pairs
            if self.split:
                self.pairs = _small(again, pairs.join, "key", "left").withColumn("parts", F.coalesce("many", F.lit(1).cast("long"))).select(*_ROW)

    def rows(self, sets: DataFrame, some: DataFrame | None = None) -> DataFrame:
        """Rows of _ROW of the sets, or of those in ``some`` (sid)."""
        rows = _exploded(sets if some is None else _small(some, sets.join, "sid", "left_semi"), self.threshold)
        if not self.crowded:
            return rows.select(*_ROW)
        pairs = self.pairs if some is None else _small(some, self.pairs.join, "sid", "left_semi")
        return _small(self.often, rows.join, "key", "left_anti").select(*_ROW).union(pairs.select(*_ROW))


def _part(part: Column) -> Column:
    return F.when(F.col("parts") > 1, F.xxhash64("key", part)).otherwise(F.col("key"))


def _own_part(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", _part(F.pmod(F.xxhash64("sid"), F.col("parts"))))


def _packed() -> Column:
    """sid, doc, line and n, and the parities as big-endian longs in one value: a row of one long crosses to Python as fast as this."""
    both = F.shiftleft(F.col("first.line").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (F.col("sid"), F.col("first.doc"), both, *map(F.col, _PARITY))]))


def _longs(packed: pa.Array) -> np.ndarray:
    """Rows of the big-endian longs of ``base``."""
    _, offsets, data = packed.buffers()
    first = np.frombuffer(offsets, np.int32)[packed.offset]
    return np.frombuffer(data, ">i8", 5 * len(packed), first).reshape(-1, 5)


def _in_order(group: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The order of rows of :func:`_longs` by group, doc, line and parities. One number for each row tells it, where it fits one and no two are alike."""
    doc, line = base[:, 1], base[:, 2] >> 32
    if len(group) and group[-1] < 1 << 17 and doc.min() >= 0 and doc.max() < 1 << 31 and line.max() < 1 << 15:
        key = group << 46 | doc << 15 | line
        order = np.argsort(key)
        one = key[order]
        if not (one[1:] == one[:-1]).any():
            return order
    return np.lexsort((base[:, 4], base[:, 3], line, doc, group))


def _candidates(rows: DataFrame, threshold: Fraction, leaders: int | None) -> DataFrame:
    """(key, base, place, prev, asked, held) -> written (x, y, more): pairs that pass the filters under a key; x is asked for, y held,
    and y comes before x by (doc, line, parities).

    With ``leaders``, each x has its first so many y, and if others follow the next with the key as ``more``, null elsewhere; else all of them. A
    pair that also shares the shingle before is told under that one, where it passes the same filters, if not as the sign of more."""
    p, q = threshold.numerator, threshold.denominator

    def pairs(key: np.ndarray, code: np.ndarray, prev: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cut, len(key)])
        several = np.repeat(size > 1, size)
        group = np.repeat(np.arange(len(cut)), size)[several]
        own = np.flatnonzero(several)
        base = base[own].astype(np.int64)
        order = _in_order(group, base)
        sid, n, even, odd = (np.ascontiguousarray(base[order, c]) for c in (0, 2, 3, 4))
        n, even, odd = n & 0xFFFFFFFF, even.view(np.uint64), odd.view(np.uint64)
        key, code, prev = (c[own[order]] for c in (key, code, prev))
        size = size[size > 1]
        start = np.repeat(np.cumsum(size) - size, size)
        place, held, asked = code >> 2, code & 2 > 0, code & 1 > 0
        i, k = np.flatnonzero((start < np.arange(len(start))) & asked), 0
        found = np.zeros(len(start), np.int64)
        most = leaders or len(start)
        while len(i):
            j = start[i] + k
            ni, nj = n[i], n[j]
            near = np.flatnonzero((np.minimum(ni, nj) * q >= np.maximum(ni, nj) * p) & held[j])  # each test is asked of what passed those before it
            a, b, total = i[near], j[near], (ni + nj)[near]
            apart = np.bitwise_count(even[a] ^ even[b]).astype(np.int64) + np.bitwise_count(odd[a] ^ odd[b])
            left = np.flatnonzero((total - apart) * (p + q) >= 2 * p * total)
            a, b = a[left], b[left]
            hit = near[left][(np.minimum(n[a] - place[a], n[b] - place[b]) * (p + q) >= p * total[left]) & (sid[a] != sid[b])]
            if len(hit):
                found[i[hit]] += 1
                more = found[i[hit]] > most
                told = more | (prev[i[hit]] == 0) | (prev[i[hit]] != prev[j[hit]])
                hit, more = hit[told], more[told]
                yield pa.record_batch([pa.array(sid[i[hit]]), pa.array(sid[j[hit]]), pa.array(key[i[hit]], mask=~more)], ["x", "y", "more"])
            k += 1
            i = i[(start[i] + k < i) & (found[i] <= most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []  # batches of the key that is not yet whole
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]), _longs(batch.column(3))]
            other = np.searchsorted(now[0], now[0][-1])  # rows come in order of key
            if other or (rest and rest[-1][0][-1] != now[0][0]):
                done = [*rest, [c[:other] for c in now]]
                yield from pairs(*(np.concatenate(c) for c in zip(*done, strict=True)))
                rest, now = [], [c[other:] for c in now]
            rest.append(now)
        if rest:
            yield from pairs(*(np.concatenate(c) for c in zip(*rest, strict=True)))
        release_memory()

    code = F.shiftleft(F.col("place").cast("long"), 2).bitwiseOR(F.shiftleft(F.col("held").cast("long"), 1)).bitwiseOR(F.col("asked").cast("long"))
    dealt = rows.select("key", code.alias("code"), "prev", "base").repartition("key").sortWithinPartitions("key")
    with batch_rows(rows.sparkSession, 65536):
        return materialize(dealt.mapInArrow(run, "x long, y long, more long").distinct())


def _verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, threshold: Fraction, shingle: int) -> DataFrame:
    """(sid): those x of written pairs (x, y) that verify. Whole sets are made, by another look at the texts, for the sets in pairs alone."""
    p, q = threshold.numerator, threshold.denominator
    pairs = pairs.select("x", "y").distinct()
    wanted = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct()
    places = sets.select("sid", F.col("first.rid").alias("rid"), F.col("first.rid2").alias("rid2"), F.col("first.line").alias("line")).join(wanted, "sid")
    lists = materialize(places.groupBy(*KEY).agg(F.collect_list(F.struct("line", "sid")).alias("lines")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles(shingle, 1)
        for batch in batches:
            ids, raw, total = [], [], 0
            for i, (text, lines) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                split = text.split(b"\n")
                for x in lines:
                    ids.append(x["sid"])
                    raw.append(split[x["line"]])
                    total += len(raw[-1]) + 1
                if total > _AT_ONCE or i == batch.num_rows - 1:
                    line, words, feeds = maker.words(b"\n".join([*raw, b""]))
                    row, h = maker.hashes(np.bincount(line, minlength=len(feeds)), words)
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order].view(np.int64)
                    one = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
                    row, h = row[one], h[one]
                    offset = np.searchsorted(row, np.arange(len(ids) + 1))
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(h))], ["sid", "tokens"])
                    ids, raw, total = [], [], 0
        release_memory()

    texts = _ordered(docs).select(*KEY, "text")
    if lists.count() <= _FEW:
        texts = texts.join(F.broadcast(lists.select("rid")), "rid", "left_semi")
    texts = texts.join(lists.hint("shuffle_hash"), KEY).select("text", "lines")
    small_batches(docs.sparkSession)
    words = materialize(texts.mapInArrow(fetch, "sid long, tokens array<long>").dropDuplicates(["sid"]))
    full = pairs.join(words.select(F.col("sid").alias("x"), F.col("tokens").alias("xt")), "x").join(words.select(F.col("sid").alias("y"), F.col("tokens").alias("yt")), "y")
    full = full.filter(F.size(F.array_intersect("xt", "yt")) * (p + q) >= p * (F.size("xt") + F.size("yt")))
    found = materialize(full.select(F.col("x").alias("sid")).distinct())
    drop(lists)
    drop(words)
    return found


def _known(docs: DataFrame, told: DataFrame, sets: DataFrame, threshold: Fraction, shingle: int) -> DataFrame:
    """(sid), written: sets of told documents that verify against that of the earlier one they are told with."""
    x, y = sets.select(F.col("sid").alias("x"), F.col("first.doc").alias("doc")), sets.select(F.col("sid").alias("y"), F.col("first.doc").alias("earlier"))
    pairs = materialize(told.filter("earlier < doc").select("doc", "earlier").distinct().join(x, "doc").join(y, "earlier").select("x", "y"))
    found = _verified(docs, pairs, sets, threshold, shingle)
    drop(pairs)
    return found


def _small(side: DataFrame, join: Callable, on: str, how: str = "inner") -> DataFrame:
    """Join with a written table of few columns, broadcast if its counted rows are few."""
    return join(F.broadcast(side) if side.count() <= _FEW else side, on, how)


def _settled(docs: DataFrame, sets: DataFrame, keys: _Keys, open_: DataFrame, crowd: int, threshold: Fraction, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(those of the open sets that an open one removes, the others): rounds among the open sets of keys in parts, until few more go. Each
    round leaves a few leaders of a family in each part, so families of any size are settled in rounds of falling size."""
    gone, before = open_.limit(0), open_.count()
    while True:
        left = keys.rows(sets, open_).filter("parts > 1").drop("parts")
        sizes = left.groupBy("key").agg(F.ceil(F.count("*") / crowd).alias("parts"))
        dealt = _own_part(left.join(sizes, "key")).withColumn("asked", F.lit(True)).withColumn("held", F.lit(True))
        pairs = _candidates(dealt, threshold, LEADERS)
        found = _verified(docs, pairs, sets, threshold, shingle)
        open_, gone = materialize(open_.join(found, "sid", "left_anti")), gone.union(found).distinct()
        drop(pairs)
        now = open_.count()
        if now * 2 > before:
            return gone, open_
        before = now


@owned
def kept_lines(docs: DataFrame, threshold: Fraction = THRESHOLD, shingle: int = SHINGLE, least: int = LEAST_WORDS, buckets: int | None = None, crowd: int | None = None, told: DataFrame | None = None) -> DataFrame:
    """(rid, rid2, kept array<int>): numbers of the lines that are the earliest of their set and match no earlier one.

    ``told`` (doc, earlier) names documents that another method takes for alike, for documents of one line each: their sets are verified first, and
    those that match are not asked for in the join, which finds the others."""
    crowd = crowd or CROWD
    found = line_sets(docs, rarity(docs, buckets, shingle, least), threshold, shingle, least, crowd)
    numbered = found.withColumn("sid", F.monotonically_increasing_id())  # numbers hold once they are written
    sets = materialize(numbered.withColumn("base", _packed()).drop(*_PARITY))
    keys = _Keys(sets, threshold, crowd)
    rows, split = keys.rows(sets), keys.split
    both = _own_part(rows).withColumn("asked", F.lit(True)).withColumn("held", F.lit(True))
    known = None if told is None else _known(docs, told, sets, threshold, shingle)
    if known is not None:
        both = _small(known.withColumn("asked", F.lit(False)), both.drop("asked").join, "sid", "left").withColumn("asked", F.coalesce("asked", F.lit(True)))
    pairs = _candidates(both.select(*_ROW, "asked", "held"), threshold, LEADERS)
    gone = _verified(docs, pairs, sets, threshold, shingle)
    gone = gone if known is None else gone.union(known).distinct()
    # sets that stand although a pair that was not looked at, under the key that told of more, may remove them
    open_ = pairs.filter("more is not null").select(F.col("x").alias("sid"), F.col("more").alias("key")).distinct()
    if split:
        apart = materialize(rows.filter("parts > 1").select("sid").distinct().join(gone, "sid", "left_anti"))
        more, apart = _settled(docs, sets, keys, apart, crowd, threshold, shingle)
        gone = gone.union(more)
    open_ = materialize(open_.join(gone, "sid", "left_anti"))
    met = materialize(open_.select("key").distinct())
    asked = open_.withColumn("asked", F.lit(True))
    near = _small(met, rows.filter("parts = 1").join, "key", "left_semi").join(asked, ["sid", "key"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    near = near.withColumn("held", F.lit(True)).select(*_ROW, "asked", "held")
    if split:
        wanted = keys.rows(sets, apart).filter("parts > 1")
        crowded = _small(materialize(wanted.select("key").distinct()), rows.filter("parts > 1").join, "key", "left_semi")
        held = _own_part(crowded).select(*_ROW, F.lit(False).alias("asked"), F.lit(True).alias("held"))
        every = wanted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        near = near.union(held).union(every.withColumn("key", _part(F.col("part"))).select(*_ROW, F.lit(True).alias("asked"), F.lit(False).alias("held")))
    if split or met.limit(1).count():
        last = _candidates(near, threshold, None)
        gone = gone.union(_verified(docs, last, sets, threshold, shingle)).distinct()
    kept = sets.select("sid", "first").join(gone, "sid", "left_anti")
    out = materialize(kept.groupBy(F.col("first.rid").alias("rid"), F.col("first.rid2").alias("rid2")).agg(F.collect_list("first.line").alias("kept")))
    drop(sets)
    drop(pairs)
    return out


def rebuild(text: bytes | None, kept: list[int] | None, least: int = LEAST_WORDS) -> tuple[bytes | None, int, int]:
    """(text without the lines removed, number of lines, number of those removed)."""
    if text is None:
        return None, 0, 0
    lines, held = text.split(b"\n"), set(kept or ())
    left = [x for i, x in enumerate(lines) if i in held or len(x.split()) < least]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def _joined(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(row struct of docs' columns, kept)."""
    return _keyed(docs, whole_row(docs)).join(kept.hint("shuffle_hash"), KEY, "left").select("row", "kept")


def _rebuilt(batch: pa.RecordBatch, least: int) -> list[tuple[bytes | None, int, int]]:
    texts = batch.column(0).field("text").cast(pa.binary()).to_pylist()
    return [rebuild(x, k, least) for x, k in zip(texts, batch.column(1).to_pylist(), strict=True)]


def dedup_lines(docs: DataFrame, threshold: Fraction = THRESHOLD, shingle: int = SHINGLE, least: int = LEAST_WORDS, buckets: int | None = None, crowd: int | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, text, kept_text, n_lines long, n_removed long), a row per input row; lines end at line feeds.

    Null text stays null, with no lines; empty text is one line that stays, as do lines of fewer than ``least`` words. A very long text or line
    is one like any other. Rows that repeat both doc_id and text share one decision on each line; a null doc_id counts as the last, and among
    lines of one number under one doc_id, in different texts, a hash of the set sets the order. An empty table gives no rows.
    Other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _rebuilt(batch, least)
        new = pa.array([x[0] for x in found], pa.binary()).cast(pa.string())
        return pa.record_batch([batch.column(0).field("doc_id"), batch.column(0).field("text"), new, *(pa.array([x[i] for x in found], pa.int64()) for i in (1, 2))], ["doc_id", "text", "kept_text", "n_lines", "n_removed"])

    joined = _joined(docs, kept_lines(docs, threshold, shingle, least, buckets, crowd))
    return map_batches(joined, run, "doc_id long, text string, kept_text string, n_lines long, n_removed long")


def replace_text(docs: DataFrame, threshold: Fraction = THRESHOLD, shingle: int = SHINGLE, least: int = LEAST_WORDS, buckets: int | None = None, crowd: int | None = None) -> DataFrame:
    """All rows and columns of docs, whatever their names, with ``text`` less the lines that :func:`dedup_lines` removes, under the same rules."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = {c: batch.column(0).field(c) for c in names}
        columns["text"] = pa.array([x[0] for x in _rebuilt(batch, least)], pa.binary()).cast(pa.string())
        return pa.record_batch(list(columns.values()), names)

    return map_batches(_joined(docs, kept_lines(docs, threshold, shingle, least, buckets, crowd)), run, docs.schema)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of :func:`dedup_lines` over documents, on single words and lines of any length."""
    found = dedup_lines(table(spark, sf_dir, "documents"), shingle=WORD, least=ANY_WORDS)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
