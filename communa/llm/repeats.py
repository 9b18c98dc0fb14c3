"""Removal of long repeated byte strings with run-length compressed Burrows-Wheeler indexes.

A string of ``length`` bytes (a window) is removed wherever it starts twice or more in the corpus. No index of the
whole corpus is built; windows are first brought together with all their possible equals:

* Each window is filed under its anchor, the ``ANCHOR``-byte string of least hash in it. Equal windows have equal anchors
  at equal places, and the windows of a text that share one anchor position are a run, cut out of the text as one span.
* Spans whose anchor occurs once in the corpus have no equals. Equal spans under an anchor collapse to one with a count.
* Spans under an anchor that are neither alone nor all equal are put, whole anchors together, into shards of about
  ``SHARD`` bytes. A shard gets a run-length compressed BWT with a sample at either end of each run: the text place and its
  longest common prefix with the neighbour in suffix order. Between samples that length falls by one a place
  (irreducible-LCP theorem), so one pass over the shard's text streams the matching statistics of every place against
  all others, and windows whose statistic reaches ``length`` are marked.
* An anchor with more than ``CROWD`` distinct spans never becomes one shard: its windows are counted one by one under a
  128-bit hash, which is linear and spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communa.llm.common import map_batches, release_memory, small_batches, table
from communa.storage import drop, materialize, owned

LENGTH = 400
ANCHOR = 128
#: Distinct spans under one anchor that a shard takes.
CROWD = 4096
#: Bytes of text that are indexed at once; a shard is closed at the first anchor past it.
SHARD = 1 << 19
#: Bytes of text that are cut into spans at once; a longer text goes in pieces.
_PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = np.uint64((1 << 24) - 1)


def _rolling(x: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the k bytes from each place, k a power of two."""
    h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    base, n = _BASE, 1
    with np.errstate(over="ignore"):
        while n < k:
            h = h[:-n] * base + h[n:]
            base, n = base * base, 2 * n
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    got = 1
    while 2 * got <= n:
        x = np.minimum(x[:-got], x[got:])
        got *= 2
    return np.minimum(x[: len(x) - (n - got)], x[n - got :]) if n > got else x


def runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts x[start:end] side by side -> (text, first window, last window, anchor hash) of each run, in order."""
    h = _rolling(x, anchor)
    least = _sliding_min(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
    number = np.maximum(ends - starts - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), number)
    window = np.arange(len(text)) + np.repeat(starts - np.r_[0, np.cumsum(number)[:-1]], number)
    place = (least[window] & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]) if len(text) else np.empty(0, np.int64)
    tail = np.r_[head[1:], len(text)] - 1 if len(head) else head
    return text[head], window[head], window[tail], h[place[head]].view(np.int64)


def _pieces(texts: list[tuple[int, bytes]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, text) pairs -> groups of (row, offset, bytes) of about _PIECE bytes; pieces of one text overlap by length - 1 bytes."""
    group, total = [], 0
    for row, text in texts:
        for at in range(0, max(1, len(text) - length + 1), _PIECE):
            part = text[at : at + _PIECE + length - 1]
            if len(part) >= length:
                group.append((row, at, part))
                total += len(part)
            if total >= _PIECE:
                yield group
                group, total = [], 0
    if group:
        yield group


#: The columns that name a text: two hashes of doc_id and text, 128 bits together.
KEY = ["rid", "rid2"]
_KEY = "rid long, rid2 long"
_CELL = f"anchor long, span long, {_KEY}, first int, last int, times int"


def cells(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """(rid, rid2, text binary) -> runs (anchor, span hash, rid, rid2, first and last window, times), and with ``times`` 0 ranges of
    windows that repeat within a piece: those repeats are marked at once, and stand for two of their kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            texts = [(i, x) for i, x in enumerate(batch.column(2).to_pylist()) if x and len(x) >= length]
            for group in _pieces(texts, length):
                size = np.array([len(x) for _, _, x in group])
                ends = np.cumsum(size)
                raw = b"".join([x for _, _, x in group])
                text, first, last, a = runs(np.frombuffer(raw, np.uint8), ends - size, ends, length, anchor)
                view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
                span = np.fromiter((digest(view[i : j + length]) for i, j in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first)).view(np.int64)
                shift = np.array([at for _, at, _ in group]) - (ends - size)
                rid, rid2 = (k[[r for r, _, _ in group]] for k in keys)
                first, last = first + shift[text], last + shift[text]
                order = np.lexsort((span, a, text))
                same = (text[order][1:] == text[order][:-1]) & (a[order][1:] == a[order][:-1]) & (span[order][1:] == span[order][:-1])
                lead = np.flatnonzero(np.r_[True, ~same])
                times = np.minimum(np.diff(np.r_[lead, len(order)]), 2)
                pick = order[lead]
                out = [a[pick], span[pick], rid[text[pick]], rid2[text[pick]], first[pick], last[pick], times]
                twice = np.zeros(len(order), bool)
                twice[order] = np.r_[False, same] | np.r_[same, False]
                if twice.any():
                    at = np.flatnonzero(twice)
                    joined = np.flatnonzero(np.r_[True, (text[at][1:] != text[at][:-1]) | (first[at][1:] != last[at][:-1] + 1)])
                    stop = np.r_[joined[1:], len(at)] - 1
                    none = np.zeros(len(joined), np.int64)
                    out = [np.concatenate(x) for x in zip(out, [none, none, rid[text[at[joined]]], rid2[text[at[joined]]], first[at[joined]], last[at[stop]], none], strict=True)]
                yield pa.record_batch([pa.array(v.astype(np.int64 if i < 4 else np.int32)) for i, v in enumerate(out)], [c.split()[0] for c in _CELL.split(", ")])

            release_memory()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, _CELL)


class RunLengthIndex:
    """Run-length compressed BWT of strings side by side, each closed by an end that is below all bytes and equal to none."""

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) for s in strings], np.int64)
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.n = len(self.text)
        stop = np.cumsum(size)
        self.end = np.repeat(stop, size)  # of the string that holds a place
        self.begin = np.zeros(self.n, bool)
        self.begin[(stop - size)[size > 0]] = True
        self._sort(int(size.max(initial=0)))
        order = self.order
        previous = np.where(self.begin[order], -1, self.text[order - 1].astype(np.int16))
        edge = np.r_[True, (previous[1:] != previous[:-1]) | (previous[1:] < 0)] if self.n else np.empty(0, bool)
        self.heads = np.flatnonzero(edge)  # ranks at which runs of the BWT begin
        self.symbols = previous[self.heads]
        inner = self.heads[self.heads > 0]
        common = self._common(order[inner - 1], order[inner])
        # samples: at each run's first place the prefix shared with the suffix before it, at each last place with that after it
        self.head_place, self.head_length = order[self.heads], np.r_[0, common][: len(self.heads)]
        self.tail_place = np.r_[order[inner - 1], order[-1:]]
        self.tail_length = np.r_[common, 0][: len(self.tail_place)]
        del self.order, self.begin, self.end, self.text  # what is kept is two samples for each run

    def _sort(self, longest: int) -> None:
        """Suffix order by doubling; equal suffixes of different strings stand in order of place."""
        n = self.n
        key = np.zeros(n, np.int64)
        at = np.arange(n)
        for i in range(7):
            inside = at + i < self.end
            part = np.zeros(n, np.int64)
            part[: max(0, n - i)] = self.text[i:].astype(np.int64) + 1
            key = key << 9 | np.where(inside, part, 0)
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.empty(0, bool)
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # a tie holds the rank of its first
        depth = 7
        while depth < longest:
            single = new & np.r_[new[1:], True]
            open_ = np.flatnonzero(~single)
            if not len(open_):
                break
            where = order[open_]
            ahead = where + depth
            second = np.where(ahead < self.end[where], rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank[where] << 32 | second
            again = np.argsort(key, kind="stable")
            where, key = where[again], key[again]
            order[open_] = where
            fresh = np.r_[True, key[1:] != key[:-1]]
            new[open_] = fresh
            rank[where] = open_[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
            depth *= 2
        if len(open_ := np.flatnonzero(~(new & np.r_[new[1:], True]))) if n else False:
            # what is still tied is equal to its end: in order of place within each tie
            where = order[open_]
            order[open_] = where[np.lexsort((where, rank[where]))]
        self.order = order

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes at i and j, in their strings."""
        most = np.minimum(self.end[i] - i, self.end[j] - j)
        out = np.zeros(len(i), np.int64)
        open_ = np.flatnonzero(most > 0)
        padded = np.r_[self.text, np.zeros(32, np.uint8)]
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        while len(open_):
            a, b = words[i[open_] + out[open_]], words[j[open_] + out[open_]]
            unlike = a != b
            step = np.where(unlike.any(1), unlike.argmax(1), 8)
            out[open_] = np.minimum(out[open_] + step, most[open_])
            open_ = open_[(step == 8) & (out[open_] < most[open_])]
        return out

    def statistics(self) -> np.ndarray:
        """For each place the length of the longest string from there that also starts at another place."""
        out = np.zeros(self.n, np.int64)
        at = np.arange(self.n)
        for place, length in ((self.head_place, self.head_length), (self.tail_place, self.tail_length)):
            last = np.full(self.n, -1)
            last[place] = place
            value = np.zeros(self.n, np.int64)
            value[place] = length
            last = np.maximum.accumulate(last)
            out = np.maximum(out, value[last] - (at - last))
        return out


def long_matches(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Places of each string from which ``length`` bytes also start elsewhere in these strings."""
    index = RunLengthIndex(strings)
    hits = np.flatnonzero(index.statistics() >= length)
    stop = np.cumsum([len(s) for s in strings])
    cut = np.searchsorted(hits, stop)
    return [h - (e - len(s)) for h, s, e in zip(np.split(hits, cut[:-1]), strings, stop.tolist(), strict=True)]


def _ranges(places: np.ndarray) -> list[tuple[int, int]]:
    head = np.flatnonzero(np.r_[True, places[1:] != places[:-1] + 1]) if len(places) else np.empty(0, np.int64)
    return list(zip(places[head].tolist(), places[np.r_[head[1:], len(places)] - 1].tolist(), strict=True)) if len(places) else []


_MARK = f"{_KEY}, first int, last int"


def _indexed(spans: DataFrame, length: int, shard: int) -> DataFrame:
    """(anchor, rid, rid2, first, times, bytes) in whole anchors -> marked ranges of windows of the spans seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, int, bytes]] = []
        total = 0

        def close() -> pa.RecordBatch:
            marks = [(rid, rid2, first + a, first + b) for (_, rid, rid2, first, times, _), found in zip(held, long_matches([x[5] for x in held], length), strict=True) if times == 1 for a, b in _ranges(found)]
            release_memory()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.record_batch([pa.array([m[i] for m in marks], kind) for i, kind in enumerate(kinds)], [*KEY, "first", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total >= shard and row[0] != held[-1][0]:
                    yield close()
                    held, total = [], 0
                held.append(row)
                total += len(row[5])
        if held:
            yield close()

    small_batches(spans.sparkSession)
    return spans.repartition("anchor").sortWithinPartitions("anchor", *KEY, "first").select("anchor", *KEY, "first", "times", "bytes").mapInArrow(run, _MARK)


def _cut(rows: DataFrame, picked: DataFrame, length: int) -> DataFrame:
    """Texts joined with the spans picked of them -> (anchor, rid, rid2, first, times, bytes)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(s["anchor"], rid, rid2, s["first"], s["times"], text[s["first"] : s["last"] + length]) for rid, rid2, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s in spans]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["anchor", *KEY, "first", "times", "bytes"])

    lists = picked.groupBy(*KEY).agg(F.collect_set(F.struct("anchor", "first", "last", "times")).alias("spans"))
    return map_batches(rows.join(lists, KEY).select(*KEY, "text", "spans"), run, f"anchor long, {_KEY}, first int, times int, bytes binary")


def _counted(spans: DataFrame, length: int) -> DataFrame:
    """Spans of crowded anchors -> marked windows, by counting each window under a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rid, rid2, first, times, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view = memoryview(text)
                both = [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(len(text) - length + 1)]
                h = np.frombuffer(b"".join(both), "<i8").reshape(-1, 2)
                at = np.arange(first, first + len(both), dtype=np.int32)
                yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(len(at), rid)), pa.array(np.full(len(at), rid2)), pa.array(at), pa.array(np.full(len(at), times, np.int32))], ["h", "g", *KEY, "first", "times"])

    windows = spans.mapInArrow(run, f"h long, g long, {_KEY}, first int, times int")
    often = windows.groupBy("h", "g").agg(F.sum("times").alias("n")).filter("n > 1").select("h", "g")
    return windows.join(often, ["h", "g"]).select(*KEY, "first", F.col("first").alias("last"))


def marks(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """(rid, rid2, text binary) -> written (rid, rid2, ranges array<(first, last)>): ranges of windows to remove, each once. Rows that share a key share a text."""
    found = materialize(cells(rows, length, anchor))
    own = found.filter("times > 0")
    spans = own.groupBy("anchor", "span").agg(F.sum("times").alias("times"), F.min(F.struct(*KEY, "first", "last")).alias("at"))
    # a few columns of the distinct spans are read three times over
    spans = materialize(spans.select("anchor", "span", F.least(F.col("times"), F.lit(2)).cast("int").alias("times"), "at.rid", "at.rid2", "at.first", "at.last"))
    kinds = spans.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = materialize(spans.join(kinds, "anchor").select("anchor", *KEY, "first", "last", "times", (F.col("kinds") > crowd).alias("crowded")))
    repeated = spans.filter("times > 1").select("anchor", "span")
    out = found.filter("times = 0").select(*KEY, "first", "last").union(own.join(repeated, ["anchor", "span"]).select(*KEY, "first", "last"))
    out = out.union(_indexed(_cut(rows, mixed.filter("not crowded"), length), length, shard))
    if mixed.filter("crowded").limit(1).count():
        out = out.union(_counted(materialize(_cut(rows, mixed.filter("crowded"), length)), length))
    lists = materialize(out.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("ranges")))  # rows that repeat add nothing
    for made in (found, spans, mixed):
        drop(made)
    return lists


def kept(text: bytes, ranges: list[dict], length: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """(what is left of a text, in pieces, its maximal removed runs as (start, end))."""
    order = sorted((r["first"], r["last"] + length) for r in ranges)
    a, b = np.array([x[0] for x in order]), np.maximum.accumulate(np.array([x[1] for x in order]))
    head = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    tail = np.r_[head[1:], len(a)] - 1
    cut = list(zip(a[head].tolist(), b[tail].tolist(), strict=True))
    left, at = [], 0
    for i, j in cut:
        left.append(text[at:i])
        at = j
    left.append(text[at:])
    return left, cut


@owned
def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, kept binary, n_bytes, n_removed, n_spans, text string, spans array<(start, end)>), a row per input row; spans are
    the maximal removed runs, in bytes of the old text, end exclusive. text is what is left, without the characters that a cut goes through.

    Every byte goes that a string of ``length`` bytes covers which also starts elsewhere, in the same text or another.
    Null text counts as empty; texts shorter than ``length`` stay whole; very long ones are cut into overlapping pieces for the
    windows and back into one for the result. Rows that repeat doc_id and text, or the text alone, are texts of their own and remove each
    other; no order among them matters. An empty table gives no rows. Other columns are left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(doc, text).alias("rid"), F.xxhash64(F.lit(1), text, doc).alias("rid2"))
    lists = marks(rows.select(*KEY, "text"), length, anchor, crowd, shard)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(x, *(kept(x, r, length) if r else ([x], []))) for x, r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
        numbers = ([len(x) for x, _, _ in out], [sum(b - a for a, b in cut) for _, _, cut in out], [len(cut) for _, _, cut in out])
        spans = pa.array([[{"start": a, "end": b} for a, b in cut] for _, _, cut in out], span)
        left = pa.array([b"".join(x) for _, x, _ in out], pa.binary())
        text = pa.array(["".join([p.decode("utf-8", "ignore") for p in x]) for _, x, _ in out], pa.string())
        return pa.record_batch([batch.column(0), left, *(pa.array(n, pa.int64()) for n in numbers), text, spans], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "text", "spans"])

    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, text string, spans array<struct<start:long,end:long>>"
    return map_batches(rows.join(lists, KEY, "left").select("doc_id", "text", "ranges"), run, schema)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of :func:`remove_repeats` over documents, and beside it ``text``, what is left, and the removed ``spans`` as start:end, comma-joined."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text", spans.alias("spans"))
