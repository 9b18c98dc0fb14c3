"""Best-fit packing of token sequences by bin completion.

The largest document left is completed by undominated fillings, branches are cut by their waste, and best-fit solutions are the incumbents; where
these miss the lower bound by much, fillings are chosen by prices first, see :func:`plan`.

A packing depends only on how many pieces there are of each length, so the driver plans on that histogram (at most
``capacity`` rows, however large the corpus) and the pieces, ranked within their length, look their place up in
the plan. Ranks are counted in salted groups: a length that holds a third of all pieces stays spread out.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from communa.llm.common import release_memory, small_batches, table
from communa.storage import materialize

CAPACITY = 2048
#: Groups that the pieces of one length are counted in.
SALT = 256
#: Steps of the search for fillings around one document; of the search over whole packings, at least and for each length; and numbers that the
#: pricing of fillings may touch. What is left when they run out is packed by best fit: these bound the driver's time, not what is packed.
FILL_STEPS, SEARCH_STEPS, STEPS_EACH, PRICING = 300, 4000, 10, 4_000_000_000
#: Steps in which the search over whole packings neither gets deeper than before nor finds a better one, after which it ends.
IDLE_STEPS = 1000
#: Prices are asked for only where best fit may be over the lower bound by more than one in so many bins: what rounding loses is more than that.
WORTH_PRICING = 1000
#: Pre-tokens that a worker remembers, and the longest that it does.
REMEMBERED, LONG = 700_000, 64
#: Words of letters that one call to the tokenizer takes.
_JOINED = 500
#: Words whose letters fold alike everywhere, and such words as letters and a tail of punctuation.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_LATIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

Pattern = tuple[int, ...]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


class WordEncoder:
    """Ids of whole texts. The tokenizer drops white space and never joins over it, so words between spaces and line
    ends are encoded once and remembered. Most words are Latin letters and a tail of punctuation: the tokenizer folds
    case and parts the two, so letters and tails are encoded apart, many to a call where word ends show in the ids."""

    def __init__(self, path: str):
        tokenizer = _tokenizer(path)
        self.encode, suffix = tokenizer.encode_batch, tokenizer.model.end_of_word_suffix
        self.known = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}
        self.ends = np.zeros(1 + max(tokenizer.get_vocab().values(), default=0), bool)
        self.ends[[i for w, i in tokenizer.get_vocab().items() if suffix and w.endswith(suffix)]] = True

    def _several(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of letters."""
        if not self.ends.any():
            yield from (np.array(e.ids, "<u4").tobytes() for e in self.encode(words, add_special_tokens=False))
            return
        for at in range(0, len(words), _JOINED):
            part = words[at : at + _JOINED]
            ids = np.array(self.encode([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            code = ids.tobytes()
            yield from (code[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True))

    def learn(self, words: list[str]) -> dict[str, bytes]:
        split = {w: m.groups() for w in words if len(w) <= LONG and (m := _LATIN(w.lower() if _PLAIN(w) else ""))}
        cores = list({a for a, _ in split.values() if a not in self.parts})
        self.parts.update(zip(cores, self._several(cores), strict=True))
        rest = list({b for _, b in split.values() if b not in self.parts})
        odd = [w for w in words if w not in split]
        codes = [np.array(e.ids, "<u4").tobytes() for e in self.encode(rest + odd, add_special_tokens=False)]
        self.parts.update(zip(rest, codes, strict=False))
        own = {w: self.parts[a] + self.parts[b] for w, (a, b) in split.items()}
        return own | dict(zip(odd, codes[len(rest) :], strict=True))

    def texts(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.parts = {"": b""}, {"": b""}
        split = [(x or "").replace("\n", " ").split(" ") for x in texts]
        known = self.known
        own = self.learn([w for w in set().union(*split) if w not in known])
        known.update((w, c) for w, c in own.items() if len(w) <= LONG)
        if any(len(w) > LONG for w in own):
            return [b"".join([own[w] if w in own else known[w] for w in words]) for words in split]
        return [b"".join([known[w] for w in words]) for words in split]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One for a worker process: what it remembers serves its next tasks too."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, piece int, start long, length long, ids_crc32 long[, ids binary]): ids of the whole
    text and a closing 0, cut every ``capacity`` ids. Null text counts as empty: one piece, the closing 0. A very long text gives as many pieces as it
    takes. Rows that repeat give their pieces each, an empty table gives none; other columns are left out."""
    path = path or default_path()
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids, step = coder.texts(batch.column(1).to_pylist()), 4 * capacity
            rows = [(d, i, i * capacity, x[i * step : (i + 1) * step]) for d, code in zip(batch.column(0).to_pylist(), ids, strict=True) for x in [code + b"\0\0\0\0"] for i in range(-(-len(x) // step))]
            columns = [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
                pa.array([len(r[3]) // 4 for r in rows], pa.int64()), pa.array([zlib.crc32(r[3]) for r in rows], pa.int64()),
            ]
            yield pa.record_batch(columns + [pa.array([r[3] for r in rows], pa.binary())] * with_ids, [x.split()[0] for x in fields.split(", ")])
        release_memory()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, fields)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Fewest bins by total and by Martello and Toth's L2: for each k, lengths over capacity - k stand alone and those from
    k up to half the capacity fill what the rest leaves."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    c = np.zeros(capacity + 1, np.int64)
    for n, x in counts.items():
        c[n] = x
    number, total = np.cumsum(c), np.cumsum(c * np.arange(capacity + 1))
    half = capacity // 2
    for k in [0] + [n for n in counts if n <= half]:
        alone = number[capacity] - number[capacity - k]
        middle = number[capacity - k] - number[half]
        room = middle * capacity - (total[capacity - k] - total[half])
        small = total[half] - (total[k - 1] if k else 0)
        best = max(best, int(alone + middle + max(0, -(-(small - room) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: (lengths of a bin, number of such bins)."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {capacity: [((), 1 << 62)]}
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min(r for r in open_bins if r >= n)
            pattern, bins = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
            fit = room // n
            full = min(bins, left // fit)
            parts = [(full, fit), (1, left - full * fit)] if full < bins and left - full * fit and left - full * fit < fit else [(full, fit)]
            for number, each in parts:
                if number and each:
                    open_bins.setdefault(room - each * n, []).append((pattern + (n,) * each, number))
                    left -= number * each
                    bins -= number
            if bins:
                open_bins.setdefault(room, []).append((pattern, bins))
    return [x for group in open_bins.values() for x in group if x[0]]


def fillings(room: int, sizes: list[int], counts: dict[int, int], keep: int = 12) -> list[Pattern]:
    """Undominated fillings of ``room`` from ``sizes`` (falling), least waste first. A filling is dominated if one length
    left out could take the place of some of its lengths and fit (Korf's test); the search stops after FILL_STEPS."""
    found: dict[Pattern, int] = {}
    steps = 0
    taken: list[int] = []
    falling = [-n for n in sizes]

    def go(at: int, left: int) -> bool:
        nonlocal steps
        steps += 1
        grew = False
        for i in range(max(at, bisect_left(falling, -left)), len(sizes)):
            n = sizes[i]
            if taken.count(n) >= counts[n]:
                continue
            grew = True
            taken.append(n)
            done = go(i, left - n)
            taken.pop()
            if done:
                return True
        if not grew:
            found[tuple(taken)] = left
        return steps > FILL_STEPS or sum(w == 0 for w in found.values()) >= 3

    go(0, room)
    out = []
    for pattern, waste in sorted(found.items(), key=lambda x: (x[1], tuple(-n for n in x[0])))[: 2 * keep]:
        sums = {0: 0}
        for n in pattern:
            sums |= {s + n: max(k + 1, sums.get(s + n, 0)) for s, k in list(sums.items())}
        # lengths left out that are in reach of some sum of the pattern's
        near = {n for s, k in sums.items() if k for n in sizes[bisect_left(falling, -s - waste) : bisect_right(falling, -s)] if n > s or k > 1}
        if all(pattern.count(n) >= counts[n] for n in near):
            out.append(pattern)
    return (out or [min(found, key=found.get)])[:keep]


def priced(counts: dict[int, int], capacity: int, budget: int = PRICING) -> tuple[list[tuple[Pattern, float]], int]:
    """(fillings with fractional numbers of bins that hold all pieces in the fewest bins, as far as ``budget`` goes; a lower bound of whole bins).

    The linear programme over all fillings, by generation of columns: each length has a price, its share of a bin under the fillings in use. The
    completion of greatest price around each length joins the fillings in use where it is worth more than a bin, until none is.
    Prices over the worth of the best filling bound the number of bins from below (Farley)."""
    lengths = np.array(sorted(counts, reverse=True))
    need = np.array([counts[n] for n in lengths.tolist()], float)
    m = len(lengths)
    each = capacity // lengths
    fills = [{i: int(k)} for i, k in enumerate(each)]  # length number -> how many of it
    inverse, x, price = np.diag(1 / each), need / each, 1 / each
    spent, least, worth = 0, int(lengths[-1]), 1.0
    while True:
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)  # by room: the greatest price, and a length in it, -1 for one of less room
        first = np.searchsorted(-lengths, -np.arange(capacity + 1))  # the longest length that fits
        for room in range(least, capacity + 1):
            worths = price[first[room] :] + best[room - lengths[first[room] :]]
            k = int(worths.argmax())
            best[room], last[room] = (worths[k], first[room] + k) if worths[k] > best[room - 1] + 1e-12 else (best[room - 1], -1)
        spent += (m + 1600) * capacity  # as long as so many numbers of a pivot take
        worth = max(1.0, float(best[capacity]))
        around = price + best[capacity - lengths]
        entered = False
        for i in np.argsort(-around, kind="stable").tolist():
            if around[i] <= 1 + 1e-7 or spent > budget:
                break
            fill, room = {i: 1}, capacity - int(lengths[i])
            while room >= least:
                if (k := int(last[room])) < 0:
                    room -= 1
                    continue
                fill[k] = fill.get(k, 0) + 1
                room -= int(lengths[k])
            at, number = list(fill), np.array(list(fill.values()), float)
            gain = price[at] @ number - 1
            if gain <= 1e-7:
                continue
            column = inverse[:, at] @ number
            ratio = np.where(column > 1e-9, x / np.where(column > 1e-9, column, 1), np.inf)
            out = int(ratio.argmin())
            if not np.isfinite(ratio[out]):
                continue
            step, row = ratio[out], inverse[out] / column[out]
            x = np.maximum(x - step * column, 0)
            x[out] = step
            inverse -= np.outer(column, row)
            inverse[out] = row
            price = price - gain * row
            fills[out], entered = fill, True
            spent += m * m
        if not entered or spent > budget:
            break
    bound = int(np.ceil(need @ np.maximum(price, 0) / worth - 1e-6)) if not entered else 0
    return [(tuple(int(lengths[k]) for k in sorted(f) for _ in range(f[k])), float(v)) for f, v in zip(fills, x, strict=True)], bound


def rounded(fractional: list[tuple[Pattern, float]], counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Whole numbers of the fillings, by the largest fractions left as long as they fit what is left; the rest by :func:`search`."""
    left, out = dict(counts), []

    def take(pattern: Pattern, number: int) -> None:
        number = min([number, *(left[n] // pattern.count(n) for n in set(pattern))])
        if number > 0:
            out.append((pattern, number))
            for n in pattern:
                left[n] -= number

    for pattern, x in fractional:
        take(pattern, int(x + 1e-6))
    for pattern, _ in sorted(fractional, key=lambda f: f[1] - int(f[1] + 1e-6), reverse=True):
        take(pattern, 1)
    return out + search({n: c for n, c in left.items() if c}, capacity)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Bin completion over a histogram: (lengths of a bin in falling order, number of such bins).

    The incumbent is best-fit decreasing; where that misses the lower bound by more than one bin in WORTH_PRICING, fillings of the greatest price around each
    length, rounded, with best fit for what they leave; and where the bound is still missed, the search for better completions goes over the whole histogram.
    """
    counts = {n: c for n, c in counts.items() if c}
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    bins = lambda packing: sum(c for _, c in packing)
    if (bins(best) - bound) * WORTH_PRICING > bound:
        fractional, other = priced(counts, capacity)
        bound = max(bound, other)
        best = min(best, rounded(fractional, counts, capacity), key=bins)
    if bins(best) > bound:
        best = min(best, search(counts, capacity, best, bound), key=bins)
    merged: dict[Pattern, int] = {}
    for pattern, number in best:
        pattern = tuple(sorted(pattern, reverse=True))
        merged[pattern] = merged.get(pattern, 0) + number
    return sorted(merged.items(), reverse=True)


def search(counts: dict[int, int], capacity: int, best: list[tuple[Pattern, int]] | None = None, bound: int = 0) -> list[tuple[Pattern, int]]:
    """Branch and bound from the incumbent ``best``, or best-fit decreasing.

    The largest length left is completed by each undominated filling in turn, for as many bins as the counts allow
    and then for one; a branch whose waste leaves no hope of fewer bins than the incumbent is cut. The search ends at the lower bound,
    after SEARCH_STEPS and STEPS_EACH for each length, or after IDLE_STEPS that lead nowhere new.
    """
    best = best_fit(counts, capacity) if best is None else best
    best_bins, bound = sum(c for _, c in best), max(bound, lower_bound(counts, capacity) if counts else 0)
    most = SEARCH_STEPS + STEPS_EACH * len(counts)
    total = sum(n * c for n, c in counts.items())
    left, path, waste, steps, items = dict(counts), [], 0, 0, sum(counts.values())

    def choices() -> Iterator[tuple[Pattern, int, int]]:
        sizes = sorted((n for n, c in left.items() if c), reverse=True)
        top = sizes[0]
        left[top] -= 1
        options = fillings(capacity - top, [n for n in sizes if left[n]], left) if capacity > top else [()]
        left[top] += 1
        for rest in options:
            pattern = (top, *rest)
            times = min(left[n] // pattern.count(n) for n in set(pattern))
            for number in dict.fromkeys((times, 1)):
                yield pattern, number, capacity - sum(pattern)

    def apply(pattern: Pattern, number: int) -> None:
        for n in pattern:
            left[n] -= number

    stack = [choices()] if counts else []
    deepest = reached = 0  # the longest path so far, and the step that it or a better packing came with
    while stack and best_bins > bound and steps < most and steps - reached <= IDLE_STEPS:
        steps += 1
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                pattern, number = path.pop()
                apply(pattern, -number)
                items += number * len(pattern)
                waste -= number * (capacity - sum(pattern))
            continue
        pattern, number, lost = step
        if waste + number * lost > (best_bins - 1) * capacity - total:
            continue
        apply(pattern, number)
        path.append((pattern, number))
        waste += number * lost
        items -= number * len(pattern)
        if len(path) > deepest:
            deepest, reached = len(path), steps
        if items:
            stack.append(choices())
            continue
        if (bins := sum(c for _, c in path)) < best_bins:
            best, best_bins, reached = list(path), bins, steps
        path.pop()
        apply(pattern, -number)
        items += number * len(pattern)
        waste -= number * lost
    return best


def slots(packing: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, per bin, first sequence, offset in it) in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, number in packing:
        offset = 0
        for n in dict.fromkeys(pattern):
            each = pattern.count(n)
            out.setdefault(n, []).append((ranks.get(n, 0), each, sequence, offset))
            ranks[n] = ranks.get(n, 0) + each * number
            offset += each * n
        sequence += number
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(found: DataFrame, capacity: int = CAPACITY, salt: int = SALT) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) -> the same with sequence_id long and offset long.

    ``found`` is read more than once, so it should be a written table. Pieces that repeat are packed each; ties in length are placed by salt, doc_id,
    piece and checksum. An empty table gives no rows."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    places = found.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = found.select(*names, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salt)).alias("salt"))
    by_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select(*names, (F.col("at") + F.col("before")).cast("long").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                rows = places.value[int(n)]
                first, each, base, start = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1].T
                at = rank[own] - first
                sequence[own], offset[own] = base + at // each, start + at % each * n
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(materialize(pieces(table(spark, sf_dir, "documents"))))
