"""Phrase collocations: word sequences that occur more often together than their parts let expect.

The words of a task's documents are shards of about ``SHARD_WORDS``, and the pieces of a shard are read into one generalised suffix automaton of bounded depth.
Its states are classes of phrases that end at the same places (endpos), each with its longest phrase, a suffix link to the class of the longest shorter one,
and the number of its places; counting asks for no more, so transitions are not laid out, and states and links come from sorting places by the words that end
there, last word first. The automaton enumerates its phrases with their counts, which are added up over all shards.

A phrase is no more frequent than its parts, so the corpus is gone through three times: for words, for pairs of frequent words, and for phrases all of whose
pairs are frequent. What is frequent is told by Bloom filters of bounded size: where they err, a phrase is counted for nothing, and the counts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from communa.llm.common import release_memory, small_batches, table
from communa.storage import drop, materialize, owned

LEAST, DEPTH, TOP = 100, 5, 2000
#: Words of one automaton, and bytes of a text that are split at once.
SHARD_WORDS, SLICE_BYTES = 2_000_000, 4 << 20
#: Bits of a filter for each entry, and its least and largest size as powers of two.
BITS, LEAST_POWER, MOST_POWER = 16, 16, 28
SALTS = 64
UNKNOWN = "und"
_STOP = b"."
_ENDS = b",;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_ENDS + b"\t", _STOP * len(_ENDS) + b" ")
_ODD, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """Words of a shard, numbered as they come; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({_STOP: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def read(self, text: str) -> list[np.ndarray]:
        """Numbers of a text's words, lower-cased in A-Z, with 0 at each end of a piece."""
        raw = text.encode("utf-8", "surrogatepass").lower().translate(_PLAIN)
        out, start = [], 0
        while start < len(raw):
            end = start + SLICE_BYTES
            if end < len(raw):  # on to the end of a word
                ends = [k for k in (raw.find(b" ", end), raw.find(_STOP, end)) if k >= 0]
                end = min(ends, default=len(raw))
            words = raw[start:end].replace(_STOP, b" . ").split()
            out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            start = end
        out.append(np.zeros(1, np.int32))
        return out


@dataclass
class Automaton:
    """States of a generalised suffix automaton: longest phrase, the state its suffix link leads to (-1: the root), places, and one of them."""

    length: np.ndarray
    link: np.ndarray
    count: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, depth: int) -> Automaton:
        """Of pieces divided by 0. Phrases are cut at ``depth`` words."""
        at = np.flatnonzero(words)
        keys, whole = [], np.ones(len(at), bool)
        for k in range(depth):
            far = at - k
            key = np.where(whole & (far >= 0), words[np.maximum(far, 0)], 0)
            whole = key > 0
            keys.append(key)
        order = np.lexsort(keys[::-1])
        at = at[order]
        new, state = np.arange(len(at)) == 0, np.full(len(at), -1)  # the state of each place, at the depth before
        length, link, count, end = (np.zeros(0, np.int64) for _ in range(4))
        for k, key in enumerate(keys):
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
            first = np.flatnonzero(new)
            sizes, whole = np.diff(np.r_[first, len(at)]), key[first] > 0
            above = state[first]
            same = whole & (above >= 0)
            same[same] = count[above[same]] == sizes[same]
            length[above[same]] = k + 1  # the same places: the class has a longer phrase
            fresh = whole & ~same
            number = np.where(same, above, -1)
            number[fresh] = len(length) + np.arange(fresh.sum())
            length = np.r_[length, np.full(fresh.sum(), k + 1)]
            link, count, end = np.r_[link, above[fresh]], np.r_[count, sizes[fresh]], np.r_[end, at[first[fresh]]]
            state = np.repeat(number, sizes)
        return cls(length, link, count, end)

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, place of the last one, count) for all phrases, by length: a state has those longer than its link's."""
        least = np.where(self.link >= 0, self.length[self.link], 0) + 1
        for k in range(1, int(self.length.max(initial=0)) + 1):
            some = (least <= k) & (k <= self.length)
            yield k, self.end[some], self.count[some]


@dataclass
class Bloom:
    """Two bits in a table of 64-bit numbers for each key that it holds."""

    table: np.ndarray

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for mix in (_ODD, _SECOND):
            bit = (keys * mix) >> np.uint64(64 - int(len(self.table)).bit_length() - 5)
            out &= (self.table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @classmethod
    def of(cls, keys: DataFrame) -> Bloom:
        """Of rows of one hash, or of two for pairs. The bits are set and put together on Spark; the driver gets the table, 32 MB at most."""
        number = keys.count()
        power = min(MOST_POWER, max(LEAST_POWER, (BITS * number - 1).bit_length()))

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes = [c.to_numpy().view(np.uint64) for c in batch.columns]
                key = pair_keys(*hashes) if len(hashes) == 2 else hashes[0]
                both = np.concatenate([(key * mix) >> np.uint64(64 - power) for mix in (_ODD, _SECOND)])
                yield pa.record_batch([pa.array((both >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (both & np.uint64(63))).view(np.int64))], ["at", "bit"])

        found = keys.mapInArrow(bits, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        out = np.zeros(1 << power - 6, np.uint64)
        out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return cls(out)


def word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    """The hashes xxhash64(lang, word) of Spark."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _SECOND + b
    return (x ^ (x >> np.uint64(31))) * _ODD


def cut_out(text: np.ndarray, keys: np.ndarray, frequent: Bloom, together: Bloom | None) -> np.ndarray:
    """What is left of a text of word numbers where rare words, or words of no frequent pair, go: runs divided by 0."""
    often = frequent.holds(keys)
    often[0] = False
    if together is None:
        return np.where(often[text], text, 0)
    at = np.flatnonzero(often[text[:-1]] & often[text[1:]])
    at = at[together.holds(pair_keys(keys[text[at]], keys[text[at + 1]]))]
    inside, after = np.zeros(len(text) + 1, bool), np.zeros(len(text) + 1, bool)
    inside[at] = inside[at + 1] = after[at] = True
    place = np.flatnonzero(inside)
    if not len(place):
        return np.zeros(0, text.dtype)
    starts = np.r_[True, ~(after[place[:-1]] & (np.diff(place) == 1))]  # a pair that isn't frequent ends a run
    return np.insert(text[place], np.flatnonzero(starts), 0)


def counted(lang: str, words: list[bytes], text: np.ndarray, lengths: range, filters: tuple[Bloom, ...]) -> Iterator[pa.Table]:
    """(lang, phrase, words, n) of a shard's phrases of the given lengths."""
    names = pa.array([w.decode("utf-8", "replace") for w in words], pa.string())

    def rows(columns: list[pa.Array], n: np.ndarray) -> pa.Table:
        k = len(columns)
        phrase = columns[0] if k == 1 else pc.binary_join_element_wise(*columns, " ")
        return pa.table({"lang": pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), "phrase": phrase, "words": pa.array(np.full(len(n), k, np.int32)), "n": pa.array(n)})

    if not filters:  # of single words the automaton would have the same counts
        yield rows([names.slice(1)], np.bincount(text, minlength=len(words))[1:])
        return
    short = cut_out(text, word_keys(lang, words), filters[0], filters[1] if len(filters) > 1 else None)
    for k, end, n in Automaton.of(short, lengths[-1]).phrases():
        if k in lengths:
            yield rows([names.take(pa.array(short[end - k + 1 + i])) for i in range(k)], n)


def phrase_counts(docs: DataFrame, lengths: range, *filters: Bloom) -> DataFrame:
    """(lang, phrase, words, n) of the phrases of the given lengths, all of whose words, and pairs of words, the filters hold."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Words] = {}
        texts: dict[str, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in texts.items():
                for rows in counted(lang, list(known[lang]), np.concatenate(parts), lengths, shared.value):
                    if len(rows):
                        yield from rows.to_batches(1 << 16)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = known.setdefault(lang, Words()).read(text.as_py())
                texts.setdefault(lang, []).extend(parts)
                size += sum(map(len, parts))
                if size >= SHARD_WORDS:
                    yield from out()
                    known, texts, size = {}, {}, 0
        yield from out()
        known, texts = {}, {}
        release_memory()

    small_batches(docs.sparkSession)
    found = docs.mapInArrow(run, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def _part(first: str, length: str) -> F.Column:
    return F.array_join(F.slice(F.split("phrase", " "), F.expr(first), F.expr(length)), " ")


def scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a) with l, r, n and score of the cut that scores lowest."""
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("*", _part("1", "cut").alias("left"), _part("cut + 1", "words - cut").alias("right"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    wide = {c: f"cast({c} as decimal(18, 0))" for c in "alrn"}
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * ({wide['a']} * {wide['n']})) div ({wide['l']} * {wide['r']})")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r", "n")).alias("m")
    return both.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "m.l", "m.r", "m.n", "m.score")


def longest(candidates: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, words, a) but for those that a longer one holds as often: what a suffix link leaves out of a phrase's own class, which is
    the same phrase less its first word, and its mirror image, less its last. One word at a time will do, as counts only fall."""
    short = F.explode(F.array(_part("2", "words - 1"), _part("1", "words - 1"))).alias("phrase")
    inner = candidates.filter("words > 2").select("lang", short, "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return candidates.join(inner, ["lang", "phrase"], "left").filter("most is null or 100 * most < 100 * a").drop("most")


@owned
def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """(text, lang, ...) -> (lang, rank, phrase, a, l, r, n, score): of each lang the ``top`` phrases of 2 to ``depth`` words that occur ``least`` times
    or more, by score, then number, then phrase.

    Null texts are empty, a null lang is ``und``. Phrases don't go beyond the marks and line ends that divide pieces. Very long texts are split slice
    by slice and counted whole; rows that repeat count each. Equal scores and numbers go by the bytes of the phrase. An empty table, or one without frequent phrases,
    gives no rows. Other columns are left out."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every = materialize(phrase_counts(rows, range(1, 2)))
    totals = materialize(every.groupBy("lang").agg(F.sum("n").alias("n")))
    often = F.col("n") >= least
    words = materialize(every.filter(often))
    drop(every)
    frequent = Bloom.of(words.select(F.xxhash64("lang", "phrase")))
    pairs = materialize(phrase_counts(rows, range(2, 3), frequent).filter(often))
    both = F.split("phrase", " ")
    together = Bloom.of(pairs.select(F.xxhash64("lang", both[0]), F.xxhash64("lang", both[1])))
    longer = materialize(phrase_counts(rows, range(3, depth + 1), frequent, together).filter(often))
    found = pairs.union(longer)
    candidates = found.withColumnRenamed("n", "a")
    rated = materialize(scored(longest(candidates), words.union(found).select("lang", "phrase", "n"), totals))
    drop(words)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = rated.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_k") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
