"""Filter interaction audit: what each of five filters removes in every order of them.

Documents become masks of the filters that they fail. Four are looked up in the text; the fifth, exact copies, needs the table: texts are
routed by fingerprint to the partition that holds the chains of all texts of that fingerprint, in full, with the least doc_id of each.
A task keeps such chains of its own rows first and writes them, so a text crosses the shuffle once for each task that has it, however often it
is repeated, and rows that a task knows not to be the first leave it as ids alone. Count vectors of masks are merged by part; all orders are read off them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communa.llm.common import release_memory, small_batches, table
from communa.storage import hold, materialize

FILTERS = "ABCDE"
#: Words that a text has at least, percents of distinct words and of capitals, and characters that fail it.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that a task holds in chains before it sends them on, and parts of the routed texts for each part of the input.
HELD_BYTES, SPREAD = 32 << 20, 2
#: Rows and bytes of text of one written batch.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20
RECORDS = pa.schema([("key", pa.int64()), ("raw", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
COPY = 1 << FILTERS.index("E")
#: A count vector holds, for each mask, documents, good ones and toxic ones.
MARKED = 3
SCHEMA = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_mask(text: str, raw: bytes) -> int:
    """Filters A to D that a text fails, as bits from the least."""
    words = raw.split()  # at the bytes 9 to 13 and 32
    short = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text)
    marked = len(raw.translate(None, MARKS)) < len(raw)
    return short | dull << 1 | loud << 2 | marked << 3


class Chains:
    """Texts by fingerprint: a chain of [text, least id, {(part, mask): rows of that id}] for each, told apart by their full text."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, raw: bytes, number: int, rows: dict) -> Iterator[tuple[int, dict]]:
        """Take rows of one id, and yield (id, rows) that turn out not to be of the least one."""
        chain = self.of.setdefault(key, [])
        for link in chain:
            if link[0] == raw:
                if number > link[1]:
                    yield number, rows
                elif number < link[1]:
                    yield link[1], link[2]
                    link[1:] = number, rows
                else:
                    for k, n in rows.items():
                        link[2][k] = link[2].get(k, 0) + n
                return
        chain.append([raw, number, rows])
        self.bytes += len(raw)


def _copies(rows: dict) -> dict:
    return {(part, mask | COPY): n for (part, mask), n in rows.items()}


def fingerprint(raw: bytes) -> int:
    """63 bits of XXH64."""
    return xxhash.xxh64_intdigest(raw) >> 1


def _number_key(number: int | None) -> int:
    return fingerprint(str(number).encode())


def routed(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """Rows (doc_id, text, part) -> (key, (text or None, doc_id, {(part, mask): n})): chains by fingerprint, and ids already judged by id."""
    chains, nameless = Chains(), {}

    def judged(found: Iterable[tuple[int, dict]]) -> Iterator[tuple[int, tuple]]:
        for number, held in found:
            yield _number_key(number), (None, number, _copies(held))

    def out() -> Iterator[tuple[int, tuple]]:
        for key, chain in chains.of.items():
            for raw, number, held in chain:
                yield key, (raw, number, held)

    for number, text, part in rows:
        raw = text.encode("utf-8", "surrogatepass")
        held = {(part, own_mask(text, raw)): 1}
        if number is None:  # neither smaller than any id nor larger
            _added(nameless, held)
            continue
        yield from judged(chains.add(fingerprint(raw), raw, number, held))
        if chains.bytes > HELD_BYTES:
            yield from out()
            chains = Chains()
    yield from out()
    if nameless:
        yield _number_key(None), (None, None, nameless)


def settled(records: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int | None, dict]]:
    """(doc_id, {(part, mask): n}) with the bit of copies for all but the least doc_id of a text."""
    chains = Chains()
    for key, (raw, number, held) in records:
        if raw is None:
            yield number, held
        else:
            for later, rows in chains.add(key, raw, number, held):
                yield later, _copies(rows)
    for chain in chains.of.values():
        for _, number, held in chain:
            yield number, held


def _added(a: dict, b: dict) -> dict:
    for k, n in b.items():
        a[k] = a.get(k, 0) + n
    return a


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text, part) -> batches of RECORDS."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
    out, size = [], 0
    for key, (raw, number, held) in routed(rows):
        out += [(key, raw, number, part, mask, n) for (part, mask), n in held.items()]
        size += len(raw or b"")
        if len(out) >= OUT_ROWS or size >= OUT_BYTES:
            yield pa.record_batch(list(map(list, zip(*out, strict=True))), RECORDS)
            out, size = [], 0
    if out:
        yield pa.record_batch(list(map(list, zip(*out, strict=True))), RECORDS)
    release_memory()


def mask_vectors(docs: DataFrame, labels: DataFrame) -> RDD:
    """(part, count vector): for each mask the documents, those that a label calls good, and those that one calls toxic."""
    text, part = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "lang"))
    small_batches(docs.sparkSession)
    held = hold(materialize(docs.select(F.col("doc_id").cast("long"), text, part).mapInArrow(_written, "key long, raw binary, doc_id long, part string, mask int, n long")))
    rows = held.rdd.map(lambda r: (r.key, (None if r.raw is None else bytes(r.raw), r.doc_id, {(r.part, r.mask): r.n})))
    parts = max(SPREAD * rows.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    masks = rows.partitionBy(parts, lambda key: key % parts).mapPartitions(settled).mapValues(lambda held: (False, False, held))
    called = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)) for c in ("quality", "toxic")]
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long")).agg(*called).rdd.map(lambda r: (r[0], (bool(r[1]), bool(r[2]), {})))
    joined = masks.union(known).reduceByKey(lambda a, b: (a[0] or b[0], a[1] or b[1], _added(dict(a[2]), b[2])), parts)

    def vectors(rows: Iterable[tuple]) -> Iterator[tuple[str, tuple[int, int, bool, bool]]]:
        for _, (good, toxic, held) in rows:
            for (part, mask), n in held.items():
                yield part, (mask, n, good, toxic)

    def merged(vector: list[int], row: tuple[int, int, bool, bool]) -> list[int]:
        mask, n, good, toxic = row
        for k, counts in enumerate((True, good, toxic)):
            vector[MARKED * mask + k] += n * counts
        return vector

    empty = MARKED << len(FILTERS)
    return joined.mapPartitions(vectors).combineByKey(lambda row: merged([0] * empty, row), merged, lambda a, b: [x + y for x, y in zip(a, b, strict=True)], parts)


def order_rows(part: str, vector: list[int]) -> Iterator[tuple]:
    """Rows of SCHEMA: each step of each order, zeros included."""
    removed: dict[tuple[str, int], tuple] = {}
    shapley = dict.fromkeys(FILTERS, 0)
    masks = range(1 << len(FILTERS))
    whole = sum(vector[MARKED * m] for m in masks)
    for order in ORDERS:
        gone, kept = 0, whole
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            now = [m for m in masks if m & bit and not m & gone]
            taken, good, toxic = (sum(vector[MARKED * m + k] for m in now) for k in range(MARKED))
            redundant = sum(vector[MARKED * m] for m in masks if m & bit and m & gone)
            gone, kept = gone | bit, kept - taken
            shapley[name] += taken
            removed[order, step] = (name, kept, taken, redundant, vector[MARKED * bit], good, toxic)
    for (order, step), (name, *counts) in removed.items():
        yield part, order, step, name, *counts, shapley[name]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang), (doc_id, quality, toxic) -> rows of SCHEMA: every step of every order of the five filters, for each value of lang.

    Null texts are empty ones, and a null lang is the part of the empty string. Rows without a doc_id are no copy of any and
    none is of them; rows that repeat doc_id and text are documents each, but no copies of each other. Several labels of a doc_id count as one that is good, or toxic, if any is.
    Very long texts are read and compared whole. An empty table gives no rows. Other columns are left out."""
    rows = mask_vectors(docs, labels).flatMap(lambda x: order_rows(*x))
    return docs.sparkSession.createDataFrame(rows, SCHEMA)


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
