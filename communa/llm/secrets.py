"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Everything on the rows is a column expression. A match's place follows from the lengths of what ``split`` leaves
between matches. The two models are pair tables trained on the driver from labelled samples; a long token is
scored by the sum of its pairs' log-likelihood ratios, looked up in one literal array.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from communa.llm.common import table, whole_row

#: Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Tokens that the models judge, and the least ratio, in nats, over the whole token and per pair.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
LEAST, LEAST_PER_PAIR = 12.0, 0.35
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Documents, about, that words are cut from, and words taken, for the ordinary identifiers that the model is trained on.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 2000, 4000
#: Matches whose places are summed in one go; blocks keep the work linear in their number.
_BLOCK = 256

#: Words of which ordinary identifiers are made where no corpus is given or it has none.
WORDS = (
    "the and for with that this from have not are was were will would there their which about into over under after before between through "
    "user name value index count total result input output file path line text word page list item node edge graph table column row key map set get "
    "put add remove update delete create build make load store read write open close start stop begin end first last next previous current default "
    "option config setting parameter argument function method class object type string number integer float double boolean array vector matrix buffer "
    "stream thread process worker manager handler factory service client server request response message event listener callback context session "
    "connection database query filter sort group order limit offset window frame size length width height depth level version release package module "
    "library import export public private protected static final abstract interface implementation exception error warning debug trace log report "
    "und der die das nicht mit einer werden zwischen verschiedene ungen heiten keit les des dans pour avec entre toujours ment tion los las para como "
    "desde siempre mente cion government important international understand development environment information university different community"
).split()


def labelled_samples(n: int = 3000, seed: int = 11, source: list[str] = WORDS) -> list[tuple[str, bool]]:
    """(string, random?) pairs: draws from the usual alphabets of keys, and identifiers, paths and run-on words made of the words of ``source``."""
    rng = random.Random(seed)
    alphabets = (ALPHABET[:64], ALPHABET[:62], "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:36] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[:62] + "-_")
    out = []
    for i in range(n):
        out.append(("".join(rng.choice(alphabets[i % len(alphabets)]) for _ in range(rng.randrange(16, 65))), True))
        words = [rng.choice(source) for _ in range(rng.randrange(2, 9))]
        form = i % 8
        if form == 0:
            text = "_".join(words)
        elif form == 1:
            text = "-".join(words)
        elif form == 2:
            text = "/".join(words)
        elif form == 3:
            text = words[0] + "".join(w.title() for w in words[1:])
        elif form == 4:
            text = "_".join(words).upper()
        elif form == 5:
            text = "".join(words)
        elif form == 6:
            text = "_".join(words) + str(rng.randrange(10000))
        else:
            text = rng.choice("=-_/") * rng.randrange(10, 60) if i % 16 == 7 else "".join(words).upper()
        out.append((text, False))
    return out


def train(samples: Iterable[tuple[str, bool]]) -> list[float]:
    """Log-likelihood ratio of each pair of ALPHABET, random over ordinary, row by row; one is added to each count."""
    k = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = {label: [[1.0] * k for _ in range(k)] for label in (True, False)}
    for text, label in samples:
        for a, b in zip(text, text[1:], strict=False):
            if a in at and b in at:
                counts[label][at[a]][at[b]] += 1
    chance = {label: [[math.log(x / sum(row)) for x in row] for row in rows] for label, rows in counts.items()}
    return [chance[True][i][j] - chance[False][i][j] for i in range(k) for j in range(k)]


def corpus_words(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS) -> list[str]:
    """At most so many words of 3 to 20 letters, chosen by hash from about so many documents, chosen by hash over the whole table."""
    text = F.col("text").cast("string")
    rows = docs.filter(text.isNotNull()).select(text.alias("text"), F.xxhash64("doc_id", text).alias("h"))
    share = min(1 << 30, int((1 << 30) * documents / max(1, docs.count())) + 1)
    found = rows.filter(F.pmod("h", F.lit(1 << 30)) < share).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter(F.length("word").between(3, 20)).distinct()
    return [r["word"] for r in found.orderBy(F.xxhash64("word"), "word").limit(words).collect()]


def fit(docs: DataFrame) -> list[float]:
    """The model whose ordinary class is identifiers made of the corpus's own words; its size and that of what reaches the driver are fixed."""
    return train(labelled_samples(source=corpus_words(docs) or WORDS))


def ratio(text: str, model: list[float]) -> float:
    """What the column expression computes, for one string."""
    k = len(ALPHABET)
    return sum(model[ALPHABET.index(a) * k + ALPHABET.index(b)] for a, b in zip(text, text[1:], strict=False))


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _scanned(items: Column, kind: str, state: Column, step: Callable[[Column, Column], Column], told: Callable[[Column, Column], Column]) -> Column:
    """What ``told(state, item)``, an array of the type ``kind``, gives for each of ``items`` in order, one after another; ``step`` is the next state.

    Items go in blocks, so that the arrays that grow stay short and the work is linear in their number; each inner fold runs once, since a
    one-element array holds it."""

    def block(acc: Column, b: Column, all_: Column) -> Column:
        inner = F.aggregate(
            F.slice(all_, b + 1, F.lit(_BLOCK)), F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")),
            lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], told(a["at"], x)).alias("out")),
        )
        return F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))[0]

    start = F.struct(state.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    folded = F.transform(F.array(items), lambda all_: F.flatten(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(_BLOCK)), start, lambda acc, b: block(acc, b, all_))["out"]))[0]
    return F.when(F.size(items) > 0, folded).otherwise(F.array().cast(kind))


def _placed(text: Column, pattern: str, kind: int, keep: Column) -> Column:
    """Array of (start, kind, end) of the matches at whose number keep, an array of booleans, is true."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    items = F.transform(F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.transform(matches, F.length).alias("m"), keep.alias("k")), lambda x: x)
    items = F.filter(items, lambda x: x["m"].isNotNull())  # the last gap has no match
    one = lambda at, x: F.array(F.struct((at + x["g"]).alias("start"), F.lit(kind).alias("kind"), (at + x["g"] + x["m"]).alias("end")))
    found = _scanned(items, _SPAN, F.lit(0), lambda at, x: at + x["g"] + x["m"], lambda at, x: F.when(x["k"], one(at, x)).otherwise(F.array().cast(_SPAN)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _stretches(spans: Column, apart: int = 0) -> Column:
    """Of spans in order of start, what they cover together: where each stretch starts and where the one before ends, 0 for the first. With
    ``apart`` 1, stretches that touch are one."""
    kind = "array<struct<start:int,before:int>>"
    head = lambda at, s: F.array(F.struct(s["start"].alias("start"), at.alias("before")))
    return _scanned(spans, kind, F.lit(-apart), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.when(s["start"] >= at + apart, head(at, s)).otherwise(F.array().cast(kind)))


def _covered(spans: Column) -> Column:
    """Of spans in order of start, the stretches that they cover, as spans of kind -1."""
    heads, last = _stretches(spans, 1), F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.transform(F.array(heads), lambda h: F.transform(h, lambda s, i: F.struct(s["start"].alias("start"), F.lit(-1).alias("kind"), F.coalesce(F.get(h, i + 1)["before"], last).alias("end"))))[0]


def _ratios(tokens: Column, model: list[float]) -> Column:
    """Of an array of tokens, those whose ratio passes, as booleans."""
    k, table_ = len(ALPHABET), F.array(*[F.lit(round(x, 6)) for x in model])

    def judged(token: Column) -> Column:
        codes = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
        total = F.transform(
            F.array(F.filter(codes, lambda c: c >= 0)),
            lambda a: F.aggregate(F.sequence(F.lit(1), F.size(a) - 1), F.lit(0.0), lambda s, i: s + F.get(table_, F.get(a, i - 1) * k + F.get(a, i))),
        )[0]
        return (total >= LEAST) & (total >= LEAST_PER_PAIR * (F.length(token) - 1))

    return F.transform(tokens, judged)


def _long_enough(groups: Column, least: int) -> Column:
    return F.transform(groups, lambda m: F.length(m) >= least)


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, text, base, added), the last two arrays of (start, kind, end): places in code points,
    end exclusive, ``kind`` the number in BASE, or len(BASE) for what the models add. Base spans are those of the fixed
    patterns, leftmost and not overlapping within a kind; added ones reach beyond what base spans cover. Spans of equal start are in order of kind.

    Null text counts as empty: no spans. A very long text is scanned whole, in work linear in its spans. Repeated rows stay, one out per row in;
    an empty table gives no rows; other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _with_spans(rows, model)
    beyond = _scanned(
        F.array_sort(F.concat(_covered(F.col("base")), F.col("judged"))), _SPAN, F.lit(0),
        lambda at, s: F.when(s["kind"] < 0, F.greatest(at, s["end"])).otherwise(at),
        lambda at, s: F.when((s["kind"] >= 0) & (s["end"] > at), F.array(s)).otherwise(F.array().cast(_SPAN)),
    )
    added = F.when((F.size("base") == 0) | (F.size("judged") == 0), F.col("judged")).otherwise(beyond)
    return found.select("row.doc_id", "row.text", "base", added.alias("added"))


def _with_spans(docs: DataFrame, model: list[float] | None) -> DataFrame:
    """(row struct of docs' columns, base, judged): spans of the fixed patterns, and of the tokens that the models call random."""
    model = train(labelled_samples()) if model is None else model
    rows = docs.select(whole_row(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    text = F.col("t")
    kinds = [_placed(text, pattern, number, _long_enough(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), least)) for number, (_, pattern, group, least) in enumerate(BASE)]
    token = _placed(text, TOKEN, len(BASE), _ratios(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), model))
    return rows.select("row", F.array_sort(F.concat(*kinds)).alias("base"), token.alias("judged"))  # array_sort orders by start, then kind


def redact(docs: DataFrame, model: list[float] | None = None, mask: str = "[secret]") -> DataFrame:
    """All rows and columns of docs, whatever their names, with ``mask`` in ``text`` for each stretch that spans cover: judged tokens go whole,
    also where base spans hold a part of them. Null text stays null; an empty table gives no rows."""
    text = F.col("row.text")
    found = _with_spans(docs, model).select("row", F.array_sort(F.concat("base", "judged")).alias("spans"))
    found = found.select("row", "spans", _stretches(F.col("spans")).alias("heads"))  # text from the last stretch's end leads up to each
    parts = F.transform("heads", lambda s: F.substring(text, s["before"] + 1, s["start"] - s["before"]))
    tail = F.substring(text, F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.length(text))
    new = F.when(F.size("spans") == 0, text).otherwise(F.concat(F.array_join(parts, mask), F.lit(mask), tail))
    return found.select(*[new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(x[0]) for x in BASE], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, digest and list of the spans of all documents, by models of the corpus's own words."""

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    return found.select(
        "doc_id", *[number(i).alias(f"n_{x[0]}") for i, x in enumerate(BASE)], F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
        _said(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
