"""Language identification by a string kernel.

A text's blended spectrum is the set of its letter n-grams, n = 1 to 3, case folded, other characters as one gap. The
kernel of two texts is the number of n-grams present in both over the root of the product of their set sizes.
Nyström landmarks turn it into features, on which a one-versus-rest kernel ridge regression is fitted; rows are
scored in batches, as the matrix product of presence and landmark tables and then of kernels and weights.

The fit takes at most about ``per_lang`` labelled texts of each language, chosen by hash over the whole table; every
row of the table is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from communa.llm.common import release_memory, small_batches, table, whole_row

#: Bound of the labelled sample for each language, number of landmarks over all languages, ridge, steepness of the score.
PER_LANG, LANDMARKS, RIDGE, STEEP = 300, 128, 1e-2, 6.0
#: Longer texts aren't in the sample, unless a language has none as short: then those as short as its shortest are. Every text is predicted whole.
SAMPLE_CHARS = 20_000
_OWN = 48  # letters with a symbol of their own; others share 15
_CODES = 64 + 64**2 + 64**3
_BITS = 19
_DOCS = 64
_LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])


def letters_of(texts: list[str]) -> list[str]:
    """The most frequent letters, which get symbols of their own."""
    count = np.zeros(0x110000, np.int64)
    for x in texts:
        code, n = np.unique(np.frombuffer(x.lower().encode("utf-32-le"), "<u4"), return_counts=True)
        count[code] += n
    count[~_LETTERS] = 0
    top = np.argsort(-count, kind="stable")[: _OWN - 1]
    return [chr(i) for i in top if count[i]]


def symbols(letters: list[str]) -> np.ndarray:
    """Symbol of each code point: 0 for all but letters."""
    out = np.where(_LETTERS, _OWN + 1 + np.arange(0x110000) % 15, 0).astype(np.uint8)
    for i, c in enumerate(letters):
        out[ord(c)] = i + 1
    return out


def spectra(texts: list[str], table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, n-gram) of every n-gram present, each once, sorted."""
    keys = [np.empty(0, np.int64)]
    for i, x in enumerate(texts):
        s = table_[np.frombuffer(x.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        if not s.any():
            continue
        s = np.concatenate([[0], s, [0]])
        s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])].astype(np.int32)
        two = s[:-1] * 64 + s[1:]
        seen = np.unique(np.concatenate([s, 64 + two, 64 + 64**2 + two[:-1] * 64 + s[2:]]))
        keys.append(seen[seen > 0].astype(np.int64) | i << _BITS)
    both = np.concatenate(keys)
    return both >> _BITS, both & (1 << _BITS) - 1


@dataclass
class LanguageModel:
    """langs in order; symbol table; n-gram -> column; landmark presence over root of size (columns x landmarks); weights (landmarks x langs)."""

    langs: list[str]
    symbols: np.ndarray
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernels(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.landmarks.shape[1]), np.float32)
        for at in range(0, len(texts), _DOCS):
            row, code = spectra(texts[at : at + _DOCS], self.symbols)
            n = min(_DOCS, len(texts) - at)
            size = np.bincount(row, minlength=n)
            column = self.columns[code]
            held = column >= 0
            present = np.zeros((n, len(self.landmarks)), np.float32)
            present[row[held], column[held]] = 1
            out[at : at + n] = present @ self.landmarks / np.sqrt(np.maximum(size, 1))[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each; ``und`` and 0 for null and letterless texts. Ties go to the first language by name."""
        texts = [x or "" for x in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        margins = np.round((self.kernels(texts) @ self.weights).astype(np.float64), 5)
        best = margins.argmax(1)
        score = 1 / np.exp(STEEP * (margins - margins.max(1, keepdims=True))).sum(1)
        lettered = np.array([any(map(str.isalpha, x)) for x in texts], bool)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, np.round(score, 6), 0.0)


def train(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """(text, lang) pairs -> model. Landmarks are taken in turn from the languages, in the order of the sample."""
    sample = [(x, y) for x, y in sample if any(map(str.isalpha, x))]
    langs = sorted({y for _, y in sample})
    if not langs:
        return LanguageModel([], symbols([]), np.full(1 << _BITS, -1, np.int32), np.zeros((1, 1), np.float32), np.zeros((1, 1)))
    by_lang = [[x for x, y in sample if y == lang] for lang in langs]
    marks = [rows[k] for k in range(landmarks) for rows in by_lang if k < len(rows)][:landmarks]
    table_ = symbols(letters_of([x for x, _ in sample]))
    row, code = spectra(marks, table_)
    used, column = np.unique(code, return_inverse=True)
    columns = np.full(1 << _BITS, -1, np.int32)
    columns[used] = np.arange(len(used))
    presence = np.zeros((len(used), len(marks)), np.float32)
    presence[column, row] = 1
    presence /= np.sqrt(np.maximum(presence.sum(0), 1))
    model = LanguageModel(langs, table_, columns, presence, np.zeros((len(marks), len(langs))))
    value, vector = np.linalg.eigh(model.kernels(marks).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    z = model.kernels([x for x, _ in sample]) @ root
    goal = np.array([[1.0 if y == lang else -1.0 for lang in langs] for _, y in sample])
    weight = 1 / np.array([sum(y == lang for _, y in sample) for lang in langs])[[langs.index(y) for _, y in sample]]
    weight *= len(sample) / weight.sum()
    fitted = np.linalg.solve(z.T @ (z * weight[:, None]) + ridge * len(sample) / len(marks) * np.eye(len(marks)), z.T @ (goal * weight[:, None]))
    model.weights = (root @ fitted).astype(np.float32)
    return model


def fit(docs: DataFrame, where: Column | None = None, per_lang: int = PER_LANG, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Model from the rows of (doc_id, text, lang, ...) with text and lang, of those that ``where`` picks. The number of languages is taken to be small."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.filter(where) if where is not None else rows
    rows = rows.select(F.col("lang").cast("string"), F.col("text").cast("string"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("language")).alias("h"))
    size = F.length("text")
    lengths = {r["lang"]: max(SAMPLE_CHARS, r["least"]) for r in rows.groupBy("lang").agg(F.min(size).alias("least")).collect()}
    if not lengths:
        return train([])
    rows = rows.filter(size <= F.element_at(F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair]), F.col("lang")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 30, int((1 << 30) * per_lang / n)))])
    picked = rows.filter(F.pmod("h", F.lit(1 << 30)) < F.element_at(limit, F.col("lang"))).withColumn("t", F.xxhash64("text"))
    picked = picked.dropDuplicates(["lang", "t"]).limit(4 * per_lang * len(counts))  # repeated rows count once, so the sample stays bounded
    return train([(r["text"], r["lang"]) for r in sorted(picked.collect(), key=lambda r: (r["h"], r["t"], r["lang"]))], landmarks, ridge)


def annotate(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(row, lang_pred string, score double) for each row of docs, row a struct of all its columns, whatever their names.

    Null and letterless texts are ``und`` with score 0; without any labelled text in the fit all are. A very long text is one set of
    n-grams like any other. Repeated rows stay; equal texts get equal results; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(whole_row(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.predict(batch.column(0).field("text").to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])
        release_memory()

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, lang_pred, score), a row per input row, by the rules of :func:`annotate`; other columns are left out."""
    found = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return found.select("row.doc_id", "lang_pred", "score")


def recognised(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of docs, with all their columns, in some language by a score of ``least`` or more."""
    return annotate(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves 1 when divided by 3; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of all documents, by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
