"""The corpus pipeline: language, lines, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communa.llm import documents, langid, lines, packing, secrets
from communa.storage import drop, materialize, owned

#: Least score of a language that keeps a document.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts are some), or that no language fits by LEAST_SCORE, go; where no row has a language to learn
    from, all do. Very long texts and repeated rows are judged like any others, equal texts alike; an empty table stays empty. Columns of any
    names pass through as they are."""
    return langid.recognised(docs, langid.fit(docs), LEAST_SCORE)


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose set of words has a Jaccard similarity of 0.8 or more with an earlier line's, by doc_id (null last) and line number, go from their
    texts; every document stays. Null texts stay null, blank lines stay, very long lines are lines like any others, and rows that repeat doc_id
    and text stay alike; an empty table stays empty. Columns of any names pass through, but n_chars follows the text."""
    return _measured(lines.replace_text(docs, shingle=lines.WORD, least=lines.ANY_WORDS), docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose set of five-word shingles has a Jaccard similarity of 0.8 or more with an earlier one's, by doc_id (null last), go:
    SimHash links them and an exact check confirms it, and an exact join finds those that SimHash misses. One
    null or wordless text stays, and one of rows that repeat; very long texts are compared whole; an empty table stays empty. Columns of any
    names pass through as they are."""
    return documents.distinct_documents(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in their texts; every document stays, repeated rows alike. Null texts stay null, very long ones are scanned whole; an
    empty table stays empty. Columns of any names pass through, but n_chars follows the text."""
    return _measured(secrets.redact(docs, secrets.fit(docs)), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places. Null and empty texts are a closing 0 each, very long ones several pieces, rows that repeat are
    packed each, and an empty table gives no rows."""
    return packing.pack(materialize(packing.pieces(docs)))


STAGES = [("language", identify_language), ("lines", dedup_lines), ("documents", dedup_documents), ("secrets", mask_secrets), ("packing", pack_sequences)]

#: SQL can't express the model of the first stage nor the packing of the last.
ORACLE_SQL = None


@owned
def _written(stage: Callable[..., DataFrame], spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a stage keeps, written; the tables that it needed on the way go."""
    return materialize(stage(spark, docs, sf_dir))


@owned
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what each stage writes goes once the next has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, _written(stage, spark, docs, sf_dir)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
