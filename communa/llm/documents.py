"""Near-duplicate documents by SimHash, checked exactly, and the pairs that its bits miss by the exact set-similarity join of :mod:`communa.llm.lines`, each
text taken as one line."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communa.llm import simhash
from communa.llm.common import whole_row
from communa.llm.lines import KEY, kept_lines
from communa.storage import materialize, owned

THRESHOLD = Fraction(4, 5)
SHINGLE = 5


@owned
def distinct_documents(docs: DataFrame, threshold: Fraction = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, that match no earlier document: none whose set of ``shingle``-word shingles has a Jaccard
    similarity of ``threshold`` or more with theirs. Of two rows that stay, none matches the other.

    Fingerprints of the shingles are linked by :func:`communa.llm.simhash.near_duplicates`; a document goes if it matches the first of its component, by whole sets.
    Those that are left are asked for in the join, against all. Documents are ordered by doc_id, null last; of rows that repeat doc_id and text one stays. Null and wordless texts match each
    other: one of least doc_id stays.
    """
    flat = F.translate(F.col("text").cast("string"), "\n", " ")
    doc = F.col("doc_id").cast("long")
    rid, rid2 = F.xxhash64(doc, flat).alias("rid"), F.xxhash64(F.lit(1), flat, doc).alias("rid2")
    wordless = ~F.coalesce(flat.rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    plain = docs.select(doc.alias("doc_id"), flat.alias("text"))
    linked = simhash.near_duplicates(plain, shingle).filter("component_id < doc_id").select(F.col("doc_id").alias("doc"), F.col("component_id").alias("earlier"))
    kept = kept_lines(plain, threshold, shingle, 1, told=materialize(linked)).select(*KEY)
    empty = docs.filter(wordless).select(doc.alias("doc"), rid, rid2).agg(F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", *KEY)).alias("first"))
    kept = kept.union(empty.filter(F.col("first").isNotNull()).select("first.rid", "first.rid2"))
    keyed = docs.select(whole_row(docs), rid, rid2)
    stay = materialize(keyed.select(*KEY).join(kept, KEY).groupBy(*KEY).agg(F.count("*").alias("n")))
    found = keyed.join(stay.hint("shuffle_hash"), KEY)
    again = found.filter("n > 1").dropDuplicates(KEY)
    return found.filter("n = 1").select("row.*").union(again.select("row.*"))
