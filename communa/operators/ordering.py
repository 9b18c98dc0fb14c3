"""Row numbers in a total order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communa.storage import drop, materialize

_ROW = (1 << 33) - 1


def number_rows(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """df with the row's number, from 0, in the given order. The sort is by ranges; only a count for each range reaches the driver.

    A sort by ranges reads its input twice, for the bounds and for the rows, so a costly df is written before. Only rows that go with the
    order are written: a caller with wide rows numbers their keys and joins."""
    wide = [p for p in ("Join", "Aggregate", "Generate") if p in df._jdf.queryExecution().optimizedPlan().toString()]
    source = materialize(df) if wide else df
    placed = materialize(source.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    if wide:
        drop(source)
    part = F.shiftrightunsigned("_place", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, pairs = 0, []
    for p, n in counts:
        pairs += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += n
    start = F.element_at(F.create_map(*pairs), part) if pairs else F.lit(0)
    return placed.withColumn(name, (start + F.col("_place").bitwiseAND(F.lit(_ROW))).cast("long")).drop("_place")
