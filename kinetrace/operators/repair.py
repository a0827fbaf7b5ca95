"""Detection and repair of gaps in ordered readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import filled, filled_vector, has_gap, missing, missing_count


def gap_counts(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(keys, rows, bad_rows, valid)."""
    bad = F.sum(has_gap(vector).cast("bigint"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), bad.alias("bad_rows"), (bad == 0).alias("valid"))


def neighbours(c: str, keys: list[str], order: list[str]) -> tuple[Column, Column]:
    w = W.partitionBy(*keys).orderBy(*order)
    return F.lag(c).over(w), F.lead(c).over(w)


def repair_values(rows: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """``repaired`` and ``status`` (ok, repaired, unrepairable): single gaps become the mean of their neighbours.

    A gap at an end or next to another gap stays; neighbours are always the recorded ones.
    """
    before, after = neighbours(value, keys, order)
    new = filled(before, F.col(value), after)
    gap = missing(value)
    status = F.when(~gap, "ok").when(new.isNotNull(), "repaired").otherwise("unrepairable")
    return rows.withColumns({"repaired": new, "status": status})


def repair_vectors(rows: DataFrame, vector: str, keys: list[str], order: list[str], width: int, kind: str = "float") -> DataFrame:
    """``repaired``, ``n_missing`` and ``n_left``: ``repair_values`` for each element of equally long vectors."""
    before, after = neighbours(vector, keys, order)
    out = rows.withColumns({"n_missing": missing_count(F.col(vector), width), "repaired": filled_vector(before, F.col(vector), after, width, kind)})
    return out.withColumn("n_left", missing_count(F.col("repaired"), width))


def repair_report(repaired: DataFrame, *keys: str) -> DataFrame:
    return repaired.groupBy(*keys).agg(
        F.sum((F.col("status") == "repaired").cast("bigint")).alias("n_repaired"),
        F.sum((F.col("status") == "unrepairable").cast("bigint")).alias("n_unrepairable"),
    )
