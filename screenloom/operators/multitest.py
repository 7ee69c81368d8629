"""Adjustment of p-values per label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjust(d: DataFrame, method: str = "benjamini-hochberg", p: str = "pvalue", out: str = "pvalue_adj") -> DataFrame:
    """Benjamini-Hochberg or Bonferroni over the non-null p-values of each label; null stays null."""
    n = F.count(p).over(Window.partitionBy("lab"))
    if method == "bonferroni":
        return d.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.col(p) * n, F.lit(1.0))))
    if method != "benjamini-hochberg":
        raise ValueError(f"unknown correction {method}")
    order = Window.partitionBy("lab").orderBy(F.col(p).asc_nulls_last(), "gene_id")
    place = d.withColumn("_n", n).withColumn("_i", F.row_number().over(order))
    q = F.min(F.col(p) * F.col("_n") / F.col("_i")).over(order.rowsBetween(0, Window.unboundedFollowing))
    return place.withColumn(out, F.when(F.col(p).isNotNull(), F.least(q, F.lit(1.0)))).drop("_n", "_i")
