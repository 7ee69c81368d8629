"""Reductions of the sparse counts x(cell_id, gene_id, value): zeros are absent, every count of cells comes from obs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_counts(x: DataFrame) -> DataFrame:
    return x.where("value <> 0").select("cell_id", "gene_id", F.col("value").cast("double").alias("value"))


def library_sizes(x: DataFrame, obs: DataFrame) -> DataFrame:
    """(cell_id, library, n_genes) of every cell, empty ones included."""
    sums = x.groupBy("cell_id").agg(F.sum("value").alias("library"), F.count("*").alias("n_genes"))
    return obs.select("cell_id").join(sums, "cell_id", "left").fillna({"library": 0.0, "n_genes": 0})


def normalise(x: DataFrame, target: float = 1e4, total: bool = True, log: bool = True) -> DataFrame:
    """Values scaled to target per cell, then ln(1 + v). A cell's values meet once, in a window that adds them up."""
    if not (total or log):
        raise ValueError("nothing to do")
    value = F.col("value")
    if total:
        library = F.sum("value").over(Window.partitionBy("cell_id"))
        value = F.coalesce(F.try_divide(value * F.lit(float(target)), library), F.lit(0.0))
    if log:
        value = F.log(F.lit(1.0) + value)
    return x.select("cell_id", "gene_id", value.alias("value"))


def is_count_like(x: DataFrame) -> bool:
    """Whether there are values and every one is integral (so the data is not log-normalised); the first other one ends the search."""
    return x.where(F.col("value") != F.rint("value")).isEmpty() and not x.isEmpty()


def exact_median(values: DataFrame) -> float | None:
    """Exact median of column v: approximate percentiles bracket it, and only the different values between reach the driver."""
    r = values.agg(F.count("v").alias("n"), F.percentile_approx("v", [0.499, 0.501], 10_000).alias("q")).first()
    if not r["n"]:
        return None
    low, high = r["q"]
    below = values.where(F.col("v") < low).count()
    between = values.where(F.col("v").between(low, high)).groupBy("v").count().toPandas().sort_values("v")
    upto = below + between["count"].cumsum().to_numpy()
    mid = [float(between["v"].to_numpy()[np.searchsorted(upto, i, "right")]) for i in ((r["n"] - 1) // 2, r["n"] // 2)]
    return sum(mid) / 2


def labelled(x: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    return x.join(obs.select("cell_id", F.col(label).cast("string").alias("lab")), "cell_id")


def label_sizes(obs: DataFrame, label: str) -> DataFrame:
    return obs.groupBy(F.col(label).cast("string").alias("lab")).agg(F.count("*").cast("double").alias("n"))


def group_stats(x: DataFrame, obs: DataFrame, var: DataFrame, label: str, value: Column | None = None) -> DataFrame:
    """(lab, gene_id, n, s1, s2, nnz) for every label and gene: sums of v and v*v over stored values, zeros implicit.

    Partial sums are combined before the shuffle, so a label that holds most cells costs no more than others.
    """
    v = F.col("value") if value is None else value
    sums = labelled(x, obs, label).withColumn("v", v).groupBy("lab", "gene_id").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.count_if(F.col("v") != 0).alias("nnz"))
    grid = label_sizes(obs, label).crossJoin(var.select("gene_id"))
    return grid.join(sums, ["lab", "gene_id"], "left").fillna({"s1": 0.0, "s2": 0.0, "nnz": 0})


def against_control(stats: DataFrame, control: str, names: tuple[str, ...]) -> DataFrame:
    """Each label's row beside the control's of the same gene, whose columns get the suffix _c."""
    own = stats.where(F.col("lab") != control)
    base = stats.where(F.col("lab") == control).select("gene_id", *[F.col(c).alias(f"{c}_c") for c in names])
    return own.join(base, "gene_id")


def low_expression(pct_c: Column, mean_c: Column, pct_p: Column, mean_p: Column, min_pct_ctrl: float = 0.01, min_pct_pert: float = 0.002, min_mean_ctrl: float = 0.05, min_mean_pert: float = 0.005) -> Column:
    """Near zero in both groups. Thresholds that are all 0 or less filter nothing."""
    if max(min_pct_ctrl, min_pct_pert, min_mean_ctrl, min_mean_pert) <= 0:
        return F.lit(False)
    return (pct_c < min_pct_ctrl) & (mean_c < min_mean_ctrl) & (pct_p < min_pct_pert) & (mean_p < min_mean_pert)


def log2_fold(mean_p: Column, mean_c: Column) -> Column:
    """log2 fold change of means of ln(1 + v) values."""
    return F.log2((F.exp(mean_p) - 1 + 1e-9) / (F.exp(mean_c) - 1 + 1e-9))
