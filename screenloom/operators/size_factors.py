"""Median-of-ratios size factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from .groupstats import exact_median


def _filled(obs: DataFrame, ratios: DataFrame) -> DataFrame:
    """(cell_id, m): cells without a ratio get the median of the others, or 1 if there is none."""
    ratios = written(ratios, "ratios")
    middle = exact_median(ratios.select(F.col("m").alias("v")))
    return obs.select("cell_id").join(ratios, "cell_id", "left").select("cell_id", F.coalesce("m", F.lit(1.0 if middle is None else middle)).alias("m"))


def _finish(obs: DataFrame, ratios: DataFrame) -> DataFrame:
    """Filled ratios, scaled to a geometric mean of 1."""
    filled = _filled(obs, ratios)
    scale = filled.agg(F.exp(F.avg(F.log("m"))).alias("scale"))
    return filled.crossJoin(F.broadcast(scale)).select("cell_id", (F.col("m") / F.col("scale")).alias("size_factor"))


def sparse_size_factors(x: DataFrame, obs: DataFrame) -> DataFrame:
    """Medians over a cell's non-zero genes of value / geometric mean of the gene's non-zero values."""
    geo = x.groupBy("gene_id").agg(F.exp(F.avg(F.log("value"))).alias("geo"))
    ratios = x.join(geo, "gene_id").groupBy("cell_id").agg(F.percentile(F.col("value") / F.col("geo"), F.lit(0.5)).alias("m"))
    return _finish(obs, ratios)


def deseq_size_factors(x: DataFrame, obs: DataFrame, min_genes: int = 10) -> DataFrame:
    """Medians over the genes that are non-zero in every cell; with fewer than min_genes of them, the sparse kind.

    Counts and cells are read several times, so both are written first.
    """
    x, obs = written(x.select("cell_id", "gene_id", "value"), "counts"), written(obs.select("cell_id"), "cells")
    n = obs.count()
    whole = x.groupBy("gene_id").agg(F.count("*").alias("k"), F.exp(F.avg(F.log("value"))).alias("geo")).where(F.col("k") == n)
    if whole.limit(min_genes).count() < min_genes:
        return sparse_size_factors(x, obs)
    ratios = x.join(whole, "gene_id").groupBy("cell_id").agg(F.percentile(F.col("value") / F.col("geo"), F.lit(0.5)).alias("m"))
    return _finish(obs, ratios)


def comparison_size_factors(x: DataFrame, obs: DataFrame, label: str, control: str, chosen: str | None = None, min_genes: int = 5) -> DataFrame:
    """(lab, cell_id, size_factor) within the control and each label (or the chosen one); control cells come once per label.

    Medians over the genes that are non-zero in every cell of the comparison, or over its non-zero genes where fewer
    than min_genes are; then as above, per comparison.
    """
    cells = obs.select("cell_id", F.col(label).cast("string").alias("lab"))
    names = cells.where(F.col("lab") == chosen if chosen is not None else F.col("lab") != control).select("lab").distinct()
    home = cells.where(F.col("lab") == control).select("cell_id").crossJoin(F.broadcast(names)).select("lab", "cell_id")
    cells = home.unionByName(cells.join(names, "lab", "left_semi").select("lab", "cell_id"))
    own = cells.join(x, "cell_id")
    n = cells.groupBy("lab").agg(F.count("*").alias("n"))
    geo = own.groupBy("lab", "gene_id").agg(F.count("*").alias("k"), F.exp(F.avg(F.log("value"))).alias("geo")).join(n, "lab")
    whole = geo.groupBy("lab").agg(F.count_if(F.col("k") == F.col("n")).alias("whole"))
    geo = geo.join(whole, "lab").where((F.col("whole") < min_genes) | (F.col("k") == F.col("n"))).select("lab", "gene_id", "geo")
    ratios = own.join(geo, ["lab", "gene_id"]).groupBy("lab", "cell_id").agg(F.percentile(F.col("value") / F.col("geo"), F.lit(0.5)).alias("m"))
    mid = ratios.groupBy("lab").agg(F.percentile("m", F.lit(0.5)).alias("fill"))
    filled = cells.join(ratios, ["lab", "cell_id"], "left").join(mid, "lab", "left").select("lab", "cell_id", F.coalesce("m", "fill", F.lit(1.0)).alias("m"))
    scale = filled.groupBy("lab").agg(F.exp(F.avg(F.log("m"))).alias("scale"))
    return filled.join(scale, "lab").select("lab", "cell_id", (F.col("m") / F.col("scale")).alias("size_factor"))


def given_size_factors(obs: DataFrame, factors: DataFrame, scale: bool = True) -> DataFrame:
    """Checked user factors (cell_id, size_factor): one for each cell; those not finite or not positive become the median."""
    ok = F.when((F.col("size_factor") > 0) & ~F.isnan("size_factor") & (F.col("size_factor") < float("inf")), F.col("size_factor"))
    if not obs.select("cell_id").join(factors, "cell_id", "left_anti").isEmpty():
        raise ValueError("cells without a size factor")
    ratios = factors.select("cell_id", ok.alias("m")).where("m IS NOT NULL")
    return _finish(obs, ratios) if scale else _filled(obs, ratios).withColumnRenamed("m", "size_factor")
