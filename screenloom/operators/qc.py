"""Quality control: cells by genes, labels by cells, genes by kept cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from .groupstats import library_sizes


@dataclass(frozen=True)
class QualityControl:
    """cells (cell_id, lab, n_genes, keep), genes (gene_id, n_cells, keep), and the kept x, obs and var."""

    cells: DataFrame
    genes: DataFrame
    x: DataFrame
    obs: DataFrame
    var: DataFrame


def filter_cells(x: DataFrame, obs: DataFrame, min_genes: int = 100) -> DataFrame:
    """(cell_id, n_genes, keep)."""
    return library_sizes(x, obs).select("cell_id", "n_genes", (F.col("n_genes") >= min_genes).alias("keep"))


def filter_labels(obs: DataFrame, label: str, control: str, min_cells: int = 50, base: DataFrame | None = None) -> DataFrame:
    """(cell_id, lab, keep): cells of base whose label is the control or has at least min_cells of them."""
    cells = obs.select("cell_id", F.col(label).cast("string").alias("lab"))
    cells = cells.withColumn("in_base", F.lit(True)) if base is None else cells.join(base.select("cell_id", F.col("keep").alias("in_base")), "cell_id")
    n = cells.where("in_base").groupBy("lab").agg(F.count("*").alias("n"))
    return cells.join(n, "lab", "left").select("cell_id", "lab", (F.col("in_base") & ((F.col("lab") == control) | (F.coalesce("n", F.lit(0)) >= min_cells))).alias("keep"))


def filter_genes(x: DataFrame, var: DataFrame, min_cells: int = 100, cells: DataFrame | None = None) -> DataFrame:
    """(gene_id, n_cells, keep), counted over the kept cells only."""
    kept = x if cells is None else x.join(cells.where("keep").select("cell_id"), "cell_id", "left_semi")
    n = kept.groupBy("gene_id").agg(F.count("*").alias("n_cells"))
    return var.select("gene_id").join(n, "gene_id", "left").fillna({"n_cells": 0}).withColumn("keep", F.col("n_cells") >= min_cells)


def quality_control(x: DataFrame, obs: DataFrame, var: DataFrame, label: str, control: str, min_genes: int = 100, min_cells_per_label: int = 50, min_cells_per_gene: int = 100) -> QualityControl:
    """Cells, then labels by kept cells, then genes by kept cells. The narrow table of cells is written once; x is read
    for it, for the genes, and for the kept values."""
    first = filter_cells(x, obs, min_genes)
    second = filter_labels(obs, label, control, min_cells_per_label, first)
    cells = written(second.join(first.select("cell_id", "n_genes"), "cell_id").select("cell_id", "lab", "n_genes", "keep"), "qc-cells")
    genes = filter_genes(x, var, min_cells_per_gene, cells)
    kept_cells, kept_genes = cells.where("keep").select("cell_id"), genes.where("keep").select("gene_id")
    kept = x.join(kept_cells, "cell_id", "left_semi").join(kept_genes, "gene_id", "left_semi")
    return QualityControl(cells, genes, kept, obs.join(kept_cells, "cell_id", "left_semi"), var.join(kept_genes, "gene_id", "left_semi"))


def adaptive_thresholds(x: DataFrame, obs: DataFrame, var: DataFrame, label: str, conservative: bool = True) -> dict[str, int]:
    """Thresholds from percentiles over all labels, genes and cells. Counts take few different values, so exact percentiles are small."""
    q = 0.1 if conservative else 0.05
    labels = obs.groupBy(label).count().agg(F.percentile("count", F.lit(q)).alias("v")).first()["v"] or 0
    per_gene = filter_genes(x, var, 0).agg(F.percentile("n_cells", F.lit(q)).alias("v")).first()["v"] or 0
    per_cell = library_sizes(x, obs).agg(F.percentile("n_genes", F.lit(0.5)).alias("v")).first()["v"] or 0
    clip = lambda v, low, high: int(max(low, min(high, v)))
    return {"min_cells_per_label": clip(labels, 5, 50), "min_cells_per_gene": clip(per_gene, 5, 100), "min_genes": clip(per_cell // 10, 5, 50)}


def gene_count_delta(x: DataFrame, var: DataFrame, removed: DataFrame) -> DataFrame:
    """(gene_id, n_cells): how many of the removed cells (cell_id) express each gene; subtract it from earlier counts."""
    n = x.join(removed.select("cell_id"), "cell_id", "left_semi").groupBy("gene_id").agg(F.count("*").alias("n_cells"))
    return var.select("gene_id").join(n, "gene_id", "left").fillna({"n_cells": 0})
