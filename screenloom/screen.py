"""A perturbation screen as lazy tables, with the operators in four namespaces."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels
from .operators import differential, dimred, frames, nbglm, qc
from .operators.groupstats import clean_counts, normalise
from .operators.multitest import adjust
from .sources import store

METHODS = {"wilcoxon": "wilcoxon", "wilcox": "wilcoxon", "wilcoxon-test": "wilcoxon", "wilcox-test": "wilcoxon", "t-test": "t-test", "ttest": "t-test", "nb-glm": "nb-glm", "nb-glm-test": "nb-glm"}


@dataclass(frozen=True)
class Screen:
    """x (cell_id, gene_id, value without zeros), obs (cell_id, ...), var (gene_id, ...) and further tables by slot."""

    x: DataFrame
    obs: DataFrame
    var: DataFrame
    slots: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Screen:
        """A saved screen; nothing is read before an action. FileNotFoundError if there is none."""
        if not store.exists(spark, f"{path}/x"):
            raise FileNotFoundError(path)
        f, p = store.fs(spark, path)
        names = [s.getPath().getName() for s in f.listStatus(p)]
        read = {n: store.read_table(spark, f"{path}/{n}") for n in names if not n.startswith(("_", "."))}
        return cls(read.pop("x"), read.pop("obs"), read.pop("var"), read)

    @classmethod
    def of(cls, data: Screen | str | tuple[DataFrame, DataFrame, DataFrame], spark: SparkSession | None = None) -> Screen:
        """A screen, the path of a saved one, or its three tables; anything else raises TypeError."""
        if isinstance(data, cls):
            return data
        if isinstance(data, str):
            return cls.load(spark or SparkSession.active(), data)
        if isinstance(data, tuple) and len(data) == 3 and all(isinstance(d, DataFrame) for d in data):
            return cls(*data)
        raise TypeError("a screen is a Screen, a path, or the tables x, obs and var")

    @classmethod
    def load_metadata(cls, spark: SparkSession, path: str, slot: str) -> DataFrame:
        """obs or var of a saved screen alone; x is not touched."""
        if not store.exists(spark, f"{path}/{slot}"):
            raise FileNotFoundError(f"{path}/{slot}")
        return store.read_table(spark, f"{path}/{slot}")

    @classmethod
    def from_dense(cls, rows: DataFrame, obs: DataFrame, var: DataFrame) -> Screen:
        return cls(store.from_dense(rows), obs, var)

    def save(self, path: str, layout: str = "cells") -> None:
        x = {"cells": store.by_cell, "genes": store.by_gene}[layout](clean_counts(self.x))
        for name, df in {"x": x, "obs": self.obs, "var": self.var, **self.slots}.items():
            store.replace_table(df, f"{path}/{name}")
        store.write_mark(self.x.sparkSession, f"{path}/_layout", layout)

    def preview(self, n_obs: int = 5, n_vars: int = 5) -> str:
        """The first rows of obs and var as text."""
        parts = ((name, df.limit(n).toPandas()) for name, df, n in (("obs", self.obs, n_obs), ("var", self.var, n_vars)))
        return "\n".join(f"{name}\n{rows.to_string(index=False)}" for name, rows in parts)

    def write_slot(self, path: str, name: str, table: DataFrame) -> None:
        """Replace one further table of a saved screen; uns-like values are tables (key, value)."""
        if name in ("x", "obs", "var"):
            raise ValueError(f"{name} is no slot")
        store.replace_table(table, f"{path}/{name}")

    def write_obs(self, path: str, obs: DataFrame) -> None:
        self._metadata(path, "obs", obs)

    def write_var(self, path: str, var: DataFrame) -> None:
        self._metadata(path, "var", var)

    def _metadata(self, path: str, slot: str, df: DataFrame) -> None:
        held, key = store.read_table(df.sparkSession, f"{path}/{slot}"), {"obs": "cell_id", "var": "gene_id"}[slot]
        if df.count() != held.count():
            raise ValueError(f"{slot} has another number of rows")
        if not df.select(key).exceptAll(held.select(key)).isEmpty():
            raise ValueError(f"{slot} has other ids")
        store.replace_table(df, f"{path}/{slot}")

    def with_slot(self, **tables: DataFrame) -> Screen:
        return replace(self, slots=self.slots | tables)

    def standardised(self, label: str | None = None, control: str | None = None, genes: str | None = None) -> Screen:
        """The label column as "perturbation" with its control called "control"; gene names in "gene_name"."""
        label = label or labels.detect_label_column(self.obs)
        if label is None:
            raise ValueError("no label column found")
        control = labels.control_label(self.obs, label, control)
        lab = F.when(F.col(label).cast("string") == control, "control").otherwise(F.col(label).cast("string"))
        var = self.var
        genes = genes or labels.detect_gene_column(var)
        if genes:
            var = var.withColumn("gene_name", F.col(genes))
        return replace(self, obs=self.obs.withColumn("perturbation", lab), var=var)

    @cached_property
    def pp(self) -> Preprocessing:
        return Preprocessing(self)

    @cached_property
    def pb(self) -> Pseudobulk:
        return Pseudobulk(self)

    @cached_property
    def tl(self) -> Tools:
        return Tools(self)

    @cached_property
    def pl(self) -> Frames:
        return Frames(self)


def resolve(perturbation_column: str | None, groupby: str | None, name: str = "perturbation_column") -> str:
    """One of a parameter and its alias; both or neither raise TypeError."""
    if (perturbation_column is None) == (groupby is None):
        raise TypeError(f"give exactly one of {name} and its alias")
    return perturbation_column if perturbation_column is not None else groupby


@dataclass(frozen=True)
class Preprocessing:
    s: Screen

    def filter_cells(self, min_genes: int = 100) -> DataFrame:
        return qc.filter_cells(self.s.x, self.s.obs, min_genes)

    def filter_genes(self, min_cells: int = 100) -> DataFrame:
        return qc.filter_genes(self.s.x, self.s.var, min_cells)

    def filter_perturbations(self, perturbation_column: str, control_label: str | None = None, min_cells: int = 50) -> DataFrame:
        return qc.filter_labels(self.s.obs, perturbation_column, labels.control_label(self.s.obs, perturbation_column, control_label), min_cells)

    def qc_summary(self, perturbation_column: str, control_label: str | None = None, **options: int) -> Screen:
        control = labels.control_label(self.s.obs, perturbation_column, control_label)
        q = qc.quality_control(self.s.x, self.s.obs, self.s.var, perturbation_column, control, **options)
        return Screen(q.x, q.obs, q.var, {"qc_cells": q.cells, "qc_genes": q.genes})

    def normalize_total_log1p(self, target_sum: float = 1e4, normalize: bool = True, log1p: bool = True) -> Screen:
        return replace(self.s, x=normalise(self.s.x, target_sum, normalize, log1p))

    def to_gene_major(self) -> Screen:
        return replace(self.s, x=store.by_gene(self.s.x))

    def to_cell_major(self) -> Screen:
        return replace(self.s, x=store.by_cell(self.s.x))

    def pca(self, n_comps: int = 50, use_highly_variable: bool = True, method: str = "auto") -> Screen:
        p = dimred.pca(self.s.x, self.s.obs, self.s.var, n_comps, use_highly_variable, method)
        ratio = self.s.x.sparkSession.createDataFrame([(i, float(v), float(r)) for i, (v, r) in enumerate(zip(p.variance, p.variance_ratio, strict=True))], "pc int, variance double, ratio double")
        return self.s.with_slot(X_pca=p.scores, PCs=p.loadings, pca_variance=ratio)

    def neighbors(self, n_neighbors: int = 15, use_rep: str = "X_pca", n_pcs: int | None = None, metric: str = "euclidean") -> Screen:
        if use_rep not in self.s.slots:
            raise ValueError(f"no {use_rep}")
        if metric != "euclidean":
            raise ValueError(f"unknown metric {metric}")
        points = self.s.slots[use_rep]
        if n_pcs:
            points = points.withColumn("vec", F.slice("vec", 1, n_pcs))
        edges = dimred.neighbours(points, n_neighbors)
        return self.s.with_slot(distances=edges, connectivities=dimred.connectivities(edges))


@dataclass(frozen=True)
class Pseudobulk:
    s: Screen

    def average_log_expression(self, perturbation_column: str, control_label: str | None = None, perturbations: list[str] | None = None) -> DataFrame:
        return self._run(differential.average_log_expression, perturbation_column, control_label, perturbations)

    def pseudobulk(self, perturbation_column: str, control_label: str | None = None, perturbations: list[str] | None = None, baseline_count: float = 1.0) -> DataFrame:
        return self._run(differential.pseudobulk, perturbation_column, control_label, perturbations, baseline=baseline_count)

    def _run(self, f, label: str, control: str | None, chosen: list[str] | None, **options: float) -> DataFrame:
        control = labels.control_label(self.s.obs, label, control)
        if self.s.obs.where(F.col(label).cast("string") == control).isEmpty():
            raise ValueError("the control has no cells")
        if chosen is not None:
            chosen = [str(c) for c in chosen]
            have = {r[0] for r in self.s.obs.where(F.col(label).cast("string").isin(*chosen)).select(F.col(label).cast("string")).distinct().collect()} if chosen else set()
            if missing := [c for c in chosen if c not in have]:
                raise ValueError(f"labels without cells: {missing}")
        out = f(self.s.x, self.s.obs, self.s.var, label, control, **options)
        return out if chosen is None else out.where(F.col("lab").isin(*[str(c) for c in chosen]))


@dataclass(frozen=True)
class Tools:
    s: Screen

    def rank_genes_groups(self, perturbation_column: str | None = None, control_label: str | None = None, method: str = "wilcoxon", perturbations: list[str] | None = None, groupby: str | None = None, reference: str | None = None, corr_method: str = "benjamini-hochberg", **options) -> DataFrame:
        label = resolve(perturbation_column, groupby)
        if control_label is not None and reference is not None:
            raise TypeError("give one of control_label and reference")
        kind = METHODS.get(method.lower().replace("_", "-"))
        if kind is None:
            raise ValueError(f"unknown method {method}")
        s = self.s
        control = labels.control_label(s.obs, label, control_label if control_label is not None else reference)
        chosen = labels.candidates(s.obs, label, control, perturbations)
        obs = s.obs if perturbations is None else s.obs.where(F.col(label).cast("string").isin(control, *chosen))
        run = {"wilcoxon": differential.wilcoxon_test, "t-test": differential.t_test, "nb-glm": nbglm.nb_glm_test}[kind]
        return run(s.x.join(obs.select("cell_id"), "cell_id", "left_semi"), obs, s.var, label, control, correction=corr_method, **options)

    def shrink_lfc(self, result: DataFrame, **options) -> DataFrame:
        return nbglm.shrink_lfc(result, **options)

    def save_result(self, result: DataFrame, source: str, method: str, params: dict, output_dir: str | None = None, data_name: str | None = None) -> str:
        """Publish a result under its usual name; returns the path."""
        kind = METHODS[method.lower().replace("_", "-")].replace("-", "_")
        return store.write_result(result, store.result_path(source, kind, output_dir, data_name), params)

    def load_result(self, source: str, method: str, params: dict | None = None, output_dir: str | None = None, data_name: str | None = None) -> DataFrame | None:
        """The result saved under that name; None if there is none, or one of other parameters."""
        kind = METHODS[method.lower().replace("_", "-")].replace("-", "_")
        return store.load_result(self.s.x.sparkSession, store.result_path(source, kind, output_dir, data_name), params)

    def adjust(self, result: DataFrame, method: str) -> DataFrame:
        return adjust(result, method)

    def compute_overlap(self, sets: DataFrame) -> DataFrame:
        return frames.overlap(sets)

    def umap(self, init: str = "spectral", **options: float) -> Screen:
        """The graph laid out from its spectral embedding, or from X_pca ("pca")."""
        if "connectivities" not in self.s.slots:
            raise ValueError("no neighbour graph")
        if init not in ("spectral", "pca"):
            raise ValueError(f"unknown init {init}")
        start = self.s.slots["X_pca"] if init == "pca" else None
        return self.s.with_slot(X_umap=dimred.umap(self.s.slots["connectivities"], start, **options))


@dataclass(frozen=True)
class Frames:
    """The data behind each plot; drawing is left to the caller."""

    s: Screen

    def rank_genes_groups(self, result: DataFrame, groups: str | list[str] | None = None, n_genes: int = 25) -> DataFrame:
        return frames.tidy(result, groups, n_genes)

    def volcano(self, result: DataFrame, **options) -> DataFrame:
        return frames.volcano(result, **options)

    def top_genes_bar(self, result: DataFrame, group: str, n: int = 15) -> DataFrame:
        return frames.top_genes(result, group, n)

    def ma(self, label: str, control: str, logged: bool = False) -> DataFrame:
        return frames.ma(self.s.x, self.s.obs, self.s.var, label, control, logged)

    def qc_perturbation_counts(self, label: str, top_n: int | None = None) -> DataFrame:
        return frames.label_counts(self.s.obs, label, top_n)

    def qc_summary(self, column: str = "n_genes") -> DataFrame:
        return frames.qc_histogram(self.s.x, self.s.obs, column)

    def pca(self, *columns: str) -> DataFrame:
        return self.s.slots["X_pca"].join(self.s.obs.select("cell_id", *columns), "cell_id")

    def pca_variance_ratio(self) -> DataFrame:
        return self.s.slots["pca_variance"]

    def pca_loadings(self, pc: int = 0, n: int = 10) -> DataFrame:
        return frames.top_loadings(self.s.slots["PCs"], pc, n)

    def umap(self, *columns: str) -> DataFrame:
        return self.s.slots["X_umap"].join(self.s.obs.select("cell_id", *columns), "cell_id")

    def overlap_heatmap(self, sets: DataFrame) -> DataFrame:
        return frames.overlap(sets)
