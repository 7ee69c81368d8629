"""Pseudobulk effects, Welch and Wilcoxon tests of every label against the control."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import normal_p, t_p
from ..sources.store import written
from .groupstats import against_control, group_stats, is_count_like, label_sizes, labelled, log2_fold, low_expression, normalise
from .multitest import adjust

#: Up to this many labels, rank sums repeat the control's histogram per label in one plan.
WINDOW_LABELS = 16


def average_log_expression(x: DataFrame, obs: DataFrame, var: DataFrame, label: str, control: str, target: float = 1e4) -> DataFrame:
    """(lab, gene_id, perturbation_mean, control_mean, effect): means of ln(1 + normalised counts) over all cells."""
    means = group_stats(normalise(x, target), obs, var, label).withColumn("mean", F.col("s1") / F.col("n"))
    return _effect(means, control)


def pseudobulk(x: DataFrame, obs: DataFrame, var: DataFrame, label: str, control: str, baseline: float = 1.0, target: float = 1e4) -> DataFrame:
    """As above with ln(1 + baseline * mean of normalised counts)."""
    if baseline <= 0:
        raise ValueError("baseline must be positive")
    means = group_stats(normalise(x, target, log=False), obs, var, label).withColumn("mean", F.log(1 + F.lit(float(baseline)) * F.col("s1") / F.col("n")))
    return _effect(means, control)


def _effect(means: DataFrame, control: str) -> DataFrame:
    both = against_control(means, control, ("mean",))
    return both.select("lab", "gene_id", F.col("mean").alias("perturbation_mean"), F.col("mean_c").alias("control_mean"), (F.col("mean") - F.col("mean_c")).alias("effect"))


def _variance(n: str, s1: str, s2: str) -> Column:
    v = (F.col(s2) - F.col(s1) * F.col(s1) / F.col(n)) / F.greatest(F.col(n) - 1, F.lit(1.0))
    return F.when(F.col(n) > 1, F.greatest(v, F.lit(0.0))).otherwise(0.0)


def welch_statistics(x: DataFrame, obs: DataFrame, var: DataFrame, label: str, control: str, min_cells_expressed: int = 0, **thresholds: float) -> DataFrame:
    """(lab, gene_id, effect, statistic, df, logfoldchange, pts, pts_rest, tested) of log-normalised values.

    statistic and df are null for untested pairs (no spread, too few expressing cells, near zero in both groups);
    effect and logfoldchange are null only for the last.
    """
    stats = group_stats(x, obs, var, label).withColumn("mean", F.col("s1") / F.col("n")).withColumn("var", _variance("n", "s1", "s2")).withColumn("pct", F.col("nnz") / F.col("n"))
    d = against_control(stats, control, ("n", "mean", "var", "nnz", "pct"))
    a, b = F.col("var") / F.col("n"), F.col("var_c") / F.col("n_c")
    low = low_expression(F.col("pct_c"), F.col("mean_c"), F.col("pct"), F.col("mean"), **thresholds)
    part = lambda v, n: F.when(F.col(n) > 1, v * v / (F.col(n) - 1)).otherwise(0.0)
    d = d.withColumn("low", low).withColumn("se", F.sqrt(a + b)).withColumn("tested", (F.col("se") > 0) & (F.col("nnz") + F.col("nnz_c") >= min_cells_expressed) & ~F.col("low"))
    df = F.greatest(F.coalesce(F.try_divide((a + b) * (a + b), part(a, "n") + part(b, "n_c")), F.lit(1e6)), F.lit(1.0))
    shown = lambda c: F.when(~F.col("low"), c)
    effect = F.col("mean") - F.col("mean_c")
    return d.select("lab", "gene_id", shown(effect).alias("effect"), F.when(F.col("tested"), F.try_divide(effect, F.col("se"))).alias("statistic"), F.when(F.col("tested"), df).alias("df"), shown(log2_fold(F.col("mean"), F.col("mean_c"))).alias("logfoldchange"), F.col("pct").alias("pts"), F.col("pct_c").alias("pts_rest"), "tested")


def log_values(x: DataFrame, normalise_counts: bool) -> DataFrame:
    """x, normalised if it holds counts and that is wanted; ValueError if it is not."""
    if not is_count_like(x):
        return x
    if not normalise_counts:
        raise ValueError("values are counts; normalise them first or pass normalise_counts=True")
    return normalise(x)


def t_test(x: DataFrame, obs: DataFrame, var: DataFrame, label: str, control: str, correction: str = "benjamini-hochberg", normalise_counts: bool = False, **options: float) -> DataFrame:
    """Welch statistics with p-values, adjusted p-values and rank. Raw counts raise ValueError unless normalise_counts."""
    out = welch_statistics(log_values(x, normalise_counts), obs, var, label, control, **options)
    return ranked(adjust(out.withColumn("pvalue", t_p(F.col("statistic"), F.col("df"))), correction))


def ranked(d: DataFrame, by: str = "statistic") -> DataFrame:
    order = Window.partitionBy("lab").orderBy(F.abs(F.col(by)).desc_nulls_last(), "gene_id")
    return d.withColumn("rank", F.row_number().over(order))


def histogram(x: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """(gene_id, lab, value, k): how many cells of a label have a value, written: sums and ranks both come from it."""
    return written(labelled(x, obs, label).groupBy("gene_id", "lab", "value").agg(F.count("*").cast("double").alias("k")), "histogram")


def rank_sums(h: DataFrame, control: str, d: DataFrame) -> DataFrame:
    """(lab, gene_id, r, ties) of the pairs d, as windows over value histograms; the control's is repeated per label."""
    zero = F.lit(0.0)
    base = h.where(F.col("lab") == control).select("gene_id", "value", F.col("k").alias("kc"))
    parts = base.join(d.select("lab", "gene_id"), "gene_id").select("lab", "gene_id", "value", "kc", zero.alias("kp"))
    parts = parts.unionByName(h.where(F.col("lab") != control).select("lab", "gene_id", "value", zero.alias("kc"), F.col("k").alias("kp")))
    parts = parts.unionByName(d.select("lab", "gene_id", zero.alias("value"), (F.col("n_c") - F.col("nnz_c")).alias("kc"), (F.col("n") - F.col("nnz")).alias("kp")))
    t = parts.groupBy("lab", "gene_id", "value").agg(F.sum("kc").alias("kc"), F.sum("kp").alias("kp"))
    k = F.col("kc") + F.col("kp")
    upto = F.sum(k).over(Window.partitionBy("lab", "gene_id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("upto", upto)
    return t.groupBy("lab", "gene_id").agg(F.sum(F.col("kp") * (F.col("upto") - k + (k + 1) / F.lit(2.0))).alias("r"), F.sum(k * k * k - k).alias("ties"))


def rank_sums_by_gene(hist: DataFrame, obs: DataFrame, var: DataFrame, label: str, control: str) -> DataFrame:
    """The same of all pairs, gene by gene: the control's histogram is sorted once and each label's values looked up in it.

    A task holds the (label, value, count) histogram of one gene.
    """
    sizes = {r["lab"]: r["n"] for r in label_sizes(obs, label).where("lab IS NOT NULL").collect()}
    # Genes without values, and the control, have a row as well.
    some = var.select("gene_id", F.lit(control).alias("lab"), F.lit(0.0).alias("value"), F.lit(0.0).alias("k"))

    def one(t: pa.Table) -> pa.Table:
        lab, value, k = t.column("lab").to_numpy(zero_copy_only=False).astype(str), t.column("value").to_numpy(), t.column("k").to_numpy()
        order = np.lexsort((value, lab))
        names, at = np.unique(lab[order], return_index=True)
        spans = dict(zip(names.tolist(), np.split(order, at[1:]), strict=True))

        def whole(name: str) -> tuple[np.ndarray, np.ndarray]:
            """Values and counts with the implicit zeros."""
            own = spans.get(name, order[:0])
            v, n = np.append(value[own], 0.0), np.append(k[own], 0.0)
            n[-1] = sizes[name] - n.sum()
            o = np.argsort(v, kind="stable")
            return v[o], n[o]

        cv, ck = whole(control)
        cv, first = np.unique(cv, return_index=True)
        ck = np.add.reduceat(ck, first)
        before, cubes = np.concatenate(([0.0], np.cumsum(ck))), float((ck**3 - ck).sum())
        rows = []
        for name in sizes:
            if name == control:
                continue
            pv, pk = whole(name)
            lo, hi = np.searchsorted(cv, pv), np.searchsorted(cv, pv, side="right")
            tied, own = before[hi] - before[lo], np.concatenate(([0.0], np.cumsum(pk)))[:-1]
            r = float((pk * (before[lo] + own + (tied + pk + 1) / 2)).sum())
            # Ties of the control alone, put right where the label has the value too.
            rows.append((name, r, cubes + float(((tied + pk) ** 3 - (tied + pk) - (tied**3 - tied)).sum())))
        gene = t.column("gene_id").slice(0, 1).take(pa.array([0] * len(rows), pa.int32()))
        return pa.table({"lab": pa.array([x[0] for x in rows], pa.string()), "gene_id": gene, "r": pa.array([x[1] for x in rows], pa.float64()), "ties": pa.array([x[2] for x in rows], pa.float64())})

    return hist.unionByName(some.select(hist.columns)).groupBy("gene_id").applyInArrow(one, f"lab string, gene_id {dict(var.dtypes)['gene_id']}, r double, ties double")


def wilcoxon_statistics(x: DataFrame, obs: DataFrame, var: DataFrame, label: str, control: str, tie_correct: bool = True, min_cells_expressed: int = 0, by_gene: bool | None = None, **thresholds: float) -> DataFrame:
    """(lab, gene_id, u_stat, statistic, effect, logfoldchange, pts, pts_rest, tested) from value histograms.

    Ranks average ties; the zeros of a gene are one tie group and are counted, never sorted. Only (gene, label, value)
    counts travel. by_gene takes rank_sums_by_gene, which reads the control once per gene; left out, it is taken for
    more than WINDOW_LABELS labels. Both give the same numbers.
    """
    hist, k = histogram(x, obs, label), F.col("k")
    sums = hist.groupBy("lab", "gene_id").agg(F.sum(k * F.col("value")).alias("s1"), F.sum(F.when(F.col("value") != 0, k).otherwise(0.0)).cast("long").alias("nnz"))
    stats = label_sizes(obs, label).crossJoin(var.select("gene_id")).join(sums, ["lab", "gene_id"], "left").fillna({"s1": 0.0, "nnz": 0})
    stats = written(stats.withColumn("mean", F.col("s1") / F.col("n")).withColumn("pct", F.col("nnz") / F.col("n")), "sums")
    d = written(against_control(stats, control, ("n", "nnz", "mean", "pct")), "pairs")
    if by_gene is None:
        by_gene = label_sizes(obs, label).count() > WINDOW_LABELS
    sums = rank_sums_by_gene(hist, obs, var, label, control) if by_gene else rank_sums(hist, control, d)
    d = d.join(sums, ["lab", "gene_id"])
    N = F.col("n") + F.col("n_c")
    tie = F.greatest(1 - F.col("ties") / (N * N * N - N), F.lit(0.0)) if tie_correct else F.lit(1.0)
    spread = F.sqrt(tie * F.col("n") * F.col("n_c") * (N + 1) / F.lit(12.0))
    low = low_expression(F.col("pct_c"), F.col("mean_c"), F.col("pct"), F.col("mean"), **thresholds)
    u = F.col("r") - F.col("n") * (F.col("n") + 1) / F.lit(2.0)
    z = F.coalesce(F.try_divide(F.col("r") - F.col("n") * (N + 1) / F.lit(2.0), spread), F.lit(0.0))
    d = d.withColumn("tested", ~low & (F.col("nnz") + F.col("nnz_c") >= min_cells_expressed))
    shown = lambda c: F.when(F.col("tested"), c)
    return d.select("lab", "gene_id", shown(u).alias("u_stat"), shown(z).alias("statistic"), shown(u / (F.col("n") * F.col("n_c")) - 0.5).alias("effect"), shown(log2_fold(F.col("mean"), F.col("mean_c"))).alias("logfoldchange"), F.col("pct").alias("pts"), F.col("pct_c").alias("pts_rest"), "tested")


def wilcoxon_test(x: DataFrame, obs: DataFrame, var: DataFrame, label: str, control: str, correction: str = "benjamini-hochberg", normalise_counts: bool = False, **options: float) -> DataFrame:
    """Rank-sum statistics with p-values, adjusted p-values and rank. Raw counts raise ValueError unless normalise_counts."""
    out = wilcoxon_statistics(log_values(x, normalise_counts), obs, var, label, control, **options)
    return ranked(adjust(out.withColumn("pvalue", normal_p(F.col("statistic"))), correction))
