"""Frames behind tables and plots, set overlap, and comparison of results."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groupstats import group_stats, library_sizes, normalise


def tidy(result: DataFrame, groups: str | list[str] | None = None, n_genes: int | None = None) -> DataFrame:
    """Ranked rows of one, some or all labels; an unknown label raises KeyError."""
    out = result
    if groups is not None:
        want = [groups] if isinstance(groups, str) else list(groups)
        have = {r["lab"] for r in result.where(F.col("lab").isin(*want)).select("lab").distinct().collect()}
        if missing := [g for g in want if g not in have]:
            raise KeyError(missing[0])
        out = out.where(F.col("lab").isin(*want))
    return out.where(F.col("rank") <= n_genes) if n_genes else out


class Results(Mapping):
    """A result by label: results["A"] is the label's rows in order of rank, nothing is read before an action."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    @cached_property
    def labels(self) -> list[str]:
        return sorted(r["lab"] for r in self.table.select("lab").distinct().collect())

    def __getitem__(self, lab: str) -> DataFrame:
        if lab not in self.labels:
            raise KeyError(lab)
        return self.table.where(F.col("lab") == lab).orderBy("rank")

    def __iter__(self) -> Iterator[str]:
        return iter(self.labels)

    def __len__(self) -> int:
        return len(self.labels)


def summary_of_tests(result: DataFrame, max_p: float = 0.05, effect: str = "effect") -> DataFrame:
    """(lab, genes, tested, significant, up, down): how many genes of each label were tested and passed."""
    sig = F.coalesce(F.col("pvalue_adj") < max_p, F.lit(False))
    return result.groupBy("lab").agg(F.count("*").alias("genes"), F.count("pvalue").alias("tested"), F.count_if(sig).alias("significant"), F.count_if(sig & (F.col(effect) > 0)).alias("up"), F.count_if(sig & (F.col(effect) < 0)).alias("down"))


def with_names(result: DataFrame, var: DataFrame, column: str = "gene_name") -> DataFrame:
    """result with the name of each gene; genes unknown to var have none."""
    return result.join(var.select("gene_id", F.col(column).alias("gene")), "gene_id", "left")


def volcano(result: DataFrame, p: str = "pvalue_adj", fold: str = "logfoldchange", max_p: float = 0.05, min_fold: float = 1.0) -> DataFrame:
    score = -F.log10(F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(1e-300)))
    sig = (F.col(p) < max_p) & (F.abs(F.col(fold)) >= min_fold)
    side = F.when(sig & (F.col(fold) > 0), "up").when(sig, "down").otherwise("none")
    return result.select("lab", "gene_id", fold, score.alias("score"), sig.alias("significant"), side.alias("direction"))


def top_genes(result: DataFrame, group: str, n: int = 15) -> DataFrame:
    return tidy(result, group).where("statistic IS NOT NULL").orderBy(F.desc("statistic"), "gene_id").limit(n)


def ma(x: DataFrame, obs: DataFrame, var: DataFrame, label: str, control: str, logged: bool = False) -> DataFrame:
    """(lab, gene_id, a, m): mean level against difference; raw means go through ln(1 + v)."""
    src = normalise(x) if logged else x
    means = group_stats(src, obs, var, label).select("lab", "gene_id", (F.col("s1") / F.col("n")).alias("mean"))
    base = means.where(F.col("lab") == control).select("gene_id", F.col("mean").alias("mean_c"))
    both = means.where(F.col("lab") != control).join(base, "gene_id")
    mid = (F.col("mean") + F.col("mean_c")) / 2
    m = F.col("mean") - F.col("mean_c") if logged else F.log(1 + F.col("mean")) - F.log(1 + F.col("mean_c"))
    return both.select("lab", "gene_id", (mid if logged else F.log(1 + mid)).alias("a"), m.alias("m"))


def label_counts(obs: DataFrame, label: str, top: int | None = None) -> DataFrame:
    out = obs.groupBy(F.col(label).cast("string").alias("lab")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lab")
    return out.limit(top) if top else out


def qc_histogram(x: DataFrame, obs: DataFrame, column: str = "n_genes", bins: int = 50) -> DataFrame:
    """(bin, low, n): equal bins from the least to the largest value; the last bin holds its upper end."""
    d = library_sizes(x, obs).select(F.col(column).cast("double").alias("v"))
    edge = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)))
    return d.crossJoin(F.broadcast(edge)).select(place.cast("int").alias("bin"), "lo", width.alias("w")).groupBy("bin").agg(F.max(F.col("lo") + F.col("bin") * F.col("w")).alias("low"), F.count("*").alias("n"))


def top_loadings(loadings: DataFrame, pc: int, n: int = 10) -> DataFrame:
    w = F.element_at("vec", pc + 1)
    return loadings.select("gene_id", w.alias("loading")).orderBy(F.desc(F.abs("loading")), "gene_id").limit(n)


def overlap(sets: DataFrame) -> DataFrame:
    """sets (name, element) -> (a, b, n_common, n_a, n_b, jaccard) of all ordered pairs of names, equal ones included."""
    own = sets.distinct()
    size = own.groupBy("name").agg(F.count_if(F.col("element").isNotNull()).alias("n"))
    common = own.toDF("a", "element").join(own.toDF("b", "element"), "element").groupBy("a", "b").agg(F.count("*").alias("n_common"))
    pairs = size.toDF("a", "n_a").crossJoin(size.toDF("b", "n_b")).join(common, ["a", "b"], "left").fillna({"n_common": 0})
    return pairs.select("a", "b", "n_common", "n_a", "n_b", F.coalesce(F.try_divide(F.col("n_common"), F.col("n_a") + F.col("n_b") - F.col("n_common")), F.lit(0.0)).alias("jaccard"))


def average_rank(d: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return d.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0))


def correlations(a: DataFrame, b: DataFrame, value: str = "statistic", p_values: bool = False) -> DataFrame:
    """(lab, n, pearson, spearman) of two results on (lab, gene_id); pairs with a null are left out."""
    c = -F.log10(F.greatest(F.least(F.col(value), F.lit(1.0)), F.lit(1e-300))) if p_values else F.col(value)
    both = a.select("lab", "gene_id", c.alias("x")).join(b.select("lab", "gene_id", c.alias("y")), ["lab", "gene_id"]).where("x IS NOT NULL AND y IS NOT NULL")
    both = average_rank(average_rank(both, ["lab"], "x", "rx"), ["lab"], "y", "ry")
    return both.groupBy("lab").agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def summary(c: DataFrame) -> DataFrame:
    return c.agg(*[f(m).alias(f"{n}_{m}") for m in ("pearson", "spearman") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def auroc(d: DataFrame, score: str, positive: str) -> DataFrame:
    """(lab, auroc) of score for the boolean column positive, by the rank sum."""
    r = average_rank(d.where(F.col(score).isNotNull()), ["lab"], score, "_r")
    pos, neg = F.count_if(F.col(positive)), F.count_if(~F.col(positive))
    return r.groupBy("lab").agg(F.try_divide(F.sum(F.when(F.col(positive), F.col("_r"))) - pos * (pos + 1) / F.lit(2.0), (pos * neg).cast("double")).alias("auroc"))


def max_abs_difference(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    both = a.select("lab", "gene_id", F.col(value).alias("x")).join(b.select("lab", "gene_id", F.col(value).alias("y")), ["lab", "gene_id"])
    return both.groupBy("lab").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("difference"))


def top_overlap(a: DataFrame, b: DataFrame, ks: tuple[int, ...] = (50, 100, 500), p: str = "pvalue", effect: str = "effect") -> DataFrame:
    """(lab, k, share): genes among the first k of both, of k; order by p, then absolute effect, then gene."""
    order = Window.partitionBy("lab").orderBy(F.col(p).asc_nulls_last(), F.abs(F.col(effect)).desc_nulls_last(), "gene_id")
    top = lambda d, n: d.select("lab", "gene_id", F.row_number().over(order).alias(n))
    both = top(a, "i").join(top(b, "j"), ["lab", "gene_id"])
    k = F.explode(F.array(*[F.lit(v) for v in ks]))
    return both.select("lab", "i", "j", k.alias("k")).groupBy("lab", "k").agg((F.count_if((F.col("i") <= F.col("k")) & (F.col("j") <= F.col("k"))) / F.col("k")).alias("share"))
