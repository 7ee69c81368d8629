"""Registered queries of whole results, model fits with closed forms, layouts and result frames, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import differential, frames, nbglm, qc, size_factors
from ..operators.groupstats import normalise
from ..sources import store
from ..streaming.sums import streamed_sums
from .screen_queries import _DENSE, _NORM, _SPARSE, SQL as BASE_SQL
from .screen_queries import _stats, _welch, _wilcoxon, correlated, dense, r, rounded, sparse, table

RESULT = ("effect", "statistic", "pvalue", "pvalue_adj", "logfoldchange", "pts", "pts_rest")


def whole_t_test(spark: SparkSession, d: str) -> DataFrame:
    x, obs, var, lab, ctrl = dense(spark, d)
    return differential.t_test(normalise(x), obs, var, lab, ctrl)


def t_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole_t_test(spark, d), *RESULT, "df", digits=5).withColumn("rank", F.col("rank").cast("long"))


def wilcoxon_test(spark: SparkSession, d: str) -> DataFrame:
    x, obs, var, lab, ctrl = dense(spark, d)
    out = differential.wilcoxon_test(normalise(x), obs, var, lab, ctrl)
    return rounded(out, *RESULT, "u_stat", digits=5).withColumn("rank", F.col("rank").cast("long"))


def wilcoxon_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    x, obs, var, lab, ctrl = dense(spark, d)
    out = differential.wilcoxon_test(normalise(x), obs, var, lab, ctrl, correction="bonferroni")
    return rounded(out.select("lab", "gene_id", "pvalue_adj"), "pvalue_adj", digits=5)


def volcano(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frames.volcano(whole_t_test(spark, d), min_fold=0.05), "score", "logfoldchange", digits=4)


def top_genes(spark: SparkSession, d: str) -> DataFrame:
    return frames.top_genes(t_test(spark, d), "MACHINERY", 7).select("lab", "gene_id", "statistic")


def tidy_groups(spark: SparkSession, d: str) -> DataFrame:
    return frames.tidy(t_test(spark, d), ["MACHINERY", "FURNITURE"], 3).select("lab", "gene_id", "rank")


def summary_of_tests(spark: SparkSession, d: str) -> DataFrame:
    return frames.summary_of_tests(whole_t_test(spark, d), 0.5)


def named_genes(spark: SparkSession, d: str) -> DataFrame:
    """The first genes of every label of the sparse Welch test, by their part's name."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_name"))
    first = frames.tidy(differential.ranked(_welch(spark, d, sparse)), None, 4)
    return frames.with_names(first.select("lab", "gene_id", F.col("rank").cast("long").alias("rank")), names)


def auroc(spark: SparkSession, d: str) -> DataFrame:
    both = _wilcoxon(spark, d, dense).select("lab", "gene_id", "statistic").join(_welch(spark, d, dense).select("lab", "gene_id", F.col("effect").alias("e")), ["lab", "gene_id"])
    return rounded(frames.auroc(both.withColumn("up", F.col("e") > 0), "statistic", "up"), "auroc")


def top_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = lambda w: w.withColumn("pvalue", r(1 / (1 + F.col("statistic") * F.col("statistic"))))
    out = frames.top_overlap(p(_wilcoxon(spark, d, dense)), p(_welch(spark, d, dense)), (5, 10))
    return rounded(out.withColumn("k", F.col("k").cast("long")), "share")


def largest_difference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frames.max_abs_difference(_wilcoxon(spark, d, dense), _welch(spark, d, dense), "statistic"), "difference", digits=4)


def correlation_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frames.summary(correlated(spark, d)), "mean_pearson", "sd_pearson", "mean_spearman", "sd_spearman", digits=4)


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    x, obs, var, lab, _ = sparse(spark, d)
    return spark.createDataFrame([qc.adaptive_thresholds(x, obs, var, lab)], "min_cells_per_label int, min_cells_per_gene int, min_genes int")


def count_delta(spark: SparkSession, d: str) -> DataFrame:
    x, obs, var, lab, _ = sparse(spark, d)
    return qc.gene_count_delta(x, var, obs.where(F.col(lab) == "1-URGENT"))


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orders by line number: a matrix whose genes are small whole numbers."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_linenumber").cast("int").alias("gene_id")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


def dense_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = store.to_dense(line_counts(spark, d), 8)
    return rows.select("cell_id", F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",").alias("row"))


def sparse_rows(spark: SparkSession, d: str) -> DataFrame:
    return store.from_dense(store.to_dense(line_counts(spark, d), 8)).withColumn("gene_id", F.col("gene_id").cast("long"))


def gene_major(spark: SparkSession, d: str) -> DataFrame:
    return store.written(store.by_gene(dense(spark, d)[0]), "gene-major")


def cell_major(spark: SparkSession, d: str) -> DataFrame:
    return store.written(store.by_cell(dense(spark, d)[0]), "cell-major")


def block_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums per block of 256 cells, a block a task."""
    run = lambda p: pd.DataFrame({"block": [int(p["block"].iloc[0])], "n": [len(p)], "total": [float(p["value"].sum())]})
    return store.map_blocks(dense(spark, d)[0], run, "block long, n long, total double", "cell_id", 256)


def sorted_places(spark: SparkSession, d: str) -> DataFrame:
    _, obs, _, lab, ctrl = sparse(spark, d)
    return store.sorted_cells(obs, lab, ctrl)[0].select("cell_id", "lab", "place")


def label_slice(spark: SparkSession, d: str) -> DataFrame:
    x, obs, var, lab, ctrl = sparse(spark, d)
    path = f"{store.shared_folder(spark)}/sorted-{uuid.uuid4().hex}"
    store.write_sorted(x, obs, var, path, lab, ctrl)
    return store.label_slice(spark, path, "2-HIGH", lab).select("cell_id", "gene_id", "value")


def reloaded_result(spark: SparkSession, d: str) -> DataFrame:
    path = f"{store.shared_folder(spark)}/{uuid.uuid4().hex}/screenloom_welch"
    store.write_result(_welch(spark, d, dense), path, {"test": "welch"})
    return store.load_result(spark, path, {"test": "welch"}).select("lab", "gene_id", "statistic")


def label_order(spark: SparkSession, d: str) -> DataFrame:
    _, obs, _, lab, ctrl = sparse(spark, d)
    return spark.createDataFrame(list(enumerate(labels.candidates(obs, lab, ctrl))), "place long, lab string")


def mapped_genes(spark: SparkSession, d: str) -> DataFrame:
    var = table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_brand").alias("gene_name"))
    mapping = var.select(F.col("gene_name").alias("id")).distinct().where("id LIKE '%1'").select("id", F.concat(F.lit("S-"), "id").alias("symbol"))
    return labels.gene_names(labels.map_genes(var, mapping, "gene_name"), "gene_name")


def standard_labels(spark: SparkSession, d: str) -> DataFrame:
    from ..screen import Screen

    x, obs, var, lab, ctrl = sparse(spark, d)
    return Screen(x, obs, var).standardised(lab, ctrl).obs.groupBy("perturbation").agg(F.count("*").alias("n"))


def given_factors(spark: SparkSession, d: str) -> DataFrame:
    """Account balances as size factors: those that are not positive become the median."""
    _, obs, *_ = dense(spark, d)
    given = table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_acctbal").cast("double").alias("size_factor"))
    return rounded(size_factors.given_size_factors(obs, given), "size_factor")


def pair_factors(spark: SparkSession, d: str) -> DataFrame:
    x, obs, _, lab, ctrl = dense(spark, d)
    return rounded(size_factors.comparison_size_factors(x, obs, lab, ctrl), "size_factor")


def ones(obs: DataFrame) -> DataFrame:
    return obs.select("cell_id", F.lit(1.0).alias("size_factor"))


FIT = ("logfoldchange", "intercept", "standard_error_ln", "statistic", "pvalue")


def nb_known_dispersion(spark: SparkSession, d: str) -> DataFrame:
    """Without size factors, two groups have means for estimates; the dispersion is given."""
    x, obs, var, lab, ctrl = dense(spark, d)
    out = nbglm.nb_glm_test(x, obs, var, lab, ctrl, size_factors=ones(obs), dispersion=0.5, se_method="fisher")
    return rounded(out.select("lab", "gene_id", *FIT), *FIT, digits=4)


def nb_frozen_control(spark: SparkSession, d: str) -> DataFrame:
    x, obs, var, lab, ctrl = dense(spark, d)
    out = nbglm.nb_glm_test(x, obs, var, lab, ctrl, size_factors=ones(obs), dispersion=0.5, se_method="fisher", freeze_control=True)
    return rounded(out.select("lab", "gene_id", *FIT), *FIT, digits=4)


def nb_pair_moments(spark: SparkSession, d: str) -> DataFrame:
    x, obs, var, lab, ctrl = dense(spark, d)
    out = nbglm.nb_glm_test(x, obs, var, lab, ctrl, size_factors=ones(obs), shrink_dispersion=False)
    return rounded(out.select("lab", "gene_id", "dispersion_raw"), "dispersion_raw", digits=4)


def nb_gene_moments(spark: SparkSession, d: str) -> DataFrame:
    x, obs, var, *_ = dense(spark, d)
    factors = size_factors.sparse_size_factors(x, obs)
    return rounded(nbglm.global_dispersion(x, factors, var)[0], "base_mean", "dispersion_raw", digits=5)


def streaming_sums(spark: SparkSession, d: str) -> DataFrame:
    """Label by gene sums of a stream of counts, read to its end."""
    x, obs, _, lab, _ = dense(spark, d)
    held = store.written(x, "stream")
    path, name = held.inputFiles()[0].rpartition("/")[0], f"sums_{uuid.uuid4().hex}"
    stream = streamed_sums(spark.readStream.schema(held.schema).parquet(path), obs, lab)
    query = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    query.option("checkpointLocation", f"{store.shared_folder(spark)}/{name}").start().awaitTermination()
    return spark.table(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "t_test": t_test,
    "wilcoxon_test": wilcoxon_test,
    "wilcoxon_bonferroni": wilcoxon_bonferroni,
    "volcano": volcano,
    "top_genes": top_genes,
    "tidy_groups": tidy_groups,
    "test_summary": summary_of_tests,
    "named_genes": named_genes,
    "auroc": auroc,
    "top_overlap": top_overlap,
    "largest_difference": largest_difference,
    "correlation_summary": correlation_summary,
    "qc_thresholds": thresholds,
    "count_delta": count_delta,
    "dense_rows": dense_rows,
    "sparse_rows": sparse_rows,
    "gene_major": gene_major,
    "cell_major": cell_major,
    "block_sums": block_sums,
    "sorted_places": sorted_places,
    "label_slice": label_slice,
    "reloaded_result": reloaded_result,
    "label_order": label_order,
    "mapped_genes": mapped_genes,
    "standard_labels": standard_labels,
    "given_factors": given_factors,
    "pair_factors": pair_factors,
    "nb_known_dispersion": nb_known_dispersion,
    "nb_frozen_control": nb_frozen_control,
    "nb_pair_moments": nb_pair_moments,
    "nb_gene_moments": nb_gene_moments,
    "streaming_sums": streaming_sums,
}

#: Two-sided p-values by Simpson's rule: Student's t over the angle with tangent t / sqrt(df), the normal over z itself.
_T_P = """list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END)
            * pow(cos(least(a0 + i * (least(pi() / 2, a0 + 14 / sqrt(df)) - a0) / 2000e0, pi() / 2)), df - 1)))
         * (least(pi() / 2, a0 + 14 / sqrt(df)) - a0) / 2000e0 / 3 * 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - lgamma(0.5e0))"""
_Z_P = """list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END)
            * exp(-(a0 + i * 14 / 2000e0) * (a0 + i * 14 / 2000e0) / 2))) * 14 / 2000e0 / 3 * sqrt(2 / pi())"""


def _adjusted(source: str, cols: str) -> str:
    """Adjusted values and ranks of a table with full statistics and p."""
    return f"""
pi_ AS (SELECT *, count(p) OVER (PARTITION BY lab) AS n_p, row_number() OVER (PARTITION BY lab ORDER BY p NULLS LAST, gene_id) AS i FROM {source}),
adj AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(min(p * n_p / i) OVER (PARTITION BY lab ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1e0) END AS q,
               row_number() OVER (PARTITION BY lab ORDER BY abs(stat) DESC NULLS LAST, gene_id) AS rank FROM pi_),
res AS (SELECT lab, gene_id, {cols}, round(stat, 5) + 0.0 AS statistic, round(p, 5) AS pvalue, round(q, 5) AS pvalue_adj,
               CASE WHEN shown THEN round(log2((exp(mean) - 1 + 1e-9) / (exp(mean_c) - 1 + 1e-9)), 5) + 0.0 END AS logfoldchange,
               round(pct, 5) AS pts, round(pct_c, 5) AS pts_rest, tested, rank FROM adj)"""


_T_TEST = f"""{_DENSE}, {_NORM}, {_stats("xn", "value")},
w AS (SELECT *, v / n AS a, v_c / n_c AS b, sqrt(v / n + v_c / n_c) AS se FROM d),
k AS (SELECT *, NOT low AS shown, se > 0 AND NOT low AS tested, (CASE WHEN n > 1 THEN a * a / (n - 1) ELSE 0 END) + (CASE WHEN n_c > 1 THEN b * b / (n_c - 1) ELSE 0 END) AS den FROM w),
s AS (SELECT *, CASE WHEN tested THEN (mean - mean_c) / se END AS stat, CASE WHEN tested THEN greatest(CASE WHEN den = 0 THEN 1e6 ELSE (a + b) * (a + b) / den END, 1.0) END AS df FROM k),
s2 AS (SELECT *, atan(abs(stat) / sqrt(df)) AS a0 FROM s),
tp AS (SELECT *, CASE WHEN stat IS NOT NULL THEN {_T_P} END AS p FROM s2),{_adjusted("tp", "CASE WHEN shown THEN round(mean - mean_c, 5) + 0.0 END AS effect, round(df, 5) AS df")}"""

_W_TEST = f"""{_DENSE}, {_NORM}, {_stats("xn", "value")},
h AS (SELECT gene_id, lab, value, CAST(count(*) AS DOUBLE) AS k FROM xn JOIN obs ON xn.cell_id = obs.cell_id GROUP BY 1, 2, 3),
u AS (SELECT d.lab, d.gene_id, value, k AS kc, 0.0 AS kp FROM h JOIN d ON h.gene_id = d.gene_id CROSS JOIN ctrl WHERE h.lab = ctrl.ctrl
      UNION ALL SELECT lab, gene_id, value, 0.0, k FROM h CROSS JOIN ctrl WHERE lab <> ctrl.ctrl
      UNION ALL SELECT lab, gene_id, 0.0, n_c - nnz_c, n - nnz FROM d),
t AS (SELECT lab, gene_id, value, sum(kc)::DOUBLE AS kc, sum(kp)::DOUBLE AS kp FROM u GROUP BY 1, 2, 3),
cum AS (SELECT *, kc + kp AS k, sum(kc + kp) OVER (PARTITION BY lab, gene_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto FROM t),
rk AS (SELECT lab, gene_id, sum(kp * (upto - k + (k + 1) / 2.0)) AS r, sum(k * k * k - k) AS ties FROM cum GROUP BY 1, 2),
z AS (SELECT d.*, NOT d.low AS tested, NOT d.low AS shown, r - n * (n + 1) / 2.0 AS u, (r - n * (n + n_c + 1) / 2.0) AS num,
             sqrt((1 - ties / ((n + n_c) * (n + n_c) * (n + n_c) - (n + n_c))) * n * n_c * (n + n_c + 1) / 12.0) AS sd
      FROM d JOIN rk ON d.lab = rk.lab AND d.gene_id = rk.gene_id),
s AS (SELECT *, CASE WHEN tested THEN CASE WHEN sd = 0 THEN 0.0 ELSE num / sd END END AS stat FROM z),
s2 AS (SELECT *, abs(stat) AS a0 FROM s),
tp AS (SELECT *, CASE WHEN stat IS NOT NULL THEN {_Z_P} END AS p FROM s2),{_adjusted("tp", "CASE WHEN tested THEN round(u, 5) + 0.0 END AS u_stat, CASE WHEN tested THEN round(u / (n * n_c) - 0.5, 5) + 0.0 END AS effect")}"""

_CLOSED = f"""{_DENSE}, {_stats("x", "value")},
tot AS (SELECT lab, gene_id, sum(value) AS total FROM x JOIN obs ON x.cell_id = obs.cell_id GROUP BY 1, 2),
k AS (SELECT d.*, NOT low AND coalesce(p.total, 0) + coalesce(c.total, 0) >= 1 AS tested, greatest(mean, 0.5) AS m, greatest(mean_c, 0.5) AS m_c
      FROM d CROSS JOIN ctrl LEFT JOIN tot p ON d.lab = p.lab AND d.gene_id = p.gene_id LEFT JOIN tot c ON c.lab = ctrl.ctrl AND d.gene_id = c.gene_id),
f AS (SELECT *, ln(m / m_c) AS b, sqrt((1 + 0.5 * m) / (n * m) + (1 + 0.5 * m_c) / (n_c * m_c)) AS se FROM k),
s2 AS (SELECT *, b / se AS stat, abs(b / se) AS a0 FROM f)
SELECT lab, gene_id, CASE WHEN tested THEN round(b / ln(2), 4) + 0.0 END AS logfoldchange, CASE WHEN tested THEN round(ln(m_c), 4) + 0.0 END AS intercept,
       CASE WHEN tested THEN round(se, 4) END AS standard_error_ln, CASE WHEN tested THEN round(stat, 4) + 0.0 END AS statistic, CASE WHEN tested THEN round({_Z_P}, 4) + 0.0 END AS pvalue FROM s2"""

_LINES = "SELECT l_orderkey AS cell_id, l_linenumber AS gene_id, sum(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2"
_PAIR = f"a AS ({BASE_SQL['wilcoxon_dense']}), b AS ({BASE_SQL['welch_dense']})"

SQL: dict[str, str] = {
    "t_test": f"WITH {_T_TEST} SELECT * FROM res",
    "wilcoxon_test": f"WITH {_W_TEST} SELECT * FROM res",
    "wilcoxon_bonferroni": f"WITH {_W_TEST} SELECT lab, gene_id, round(least(p * n_p, 1e0), 5) + 0.0 AS pvalue_adj FROM adj",
    "volcano": f"""WITH {_T_TEST}, e AS (SELECT *, CASE WHEN shown THEN log2((exp(mean) - 1 + 1e-9) / (exp(mean_c) - 1 + 1e-9)) END AS fold FROM adj),
v AS (SELECT *, q < 0.05 AND abs(fold) >= 0.05 AS significant FROM e)
SELECT lab, gene_id, round(fold, 4) + 0.0 AS logfoldchange, round(-log10(greatest(least(q, 1.0), 1e-300)), 4) + 0.0 AS score, significant,
       CASE WHEN significant AND fold > 0 THEN 'up' WHEN significant THEN 'down' ELSE 'none' END AS direction FROM v""",
    "top_genes": f"WITH {_T_TEST} SELECT lab, gene_id, statistic FROM res WHERE lab = 'MACHINERY' AND statistic IS NOT NULL ORDER BY statistic DESC, gene_id LIMIT 7",
    "tidy_groups": f"WITH {_T_TEST} SELECT lab, gene_id, rank FROM res WHERE lab IN ('MACHINERY', 'FURNITURE') AND rank <= 3",
    "test_summary": f"""WITH {_T_TEST}, e AS (SELECT lab, p, coalesce(q < 0.5, false) AS sig, CASE WHEN shown THEN mean - mean_c END AS effect FROM adj)
SELECT lab, count(*) AS genes, count(p) AS tested, count(CASE WHEN sig THEN 1 END) AS significant, count(CASE WHEN sig AND effect > 0 THEN 1 END) AS up, count(CASE WHEN sig AND effect < 0 THEN 1 END) AS down FROM e GROUP BY lab""",
    "named_genes": f"""WITH w AS ({BASE_SQL['welch_sparse']}), i AS (SELECT lab, gene_id, row_number() OVER (PARTITION BY lab ORDER BY abs(statistic) DESC NULLS LAST, gene_id) AS rank FROM w)
SELECT i.lab, i.gene_id, i.rank, p_name AS gene FROM i LEFT JOIN part ON p_partkey = i.gene_id WHERE rank <= 4""",
    "auroc": f"""WITH {_PAIR}, j AS (SELECT a.lab, a.statistic, b.effect > 0 AS up FROM a JOIN b ON a.lab = b.lab AND a.gene_id = b.gene_id WHERE a.statistic IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY lab ORDER BY statistic) + (count(*) OVER (PARTITION BY lab, statistic) - 1) / 2e0 AS rk FROM j),
n AS (SELECT lab, sum(CASE WHEN up THEN rk END) AS s, count(CASE WHEN up THEN 1 END)::DOUBLE AS pos, count(CASE WHEN NOT up THEN 1 END)::DOUBLE AS neg FROM k GROUP BY lab)
SELECT lab, CASE WHEN pos * neg > 0 THEN round((s - pos * (pos + 1) / 2e0) / (pos * neg), 6) + 0.0 END AS auroc FROM n""",
    "top_overlap": f"""WITH {_PAIR}, i AS (SELECT lab, gene_id, row_number() OVER (PARTITION BY lab ORDER BY round(1 / (1 + statistic * statistic), 6) NULLS LAST, abs(effect) DESC NULLS LAST, gene_id) AS i FROM a),
j AS (SELECT lab, gene_id, row_number() OVER (PARTITION BY lab ORDER BY round(1 / (1 + statistic * statistic), 6) NULLS LAST, abs(effect) DESC NULLS LAST, gene_id) AS j FROM b),
k AS (SELECT i.lab, i.i, j.j, unnest([5, 10]) AS k FROM i JOIN j ON i.lab = j.lab AND i.gene_id = j.gene_id)
SELECT lab, CAST(k AS BIGINT) AS k, round(count(CASE WHEN i <= k AND j <= k THEN 1 END) / k::DOUBLE, 6) AS share FROM k GROUP BY lab, k""",
    "largest_difference": f"WITH {_PAIR} SELECT a.lab, round(max(abs(a.statistic - b.statistic)), 4) AS difference FROM a JOIN b ON a.lab = b.lab AND a.gene_id = b.gene_id GROUP BY a.lab",
    "correlation_summary": f"""SELECT round(avg(pearson), 4) + 0.0 AS mean_pearson, round(stddev_samp(pearson), 4) AS sd_pearson, round(avg(spearman), 4) + 0.0 AS mean_spearman, round(stddev_samp(spearman), 4) AS sd_spearman
FROM ({BASE_SQL['correlations']})""",
    "qc_thresholds": f"""WITH {_SPARSE},
l AS (SELECT quantile_cont(n, 0.1) AS v FROM (SELECT count(*)::DOUBLE AS n FROM obs GROUP BY lab)),
g AS (SELECT quantile_cont(n, 0.1) AS v FROM (SELECT count(x.cell_id)::DOUBLE AS n FROM var LEFT JOIN x ON var.gene_id = x.gene_id GROUP BY var.gene_id)),
c AS (SELECT quantile_cont(n, 0.5) AS v FROM (SELECT count(x.cell_id)::DOUBLE AS n FROM obs LEFT JOIN x ON obs.cell_id = x.cell_id GROUP BY obs.cell_id))
SELECT CAST(trunc(greatest(5, least(50, l.v))) AS INTEGER) AS min_cells_per_label, CAST(trunc(greatest(5, least(100, g.v))) AS INTEGER) AS min_cells_per_gene,
       CAST(trunc(greatest(5, least(50, floor(c.v / 10)))) AS INTEGER) AS min_genes FROM l, g, c""",
    "count_delta": f"WITH {_SPARSE}, n AS (SELECT gene_id, count(*) AS n FROM x JOIN obs ON x.cell_id = obs.cell_id WHERE lab = '1-URGENT' GROUP BY 1) SELECT var.gene_id, coalesce(n, 0) AS n_cells FROM var LEFT JOIN n ON var.gene_id = n.gene_id",
    "dense_rows": f"""WITH x AS ({_LINES}), c AS (SELECT DISTINCT cell_id FROM x), g AS (SELECT unnest(range(8)) AS gene_id)
SELECT c.cell_id, string_agg(CAST(coalesce(x.value, 0) AS BIGINT), ',' ORDER BY g.gene_id) AS row FROM c CROSS JOIN g LEFT JOIN x ON x.cell_id = c.cell_id AND x.gene_id = g.gene_id GROUP BY 1""",
    "sparse_rows": f"SELECT cell_id, CAST(gene_id AS BIGINT) AS gene_id, value FROM ({_LINES}) WHERE value <> 0",
    "gene_major": f"WITH {_DENSE} SELECT * FROM x",
    "cell_major": f"WITH {_DENSE} SELECT * FROM x",
    "block_sums": f"WITH {_DENSE} SELECT CAST(floor(cell_id / 256e0) AS BIGINT) AS block, count(*) AS n, sum(value) AS total FROM x GROUP BY 1",
    "sorted_places": "SELECT o_orderkey AS cell_id, o_orderpriority AS lab, row_number() OVER (ORDER BY o_orderpriority <> '5-LOW', o_orderpriority, o_orderkey) - 1 AS place FROM orders",
    "label_slice": f"WITH {_SPARSE} SELECT x.cell_id, gene_id, value FROM x JOIN obs ON x.cell_id = obs.cell_id WHERE lab = '2-HIGH'",
    "reloaded_result": f"SELECT lab, gene_id, statistic FROM ({BASE_SQL['welch_dense']})",
    "label_order": "WITH f AS (SELECT o_orderpriority AS lab, min(o_orderkey) AS first FROM orders GROUP BY 1) SELECT row_number() OVER (ORDER BY first) - 1 AS place, lab FROM f WHERE lab <> '5-LOW'",
    "mapped_genes": "SELECT p_partkey AS gene_id, CASE WHEN p_brand LIKE '%1' THEN 'S-' || p_brand ELSE p_brand END AS gene FROM part",
    "standard_labels": "SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'control' ELSE o_orderpriority END AS perturbation, count(*) AS n FROM orders GROUP BY 1",
    "given_factors": """WITH g AS (SELECT c_custkey AS cell_id, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) END AS m FROM customer),
b AS (SELECT cell_id, coalesce(m, (SELECT median(m) FROM g), 1e0) AS m FROM g), k AS (SELECT exp(avg(ln(m))) AS scale FROM b)
SELECT cell_id, round(m / scale, 6) AS size_factor FROM b CROSS JOIN k""",
    "pair_factors": f"""WITH {_DENSE},
c AS (SELECT l.lab, o.cell_id FROM (SELECT DISTINCT lab FROM obs CROSS JOIN ctrl WHERE lab <> ctrl) l JOIN obs o ON o.lab = l.lab OR o.lab = (SELECT ctrl FROM ctrl)),
own AS (SELECT c.lab, x.* FROM c JOIN x ON c.cell_id = x.cell_id), n AS (SELECT lab, count(*) AS n FROM c GROUP BY 1),
geo AS (SELECT own.lab, gene_id, count(*) = any_value(n) AS whole, exp(avg(ln(value))) AS geo FROM own JOIN n ON own.lab = n.lab GROUP BY 1, 2),
w AS (SELECT lab, count(CASE WHEN whole THEN 1 END) AS k FROM geo GROUP BY 1),
use AS (SELECT geo.* FROM geo JOIN w ON geo.lab = w.lab WHERE whole OR k < 5),
r AS (SELECT own.lab, cell_id, median(value / geo) AS m FROM own JOIN use ON own.lab = use.lab AND own.gene_id = use.gene_id GROUP BY 1, 2),
f AS (SELECT lab, median(m) AS fill FROM r GROUP BY 1),
b AS (SELECT c.lab, c.cell_id, coalesce(m, fill, 1e0) AS m FROM c LEFT JOIN r ON c.lab = r.lab AND c.cell_id = r.cell_id LEFT JOIN f ON c.lab = f.lab),
k AS (SELECT lab, exp(avg(ln(m))) AS scale FROM b GROUP BY 1)
SELECT b.lab, cell_id, round(m / scale, 6) AS size_factor FROM b JOIN k ON b.lab = k.lab""",
    "nb_known_dispersion": f"WITH {_CLOSED}",
    "nb_frozen_control": f"WITH {_CLOSED}",
    "nb_pair_moments": f"""WITH {_DENSE}, {_stats("x", "value")},
tot AS (SELECT lab, gene_id, sum(value) AS total FROM x JOIN obs ON x.cell_id = obs.cell_id GROUP BY 1, 2),
one AS (SELECT n.lab, n.n, var.gene_id, coalesce(s1, 0) / n AS m, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM n CROSS JOIN var LEFT JOIN sums ON n.lab = sums.lab AND var.gene_id = sums.gene_id),
e AS (SELECT lab, gene_id, n, s1, greatest(m, 0.5) AS m, (s2 - 2 * greatest(m, 0.5) * s1 + n * greatest(m, 0.5) * greatest(m, 0.5) - s1) / (greatest(m, 0.5) * greatest(m, 0.5)) AS t FROM one)
SELECT p.lab, p.gene_id, CASE WHEN NOT d.low AND p.s1 + c.s1 >= 1 THEN round(greatest(1e-8, least(10e0, (p.t + c.t) / (p.n + c.n - 2))), 4) END AS dispersion_raw
FROM e p JOIN d ON p.lab = d.lab AND p.gene_id = d.gene_id CROSS JOIN ctrl JOIN e c ON c.lab = ctrl.ctrl AND c.gene_id = p.gene_id""",
    "streaming_sums": f"WITH {_DENSE} SELECT lab, gene_id, sum(value) AS s1, sum(value * value) AS s2, count(*) AS nnz FROM x JOIN obs ON x.cell_id = obs.cell_id GROUP BY 1, 2",
}
SQL["nb_gene_moments"] = f"""WITH sf AS ({BASE_SQL['sparse_size_factors'].replace(_SPARSE, _DENSE).replace('round(m / scale, 6)', 'm / scale')}), {_DENSE},
t AS (SELECT sum(size_factor) AS total, count(*) AS n FROM sf), rate AS (SELECT gene_id, sum(value) / any_value(total) AS rate FROM x CROSS JOIN t GROUP BY 1),
m AS (SELECT x.gene_id, any_value(rate) AS base_mean, count(*) AS k, sum(((value - size_factor * rate) ** 2 - value) / ((size_factor * rate) ** 2)) AS s
      FROM x JOIN sf ON x.cell_id = sf.cell_id JOIN rate ON x.gene_id = rate.gene_id GROUP BY 1)
SELECT gene_id, round(base_mean, 5) AS base_mean, round(greatest(1e-8, least(10e0, (s + n - k) / (n - 1))), 5) AS dispersion_raw FROM m CROSS JOIN t"""
