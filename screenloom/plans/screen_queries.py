"""Registered queries of the screen operators over the driver's tables, and the same in SQL.

Bindings: sparse counts are order x part quantities labelled by order priority; dense ones customer x brand quantities
labelled by market segment; points are the embedding vectors; sets come from documents and parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import differential, dimred, frames, nbglm, qc, size_factors
from ..operators.groupstats import library_sizes, normalise
from ..operators.multitest import adjust
from ..sources import store

Tables = tuple[DataFrame, DataFrame, DataFrame, str, str]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sparse(spark: SparkSession, d: str) -> Tables:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))
    obs = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("lab"))
    return lines.where("value <> 0"), obs, table(spark, d, "part").select(F.col("p_partkey").alias("gene_id")), "lab", "5-LOW"


def dense(spark: SparkSession, d: str) -> Tables:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cell_id"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("gene_id"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("double").alias("value"))
    x = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(part, lines.l_partkey == part.p_partkey).groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value"))
    obs = table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("lab"))
    return x.where("value <> 0"), obs, part.select("gene_id").distinct(), "lab", "BUILDING"


def r(c: str | Column, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


def qc_tables(spark: SparkSession, d: str) -> qc.QualityControl:
    x, obs, var, lab, ctrl = sparse(spark, d)
    return qc.quality_control(x, obs, var, lab, ctrl, min_genes=3, min_cells_per_label=50, min_cells_per_gene=5)


def _welch(spark: SparkSession, d: str, bind: Callable) -> DataFrame:
    x, obs, var, lab, ctrl = bind(spark, d)
    out = differential.welch_statistics(normalise(x), obs, var, lab, ctrl)
    return rounded(out.select("lab", "gene_id", "effect", "statistic", "df", "pts", "pts_rest", "tested"), "effect", "statistic", "df", "pts", "pts_rest", digits=5)


def _wilcoxon(spark: SparkSession, d: str, bind: Callable) -> DataFrame:
    out = differential.wilcoxon_statistics(*bind(spark, d))
    return rounded(out.select("lab", "gene_id", "u_stat", "statistic", "effect", "tested"), "u_stat", "statistic", "effect")


def wilcoxon_by_gene(spark: SparkSession, d: str) -> DataFrame:
    out = differential.wilcoxon_statistics(*dense(spark, d), by_gene=True, min_pct_ctrl=0, min_pct_pert=0, min_mean_ctrl=0, min_mean_pert=0)
    return rounded(out.select("lab", "gene_id", "u_stat", "statistic"), "u_stat", "statistic")


def bh_adjustment(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted values of pseudo p-values 1 / (1 + z * z) of the sparse Wilcoxon statistics, in SQL's reach."""
    w = _wilcoxon(spark, d, dense).withColumn("pvalue", F.when(F.col("tested"), 1 / (1 + F.col("statistic") * F.col("statistic"))))
    both = adjust(adjust(w, out="bh"), "bonferroni", out="bonferroni")
    return rounded(both.select("lab", "gene_id", "bh", "bonferroni"), "bh", "bonferroni")


def ranked_genes(spark: SparkSession, d: str) -> DataFrame:
    out = frames.tidy(differential.ranked(_wilcoxon(spark, d, dense)), None, 5)
    return out.select("lab", "gene_id", "statistic", F.col("rank").cast("long").alias("rank"))


def _bulk(spark: SparkSession, d: str, f: Callable) -> DataFrame:
    return rounded(f(*sparse(spark, d)), "perturbation_mean", "control_mean", "effect")


def normalised(spark: SparkSession, d: str) -> DataFrame:
    return rounded(normalise(sparse(spark, d)[0]), "value")


def libraries(spark: SparkSession, d: str) -> DataFrame:
    x, obs, *_ = sparse(spark, d)
    return library_sizes(x, obs)


def sparse_factors(spark: SparkSession, d: str) -> DataFrame:
    x, obs, *_ = sparse(spark, d)
    return rounded(size_factors.sparse_size_factors(x, obs), "size_factor")


def deseq_factors(spark: SparkSession, d: str) -> DataFrame:
    x, obs, *_ = dense(spark, d)
    x = store.written(x, "counts")
    have = x.select("cell_id").distinct()
    return rounded(size_factors.deseq_size_factors(x, obs.join(have, "cell_id", "left_semi"), 1), "size_factor")


def nb_glm(spark: SparkSession, d: str) -> DataFrame:
    return nbglm.nb_glm_test(*dense(spark, d))


def nb_shrunk(spark: SparkSession, d: str) -> DataFrame:
    return nbglm.shrink_lfc(nbglm.nb_glm_test(*dense(spark, d)))


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "documents").select(F.col("source").alias("name"), F.col("lang").alias("element"))
    return rounded(frames.overlap(sets), "jaccard")


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))


def knn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dimred.neighbours(points(spark, d), 10).select("src", "dst", "distance"), "distance", digits=5)


def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dimred.connectivities(dimred.neighbours(points(spark, d), 10)), "weight", digits=5)


def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dimred.gram(dense(spark, d)[0]), "s")


def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    x, obs, var, *_ = dense(spark, d)
    return dimred.pca(normalise(x), obs, var, 5).scores


def ma_frame(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frames.ma(*dense(spark, d)), "a", "m")


def label_sizes(spark: SparkSession, d: str) -> DataFrame:
    _, obs, _, lab, _ = sparse(spark, d)
    return frames.label_counts(obs, lab)


def gene_histogram(spark: SparkSession, d: str) -> DataFrame:
    x, obs, *_ = sparse(spark, d)
    return rounded(frames.qc_histogram(x, obs), "low")


def cleaned_labels(spark: SparkSession, d: str) -> DataFrame:
    c = labels.clean_label(F.col("p_name"), ("Part", "part"), (), r"\s*\d+$", ("", "#"), "NTC")
    return table(spark, d, "part").select("p_partkey", c.alias("cleaned"), labels.clean_gene(F.concat(F.lit("mt-"), F.col("p_brand"), F.lit(".12"))).alias("gene"))


def inferred_control(spark: SparkSession, d: str) -> DataFrame:
    """The control among market segments named after the data: "non-target" with the last segment, guides in a known column."""
    c = table(spark, d, "customer")
    named = F.when(F.col("c_mktsegment") == F.lit("MACHINERY"), F.concat(F.lit("Non-Target_"), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    obs = c.select(F.col("c_custkey").alias("cell_id"), F.col("c_name").alias("name"), named.alias("guide"))
    return spark.createDataFrame([(labels.control_label(obs, "guide"), labels.detect_label_column(obs))], "control string, label_column string")


def sorted_bounds(spark: SparkSession, d: str) -> DataFrame:
    _, obs, _, lab, ctrl = sparse(spark, d)
    return store.sorted_cells(obs, lab, ctrl)[1]


def label_contiguity(spark: SparkSession, d: str) -> DataFrame:
    _, obs, _, lab, _ = sparse(spark, d)
    return spark.createDataFrame([(round(store.contiguity(obs, lab), 6),)], "contiguity double")


def correlated(spark: SparkSession, d: str) -> DataFrame:
    a, b = _wilcoxon(spark, d, dense), _welch(spark, d, dense)
    return rounded(frames.correlations(a, b), "pearson", "spearman", digits=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "welch_sparse": lambda s, d: _welch(s, d, sparse),
    "welch_dense": lambda s, d: _welch(s, d, dense),
    "wilcoxon_sparse": lambda s, d: _wilcoxon(s, d, sparse),
    "wilcoxon_dense": lambda s, d: _wilcoxon(s, d, dense),
    "wilcoxon_by_gene": wilcoxon_by_gene,
    "bh_adjustment": bh_adjustment,
    "ranked_genes": ranked_genes,
    "average_log_expression": lambda s, d: _bulk(s, d, differential.average_log_expression),
    "pseudobulk": lambda s, d: _bulk(s, d, differential.pseudobulk),
    "normalised": normalised,
    "library_sizes": libraries,
    "qc_cells": lambda s, d: qc_tables(s, d).cells,
    "qc_genes": lambda s, d: qc_tables(s, d).genes,
    "qc_filtered": lambda s, d: qc_tables(s, d).x,
    "sparse_size_factors": sparse_factors,
    "deseq_size_factors": deseq_factors,
    "nb_glm": nb_glm,
    "nb_shrunk": nb_shrunk,
    "overlap": overlaps,
    "knn": knn,
    "knn_graph": knn_graph,
    "gram": gram_matrix,
    "pca_scores": pca_scores,
    "ma_frame": ma_frame,
    "label_counts": label_sizes,
    "gene_histogram": gene_histogram,
    "cleaned_labels": cleaned_labels,
    "inferred_control": inferred_control,
    "sorted_bounds": sorted_bounds,
    "label_contiguity": label_contiguity,
    "correlations": correlated,
}

_SPARSE = """
x AS (SELECT l_orderkey AS cell_id, l_partkey AS gene_id, sum(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0),
obs AS (SELECT o_orderkey AS cell_id, o_orderpriority AS lab FROM orders),
var AS (SELECT p_partkey AS gene_id FROM part),
ctrl AS (SELECT '5-LOW' AS ctrl)"""
_DENSE = """
x AS (SELECT o_custkey AS cell_id, p_brand AS gene_id, sum(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING sum(l_quantity) <> 0),
obs AS (SELECT c_custkey AS cell_id, c_mktsegment AS lab FROM customer),
var AS (SELECT DISTINCT p_brand AS gene_id FROM part),
ctrl AS (SELECT 'BUILDING' AS ctrl)"""
_NORM = """
lib AS (SELECT cell_id, sum(value) AS library FROM x GROUP BY 1),
xn AS (SELECT x.cell_id, gene_id, value * 1e4 / library AS raw, ln(1.0 + value * 1e4 / library) AS value FROM x JOIN lib ON x.cell_id = lib.cell_id)"""


def _stats(source: str, value: str) -> str:
    return f"""
n AS (SELECT lab, CAST(count(*) AS DOUBLE) AS n FROM obs GROUP BY lab),
sums AS (SELECT lab, gene_id, sum({value}) AS s1, sum({value} * {value}) AS s2, count(*) AS nnz FROM {source} JOIN obs ON {source}.cell_id = obs.cell_id GROUP BY 1, 2),
st AS (SELECT n.lab, n.n, var.gene_id, coalesce(s1, 0.0) / n AS mean, CASE WHEN n > 1 THEN greatest((coalesce(s2, 0.0) - coalesce(s1, 0.0) * coalesce(s1, 0.0) / n) / (n - 1), 0.0) ELSE 0.0 END AS v,
       coalesce(nnz, 0) AS nnz, coalesce(nnz, 0) / n AS pct FROM n CROSS JOIN var LEFT JOIN sums ON n.lab = sums.lab AND var.gene_id = sums.gene_id),
d AS (SELECT p.lab, p.gene_id, p.n, p.mean, p.v, p.nnz, p.pct, c.n AS n_c, c.mean AS mean_c, c.v AS v_c, c.nnz AS nnz_c, c.pct AS pct_c,
             (c.pct < 0.01 AND c.mean < 0.05 AND p.pct < 0.002 AND p.mean < 0.005) AS low
      FROM st p JOIN st c ON p.gene_id = c.gene_id CROSS JOIN ctrl WHERE c.lab = ctrl.ctrl AND p.lab <> ctrl.ctrl)"""


def _welch_sql(bind: str) -> str:
    return f"""WITH {bind}, {_NORM}, {_stats("xn", "value")},
w AS (SELECT *, v / n AS a, v_c / n_c AS b, sqrt(v / n + v_c / n_c) AS se FROM d),
k AS (SELECT *, se > 0 AND NOT low AS tested, (CASE WHEN n > 1 THEN a * a / (n - 1) ELSE 0 END) + (CASE WHEN n_c > 1 THEN b * b / (n_c - 1) ELSE 0 END) AS den FROM w)
SELECT lab, gene_id, CASE WHEN NOT low THEN round(mean - mean_c, 5) + 0.0 END AS effect,
       CASE WHEN tested THEN round((mean - mean_c) / se, 5) + 0.0 END AS statistic,
       CASE WHEN tested THEN round(greatest(CASE WHEN den = 0 THEN 1e6 ELSE (a + b) * (a + b) / den END, 1.0), 5) END AS df,
       round(pct, 5) AS pts, round(pct_c, 5) AS pts_rest, tested FROM k"""


def _wilcoxon_parts(bind: str) -> str:
    return f"""{bind}, {_stats("x", "value")},
h AS (SELECT gene_id, lab, value, CAST(count(*) AS DOUBLE) AS k FROM x JOIN obs ON x.cell_id = obs.cell_id GROUP BY 1, 2, 3),
u AS (SELECT d.lab, d.gene_id, value, k AS kc, 0.0 AS kp FROM h JOIN d ON h.gene_id = d.gene_id CROSS JOIN ctrl WHERE h.lab = ctrl.ctrl
      UNION ALL SELECT lab, gene_id, value, 0.0, k FROM h CROSS JOIN ctrl WHERE lab <> ctrl.ctrl
      UNION ALL SELECT lab, gene_id, 0.0, n_c - nnz_c, n - nnz FROM d),
t AS (SELECT lab, gene_id, value, sum(kc)::DOUBLE AS kc, sum(kp)::DOUBLE AS kp FROM u GROUP BY 1, 2, 3),
cum AS (SELECT *, kc + kp AS k, sum(kc + kp) OVER (PARTITION BY lab, gene_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto FROM t),
rk AS (SELECT lab, gene_id, sum(kp * (upto - k + (k + 1) / 2.0)) AS r, sum(k * k * k - k) AS ties FROM cum GROUP BY 1, 2),
z AS (SELECT d.lab, d.gene_id, NOT d.low AS tested, r - n * (n + 1) / 2.0 AS u, n, n_c,
             (r - n * (n + n_c + 1) / 2.0) AS num, sqrt((1 - ties / ((n + n_c) * (n + n_c) * (n + n_c) - (n + n_c))) * n * n_c * (n + n_c + 1) / 12.0) AS sd
      FROM d JOIN rk ON d.lab = rk.lab AND d.gene_id = rk.gene_id),
wx AS (SELECT lab, gene_id, CASE WHEN tested THEN round(u, 6) + 0.0 END AS u_stat, CASE WHEN tested THEN round(CASE WHEN sd = 0 THEN 0.0 ELSE num / sd END, 6) + 0.0 END AS statistic,
             CASE WHEN tested THEN round(u / (n * n_c) - 0.5, 6) + 0.0 END AS effect, tested FROM z)"""


def _bulk_sql(value: str, mean: str) -> str:
    return f"""WITH {_SPARSE}, {_NORM}, {_stats("xn", value)}
SELECT lab, gene_id, round({mean.format("mean")}, 6) AS perturbation_mean, round({mean.format("mean_c")}, 6) AS control_mean, round({mean.format("mean")} - {mean.format("mean_c")}, 6) + 0.0 AS effect FROM d"""


_QC = f"""WITH {_SPARSE},
g AS (SELECT obs.cell_id, lab, count(x.cell_id) AS n_genes FROM obs LEFT JOIN x ON obs.cell_id = x.cell_id GROUP BY 1, 2),
big AS (SELECT lab FROM g WHERE n_genes >= 3 GROUP BY lab HAVING count(*) >= 50),
cells AS (SELECT cell_id, lab, n_genes, n_genes >= 3 AND (lab = '5-LOW' OR lab IN (SELECT lab FROM big)) AS keep FROM g),
cnt AS (SELECT gene_id, count(*) AS n_cells FROM x JOIN cells ON x.cell_id = cells.cell_id WHERE keep GROUP BY 1),
genes AS (SELECT var.gene_id, coalesce(n_cells, 0) AS n_cells, coalesce(n_cells, 0) >= 5 AS keep FROM var LEFT JOIN cnt ON var.gene_id = cnt.gene_id)"""
_FACTORS = """
r AS (SELECT cell_id, median(value / geo) AS m FROM x JOIN geo ON x.gene_id = geo.gene_id GROUP BY 1),
f AS (SELECT median(m) AS fill FROM r),
b AS (SELECT o.cell_id, coalesce(m, fill, 1.0) AS m FROM o LEFT JOIN r ON o.cell_id = r.cell_id CROSS JOIN f),
k AS (SELECT exp(avg(ln(m))) AS scale FROM b)
SELECT cell_id, round(m / scale, 6) AS size_factor FROM b CROSS JOIN k"""
_KNN = """WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))) AS distance
           FROM embeddings a CROSS JOIN embeddings b),
e AS (SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY src <> dst, distance, dst) AS nth FROM p),
knn AS (SELECT src, dst, distance FROM e WHERE nth <= 10)"""

SQL: dict[str, str] = {
    "welch_sparse": _welch_sql(_SPARSE),
    "welch_dense": _welch_sql(_DENSE),
    "wilcoxon_sparse": f"WITH {_wilcoxon_parts(_SPARSE)} SELECT * FROM wx",
    "wilcoxon_dense": f"WITH {_wilcoxon_parts(_DENSE)} SELECT * FROM wx",
    "wilcoxon_by_gene": f"WITH {_wilcoxon_parts(_DENSE)} SELECT lab, gene_id, round(u, 6) + 0.0 AS u_stat, round(CASE WHEN sd = 0 THEN 0.0 ELSE num / sd END, 6) + 0.0 AS statistic FROM z",
    "bh_adjustment": f"""WITH {_wilcoxon_parts(_DENSE)},
p AS (SELECT lab, gene_id, CASE WHEN tested THEN 1 / (1 + statistic * statistic) END AS p FROM wx),
i AS (SELECT *, count(p) OVER (PARTITION BY lab) AS n, row_number() OVER (PARTITION BY lab ORDER BY p NULLS LAST, gene_id) AS i FROM p)
SELECT lab, gene_id, round(CASE WHEN p IS NOT NULL THEN least(min(p * n / i) OVER (PARTITION BY lab ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) END, 6) AS bh, round(least(p * n, 1.0), 6) AS bonferroni FROM i""",
    "ranked_genes": f"""WITH {_wilcoxon_parts(_DENSE)},
i AS (SELECT lab, gene_id, statistic, row_number() OVER (PARTITION BY lab ORDER BY abs(statistic) DESC NULLS LAST, gene_id) AS rank FROM wx)
SELECT * FROM i WHERE rank <= 5""",
    "average_log_expression": _bulk_sql("value", "{}"),
    "pseudobulk": _bulk_sql("raw", "ln(1 + {})"),
    "normalised": f"WITH {_SPARSE}, {_NORM} SELECT cell_id, gene_id, round(value, 6) AS value FROM xn",
    "library_sizes": f"WITH {_SPARSE} SELECT obs.cell_id, coalesce(sum(value), 0.0) AS library, count(x.cell_id) AS n_genes FROM obs LEFT JOIN x ON obs.cell_id = x.cell_id GROUP BY 1",
    "qc_cells": f"{_QC} SELECT cell_id, lab, n_genes, keep FROM cells",
    "qc_genes": f"{_QC} SELECT * FROM genes",
    "qc_filtered": f"{_QC} SELECT x.cell_id, x.gene_id, x.value FROM x JOIN cells ON x.cell_id = cells.cell_id JOIN genes ON x.gene_id = genes.gene_id WHERE cells.keep AND genes.keep",
    "sparse_size_factors": f"WITH {_SPARSE}, o AS (SELECT cell_id FROM obs), geo AS (SELECT gene_id, exp(avg(ln(value))) AS geo FROM x GROUP BY 1), {_FACTORS}",
    "deseq_size_factors": f"""WITH {_DENSE}, o AS (SELECT DISTINCT cell_id FROM x),
whole AS (SELECT gene_id, exp(avg(ln(value))) AS geo FROM x GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM o)),
geo AS (SELECT * FROM whole UNION ALL SELECT gene_id, exp(avg(ln(value))) FROM x WHERE (SELECT count(*) FROM whole) = 0 GROUP BY 1), {_FACTORS}""",
    "overlap": """WITH s AS (SELECT DISTINCT source AS name, lang AS element FROM documents), n AS (SELECT name, count(element) AS n FROM s GROUP BY 1),
c AS (SELECT p.name AS a, q.name AS b, count(*) AS n_common FROM s p JOIN s q ON p.element = q.element GROUP BY 1, 2)
SELECT p.name AS a, q.name AS b, coalesce(n_common, 0) AS n_common, p.n AS n_a, q.n AS n_b, round(coalesce(n_common, 0) / (p.n + q.n - coalesce(n_common, 0))::DOUBLE, 6) AS jaccard
FROM n p CROSS JOIN n q LEFT JOIN c ON c.a = p.name AND c.b = q.name""",
    "knn": f"{_KNN} SELECT src, dst, round(distance, 5) + 0.0 AS distance FROM knn",
    "knn_graph": f"""{_KNN}, s AS (SELECT avg(far) AS sigma FROM (SELECT max(distance) AS far FROM knn GROUP BY src)),
w AS (SELECT src, dst, exp(-greatest(distance, 1e-10) / greatest(sigma, 1e-10)) AS w FROM knn CROSS JOIN s)
SELECT src, dst, round(sum(w) / 2, 5) AS weight FROM (SELECT * FROM w UNION ALL SELECT dst, src, w FROM w) GROUP BY 1, 2""",
    "gram": f"WITH {_DENSE} SELECT a.gene_id AS g1, b.gene_id AS g2, round(sum(a.value * b.value), 6) AS s FROM x a JOIN x b ON a.cell_id = b.cell_id WHERE a.gene_id <= b.gene_id GROUP BY 1, 2",
    "ma_frame": f"WITH {_DENSE}, {_stats('x', 'value')} SELECT lab, gene_id, round(ln(1 + (mean + mean_c) / 2), 6) AS a, round(ln(1 + mean) - ln(1 + mean_c), 6) + 0.0 AS m FROM d",
    "label_counts": "SELECT o_orderpriority AS lab, count(*) AS n FROM orders GROUP BY 1",
    "gene_histogram": f"""WITH {_SPARSE}, l AS (SELECT CAST(count(x.cell_id) AS DOUBLE) AS v FROM obs LEFT JOIN x ON obs.cell_id = x.cell_id GROUP BY obs.cell_id),
e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 50 AS w FROM l), b AS (SELECT CASE WHEN w = 0 THEN 0 ELSE CAST(least(floor((v - lo) / w), 49) AS INTEGER) END AS bin, lo, w FROM l CROSS JOIN e)
SELECT CAST(bin AS INTEGER) AS bin, round(max(lo + bin * w), 6) AS low, count(*) AS n FROM b GROUP BY 1""",
    "cleaned_labels": r"""WITH c AS (SELECT p_partkey, p_brand, regexp_replace(regexp_replace(regexp_replace(p_name, '^Part', ''), '^part', ''), '\s*\d+$', '') AS c FROM part)
SELECT p_partkey, CASE WHEN lower(c) IN ('', '#') THEN 'NTC' ELSE c END AS cleaned, 'MT-' || p_brand AS gene FROM c""",
    "inferred_control": """WITH o AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Non-Target_' || c_mktsegment ELSE c_mktsegment END AS guide FROM customer)
SELECT (SELECT arg_min(guide, c_custkey) FROM o WHERE contains(lower(guide), 'non-target') OR contains(lower(guide), 'nontarget')) AS control,
       CASE WHEN count(DISTINCT guide) BETWEEN 2 AND 5000 THEN 'guide' END AS label_column FROM o""",
    "sorted_bounds": """WITH n AS (SELECT o_orderpriority AS lab, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT lab, n, sum(n) OVER (ORDER BY lab <> '5-LOW', lab ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM n)
SELECT lab, e - n AS start, e AS "end" FROM c""",
    "label_contiguity": "SELECT round(avg(c), 6) AS contiguity FROM (SELECT count(*) / (max(o_orderkey) - min(o_orderkey) + 1)::DOUBLE AS c FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 20)",
}
SQL["correlations"] = f"""WITH a AS ({SQL["wilcoxon_dense"]}), b AS ({SQL["welch_dense"]}),
p AS (SELECT a.lab, a.gene_id, a.statistic AS x, b.statistic AS y FROM a JOIN b ON a.lab = b.lab AND a.gene_id = b.gene_id WHERE a.statistic IS NOT NULL AND b.statistic IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY lab ORDER BY x) + (count(*) OVER (PARTITION BY lab, x) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY lab ORDER BY y) + (count(*) OVER (PARTITION BY lab, y) - 1) / 2.0::DOUBLE AS ry FROM p)
SELECT lab, count(*) AS n, round(corr(x, y), 5) + 0.0 AS pearson, round(corr(rx, ry), 5) + 0.0 AS spearman FROM k GROUP BY lab"""
