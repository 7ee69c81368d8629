"""Screen operators on literal fixtures, against closed forms and the SQL of the registered queries."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom import Screen
from screenloom.functions import labels, special
from screenloom.operators import differential, dimred, frames, nbglm, qc, size_factors
from screenloom.operators.groupstats import normalise
from screenloom.plans import result_queries, screen_queries
from screenloom.sources import store

F1 = [[1, 0, 3, 0], [0, 2, 1, 0], [4, 0, 0, 1], [3, 1, 0, 0], [0, 0, 2, 2], [1, 0, 1, 3]]
LABELS = ["ctrl", "ctrl", "A", "A", "B", "B"]
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def screen(spark):
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(F1)], "cell_id long, values array<double>")
    obs = spark.createDataFrame([(i, v) for i, v in enumerate(LABELS)], "cell_id long, perturbation string")
    var = spark.createDataFrame([(i, f"G{i + 1}") for i in range(4)], "gene_id int, gene_name string")
    return Screen.from_dense(rows, obs, var)


def test_pseudobulk_effects_match_numpy(screen):
    y = np.array(F1) / np.array(F1).sum(axis=1, keepdims=True) * 1e4
    got = {(r["lab"], r["gene_id"]): r["effect"] for r in screen.pb.average_log_expression("perturbation").collect()}
    bulk = {(r["lab"], r["gene_id"]): r["effect"] for r in screen.pb.pseudobulk("perturbation").collect()}
    for lab, at in (("A", [2, 3]), ("B", [4, 5])):
        for g in range(4):
            assert got[lab, g] == pytest.approx(np.log1p(y)[at, g].mean() - np.log1p(y)[:2, g].mean())
            assert bulk[lab, g] == pytest.approx(math.log1p(y[at, g].mean()) - math.log1p(y[:2, g].mean()))


def test_qc_counts_genes_over_kept_cells(screen):
    q = qc.quality_control(screen.x, screen.obs, screen.var, "perturbation", "ctrl", 2, 2, 2)
    keep = [sum(v > 0 for v in r) >= 2 for r in F1]
    assert {r["gene_id"]: r["n_cells"] for r in q.genes.collect()} == {g: sum(k and r[g] > 0 for r, k in zip(F1, keep)) for g in range(4)}


def test_t_test_refuses_counts_and_wilcoxon_forms_agree(screen):
    with pytest.raises(ValueError):
        differential.t_test(screen.x, screen.obs, screen.var, "perturbation", "ctrl")
    a = differential.wilcoxon_statistics(screen.x, screen.obs, screen.var, "perturbation", "ctrl", min_pct_ctrl=0, min_pct_pert=0, min_mean_ctrl=0, min_mean_pert=0)
    b = differential.wilcoxon_statistics(screen.x, screen.obs, screen.var, "perturbation", "ctrl", by_gene=True, min_pct_ctrl=0, min_pct_pert=0, min_mean_ctrl=0, min_mean_pert=0)
    left = {(r["lab"], r["gene_id"]): (r["u_stat"], r["statistic"]) for r in a.collect()}
    assert left == {(r["lab"], r["gene_id"]): (r["u_stat"], pytest.approx(r["statistic"])) for r in b.collect()}
    for (lab, g), (u, _) in left.items():
        p, c = ([F1[i][g] for i, v in enumerate(LABELS) if v == name] for name in (lab, "ctrl"))
        assert u == sum((x > y) + 0.5 * (x == y) for x in p for y in c)


def test_results_do_not_depend_on_partitions(screen):
    rows = [sorted(map(tuple, differential.welch_statistics(normalise(screen.x).repartition(n), screen.obs.repartition(n), screen.var, "perturbation", "ctrl").select("lab", "gene_id", F.round("effect", 9)).collect())) for n in (1, 7)]
    assert rows[0] == rows[1]


def test_namespace_rules(screen):
    with pytest.raises(ValueError):
        screen.tl.rank_genes_groups("perturbation", method="wilcoxon")
    counts, screen = screen, screen.pp.normalize_total_log1p()
    out = screen.tl.rank_genes_groups("perturbation", method="Wilcox_Test").collect()
    assert {r["lab"] for r in out} == {"A", "B"}
    for bad, kind in (({"method": "wald"}, ValueError), ({"groupby": "perturbation"}, TypeError), ({"perturbations": ["none"]}, ValueError)):
        with pytest.raises(kind):
            screen.tl.rank_genes_groups("perturbation", **bad)
    with pytest.raises(KeyError):
        frames.tidy(differential.wilcoxon_test(screen.x, screen.obs, screen.var, "perturbation", "ctrl"), "missing")


def test_labels(spark, screen):
    assert labels.control_label(screen.obs, "perturbation") == "ctrl"
    ntc = spark.createDataFrame([(0, "KO1"), (1, "NTC")], "cell_id long, lab string")
    assert labels.control_label(ntc, "lab") == "NTC"
    with pytest.raises(ValueError):
        labels.control_label(ntc.where("lab = 'KO1'"), "lab")
    assert labels.infer_columns(screen.obs, screen.var) == {"perturbation_column": "perturbation", "gene_name_column": "gene_name"}
    fly = spark.createDataFrame([(0, "FBgn0001"), (1, "FBgn0002")], "gene_id int, gene_name string")
    with pytest.raises(ValueError):
        labels.gene_names(fly)


def test_special_functions():
    assert special.t_two_sided(np.array([0.0, 2.0]), np.array([5.0, 10.0])) == pytest.approx([1.0, 0.07338803477], rel=1e-8)
    assert special.t_two_sided(np.array([1.0]), np.array([1.0])) == pytest.approx([0.5])
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert special.f_quantile(0.5, 2, 2) == pytest.approx(1.0)


def test_nb_glm_finds_a_shift(spark):
    rng = np.random.default_rng(1)
    y = rng.poisson(rng.gamma(5, 4, (120, 6)))
    y[60:, 0] = rng.poisson(rng.gamma(5, 12, 60))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "cell_id long, values array<double>")
    obs = spark.createDataFrame([(i, "ctrl" if i < 60 else "KO") for i in range(120)], "cell_id long, lab string")
    var = spark.createDataFrame([(i,) for i in range(6)], "gene_id int")
    ones = obs.select("cell_id", F.lit(1.0).alias("size_factor"))
    x = store.from_dense(rows)
    out = nbglm.nb_glm_test(x, obs, var, "lab", "ctrl", size_factors=ones)
    got = {r["gene_id"]: r for r in out.collect()}
    assert got[0]["logfoldchange"] == pytest.approx(math.log2(y[60:, 0].mean() / y[:60, 0].mean()), rel=1e-3)
    assert got[0]["pvalue"] < 1e-6 < min(got[g]["pvalue"] for g in range(1, 6)) and got[0]["rank"] == 1
    shrunk = {r["gene_id"]: r["logfoldchange"] for r in nbglm.shrink_lfc(out).collect()}
    full = {r["gene_id"]: r["logfoldchange"] for r in nbglm.shrink_lfc(out, "full", x=x, obs=obs, label="lab", control="ctrl", size_factors=ones).collect()}
    for g in range(6):
        assert abs(shrunk[g]) <= abs(got[g]["logfoldchange"]) + 1e-9
        assert full[g] == pytest.approx(shrunk[g], abs=0.1)


def test_nb_glm_covariates_and_outlier_filter(spark):
    rng = np.random.default_rng(7)
    n = 200
    label = np.array(["ctrl"] * 100 + ["KO"] * 100)
    batch = np.array(["b1"] * 80 + ["b2"] * 20 + ["b1"] * 20 + ["b2"] * 80)
    depth = rng.normal(size=n)
    y = rng.poisson(rng.gamma(10, 4, (n, 5)))
    y[:, 0] = rng.poisson(rng.gamma(10, 4, n) * np.where(batch == "b2", 4, 1))
    y[:, 1] = rng.poisson(rng.gamma(10, 4, n) * np.where(label == "KO", 3, 1) * np.where(batch == "b2", 2, 1) * np.exp(depth / 2))
    y[150, 2] = 100_000
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "cell_id long, values array<double>")
    obs = spark.createDataFrame([(i, str(label[i]), str(batch[i]), float(depth[i])) for i in range(n)], "cell_id long, lab string, batch string, depth double")
    var = spark.createDataFrame([(i,) for i in range(5)], "gene_id int")
    ones = obs.select("cell_id", F.lit(1.0).alias("size_factor"))
    x = store.from_dense(rows)
    plain = {r["gene_id"]: r for r in nbglm.nb_glm_test(x, obs, var, "lab", "ctrl", size_factors=ones).collect()}
    held = {r["gene_id"]: r for r in nbglm.nb_glm_test(x, obs, var, "lab", "ctrl", size_factors=ones, covariates=("batch", "depth"), cook_filter=True).collect()}
    assert plain[0]["logfoldchange"] > 0.8 and plain[0]["pvalue"] < 1e-3
    assert abs(held[0]["logfoldchange"]) < 0.3 and held[0]["pvalue"] > 1e-3
    assert held[1]["logfoldchange"] == pytest.approx(math.log2(3), abs=0.25) and held[1]["pvalue"] < 1e-6
    assert plain[2]["pvalue"] is not None and held[2]["pvalue"] is None and not held[2]["converged"]
    assert all(held[g]["pvalue"] is not None for g in (3, 4))


def test_pca_matches_svd(spark):
    data = np.random.default_rng(42).normal(size=(50, 6)) * [10, 5, 1, 1, 1, 1]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)], "cell_id long, values array<double>")
    p = dimred.pca(store.from_dense(rows), rows.select("cell_id"), spark.createDataFrame([(i,) for i in range(6)], "gene_id int"), 2)
    s = np.linalg.svd(data - data.mean(axis=0), compute_uv=False)
    assert p.variance == pytest.approx((s**2 / 49)[:2])
    scores = np.array([r["vec"] for r in p.scores.orderBy("cell_id").collect()])
    assert scores.var(axis=0, ddof=1) == pytest.approx(p.variance)


def test_save_load_and_resume(spark, screen, tmp_path):
    path = str(tmp_path / "s")
    screen.save(path)
    assert Screen.load(spark, path).x.count() == screen.x.count()
    with pytest.raises(ValueError):
        screen.write_obs(path, screen.obs.limit(1))
    with pytest.raises(FileNotFoundError):
        Screen.load(spark, path + "-none")
    asked = []

    def compute(some):
        asked.append(some)
        return spark.createDataFrame([(c, 1) for c in some], "lab string, v int")

    out = str(tmp_path / "r")
    store.resumable(spark, out, ["A"], {"k": 1}, compute)
    assert store.resumable(spark, out, ["A", "B"], {"k": 1}, compute).count() == 2
    assert asked == [["A"], ["B"]]
    store.resumable(spark, out, ["A"], {"k": 2}, compute)
    assert asked[-1] == ["A"]
    assert store.result_path("a/b", "de", data_name="screenloom_x_de") == "a/screenloom_x_de"


QUERIES, SQL = screen_queries.QUERIES | result_queries.QUERIES, screen_queries.SQL | result_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "customer", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(SQL[name]).fetchdf()
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(str(tuple(None if v != v else v for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert key(got.toPandas()) == key(want)


def test_streamed_sums(spark, screen, tmp_path):
    from screenloom.streaming.sums import streamed_sums

    screen.x.write.parquet(str(tmp_path / "x"))
    stream = spark.readStream.schema(screen.x.schema).parquet(str(tmp_path / "x"))
    q = streamed_sums(stream, screen.obs, "perturbation").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["lab"], r["gene_id"]): r["s1"] for r in spark.table("sums").collect()}
    assert got["A", 0] == 7.0


def test_neighbours_of_many_equal_vectors(spark):
    rng = np.random.default_rng(3)
    vec = np.concatenate([np.repeat(rng.normal(size=(1, 6)), 70, axis=0), rng.normal(size=(130, 6))])
    ids = rng.permutation(200).tolist()
    points = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vec, strict=True)], "cell_id long, vec array<double>")
    got = {(r["src"], r["nth"]): r["dst"] for r in dimred.neighbours(points, 5).collect()}
    copies = sorted(ids[:70])
    assert len(got) == 1000 and all(got[i, 0] == i for i in ids)
    assert all([got[i, n] for n in range(1, 5)] == [j for j in copies if j != i][:4] for i in copies)
    # Whole coordinates: distances are exact, and many are equal though the vectors differ.
    grid = spark.createDataFrame([((i * 7) % 121, [float(i % 11), float(i // 11)]) for i in range(121)], "cell_id long, vec array<double>")
    place = {(i * 7) % 121: (i % 11, i // 11) for i in range(121)}
    found = {(r["src"], r["nth"]): (r["dst"], r["distance"]) for r in dimred.neighbours(grid, 3).collect()}
    for i, (x, y) in place.items():
        best = sorted((j != i, math.hypot(x - p, y - q), j) for j, (p, q) in place.items())[:3]
        assert [found[i, n] for n in range(3)] == [(j, pytest.approx(d)) for _, d, j in best]


def test_neighbours_in_blocks_that_never_meet_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(11)
    vec = np.concatenate([rng.normal(size=(300, 5)), np.repeat(rng.normal(size=(1, 5)), 60, axis=0)])
    points = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(vec)], "cell_id long, vec array<double>")
    monkeypatch.setattr(type(points), "toPandas", lambda self: pytest.fail("all vectors on the driver"))
    # 12 blocks of 30 points in 6 groups: every query meets its neighbours in several tasks.
    for name, value in (("BLOCKS", 12), ("BLOCK_ROWS", 1), ("GROUP_BYTES", 2 * 30 * 5 * 8)):
        monkeypatch.setattr(dimred, name, value)
    found = {(r["src"], r["nth"]): (r["dst"], r["distance"]) for r in dimred.neighbours(points, 7).collect()}
    assert len(found) == 7 * len(vec)
    for i, v in enumerate(vec):
        d = np.sqrt(((vec - v) ** 2).sum(axis=1))
        best = sorted((j != i, d[j], 3 * j) for j in range(len(vec)))[:7]
        assert [found[3 * i, n] for n in range(7)] == [(j, pytest.approx(d)) for _, d, j in best]


def test_connectivities_find_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    edges = spark.range(50).selectExpr("id AS src", "(id + 1) % 50 AS dst", "1D AS distance").repartition(2).mapInPandas(count, "src long, dst long, distance double")
    assert dimred.connectivities(edges).count() == 100
    assert seen.value == 50


def test_nb_glm_takes_cells_that_are_alike_together(spark):
    rng = np.random.default_rng(8)
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    rows = [(c, g, float(v)) for g in range(2) for c, v in enumerate(rng.poisson(3, 400)) if v]
    x = spark.createDataFrame(rows, "cell_id long, gene_id long, value double").mapInPandas(count, "cell_id long, gene_id long, value double")
    obs = spark.createDataFrame([(c, "ctrl" if c % 2 else "A") for c in range(400)], "cell_id long, lab string")
    factors = obs.selectExpr("cell_id", "IF(cell_id % 3 = 0, 2D, 1D) AS size_factor")
    cells = nbglm.Cells(obs, factors, "lab", "ctrl", (), 4)
    assert cells.n == 400 and len(cells.shared.value[0]) == 4
    counts = cells.counts(x).toPandas()
    assert len(counts) < 120 and counts["k"].sum() == len(rows)
    # One row for each cell gives the same fit.
    y = np.array([dict(((r[0], r[1]), r[2]) for r in rows).get((c, 0), 0.0) for c in range(400)])
    mark, off = (np.arange(400) % 2 == 0).astype(float), np.log(np.where(np.arange(400) % 3 == 0, 2.0, 1.0))
    beta, alpha, *_ = nbglm.irls(y, np.stack((np.ones(400), mark), axis=1), off, None)
    seen.value = 0
    out = nbglm.nb_glm_test(x, obs, spark.createDataFrame([(0,), (1,)], "gene_id long"), "lab", "ctrl", size_factors=factors, shrink_dispersion=False)
    got = out.where("gene_id = 0").first()
    assert (got["logfoldchange_raw_ln"], got["intercept"], got["dispersion_raw"]) == (pytest.approx(beta[1], abs=1e-7), pytest.approx(beta[0], abs=1e-7), pytest.approx(alpha, rel=1e-6))
    # The counts are made once.
    assert seen.value == len(rows)


def counted(spark, rows):
    """Counts that say how many of their rows were made."""
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    kind = "cell_id long, gene_id long, value double"
    return spark.createDataFrame(rows, kind).mapInPandas(count, kind), seen


def test_size_factors_and_rank_sums_make_counts_once(spark):
    rows = [(c, g, float(1 + (c * 7 + g) % 5)) for c in range(20) for g in range(4) if (c + g) % 3]
    x, seen = counted(spark, rows)
    obs = spark.createDataFrame([(c, "ctrl" if c % 2 else "A") for c in range(20)], "cell_id long, lab string")
    assert size_factors.deseq_size_factors(x, obs).count() == 20
    assert seen.value == len(rows)
    seen.value = 0
    assert differential.wilcoxon_statistics(x, obs, spark.range(4).withColumnRenamed("id", "gene_id"), "lab", "ctrl").count() == 4
    assert seen.value == len(rows)


def test_dispersion_trend_and_priors_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    mean = np.exp(rng.uniform(-5, 5, 1500))
    disp = (0.2 + 1.5 / mean) * rng.gamma(8, 1 / 8, 1500)
    pairs = nbglm.Pairs(spark.createDataFrame(list(zip(mean.tolist(), disp.tolist(), strict=True)), "base_mean double, dispersion_raw double").repartition(5))
    # Means outside those fitted follow the line, too.
    line = nbglm.fit_trend(pairs)(np.array([1e-4, 1.0, 1e6]))
    assert np.allclose(line, [0.2 + 1.5e4, 1.7, 0.2], rtol=0.1)
    assert line[0] / (nbglm.fit_trend(pairs)(np.array([2e-4]))[0]) == pytest.approx(2, rel=1e-3)
    assert nbglm.fit_trend(pairs, "mean")(mean)[0] == pytest.approx(np.median(disp), rel=1e-12)
    c = np.polyfit(np.log(mean), np.log(disp), 2, w=np.sqrt(mean))
    assert np.allclose(nbglm.fit_trend(pairs, "local")(mean), np.exp(np.clip(np.polyval(c, np.log(mean)), math.log(1e-8), math.log(10))), rtol=1e-6)
    r = np.log(disp / nbglm.fit_trend(pairs)(mean))
    mad = 1.4826 * np.median(np.abs(r - np.median(r)))
    assert nbglm.prior_variance(pairs, nbglm.fit_trend(pairs), 10) == pytest.approx(max(mad**2 - special.trigamma(4.0), 0.25))
    b, se = rng.normal(0, 0.6, 400), np.full(400, 0.2)
    table = spark.createDataFrame(list(zip(b.tolist(), se.tolist(), strict=True)), "b double, s double")
    scale = nbglm.prior_scale(lambda of: nbglm.merged(table, of))
    assert scale == pytest.approx(math.sqrt((b**2 - se**2).mean())) and nbglm.prior_scale(nbglm.held_total(b, se)) == pytest.approx(scale)


def test_gram_blocks_match_numpy(spark):
    rng = np.random.default_rng(12)
    y = np.where(rng.random((300, 23)) < 0.3, rng.normal(size=(300, 23)), 0.0)
    x = store.from_dense(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)], "cell_id long, values array<double>"))
    got = {(r["g1"], r["g2"]): r["s"] for r in dimred.gram(x, size=8).collect()}
    want = y.T @ y
    assert all(got[i, j] == pytest.approx(want[i, j]) for i in range(23) for j in range(i, 23)) and len(got) == 23 * 12


def test_incremental_pca_of_low_rank_data_is_exact(spark):
    rng = np.random.default_rng(13)
    y = rng.normal(size=(2500, 4)) @ rng.normal(size=(4, 30)) + rng.normal(size=30)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)], "cell_id long, values array<double>")
    x, var = store.from_dense(rows), spark.createDataFrame([(i,) for i in range(30)], "gene_id int")
    a, b = (dimred.pca(x, rows.select("cell_id"), var, 4, method=m) for m in ("covariance", "incremental"))
    assert b.variance == pytest.approx(a.variance) and b.variance_ratio == pytest.approx(a.variance_ratio)
    left, right = (np.array([r["vec"] for r in p.scores.orderBy("cell_id").collect()]) for p in (a, b))
    assert np.allclose(left, right, atol=1e-8)
    with pytest.raises(ValueError):
        dimred.pca(x, rows, var, 4, method="other")


def test_umap_keeps_clusters_apart(spark):
    rng = np.random.default_rng(14)
    y = np.concatenate([rng.normal(size=(60, 5)), rng.normal(size=(60, 5)) + 12])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "cell_id long, vec array<double>")
    edges = dimred.connectivities(dimred.neighbours(points, 10))
    for start in (None, points):
        out = np.array([r["vec"] for r in dimred.umap(edges, start).orderBy("cell_id").collect()])
        apart = np.linalg.norm(out[:60].mean(axis=0) - out[60:].mean(axis=0))
        assert np.isfinite(out).all() and apart > 1.5 * max(out[:60].std(), out[60:].std())
    assert dimred.umap(edges).collect() == dimred.umap(edges).collect()
    assert dimred.curve(0.1, 1.0) == (pytest.approx(1.577, abs=0.01), pytest.approx(0.895, abs=0.01))


def counts_screen(spark, seed=3, n=240, genes=12):
    rng = np.random.default_rng(seed)
    label = np.array(["ctrl", "A", "B"])[np.arange(n) % 3]
    depth = rng.uniform(0.5, 2.0, n)
    mean = rng.uniform(4, 40, genes)[None, :] * depth[:, None]
    mean[label == "A", 0] *= 3
    y = rng.poisson(rng.gamma(4, mean / 4))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "cell_id long, values array<double>")
    obs = spark.createDataFrame([(i, str(label[i])) for i in range(n)], "cell_id long, lab string")
    var = spark.createDataFrame([(i,) for i in range(genes)], "gene_id int")
    factors = spark.createDataFrame([(i, float(d)) for i, d in enumerate(depth)], "cell_id long, size_factor double")
    return store.from_dense(rows), obs, var, factors, y, label, depth


def test_frozen_control_satisfies_its_score(spark):
    x, obs, var, factors, y, label, depth = counts_screen(spark)
    out = nbglm.nb_glm_test(x, obs, var, "lab", "ctrl", size_factors=factors, freeze_control=True, min_mu=0)
    for r in out.collect():
        a, own, g = r["dispersion"], label == r["lab"], r["gene_id"]
        score = lambda at, b: (((y[at, g] - (mu := np.exp(b) * depth[at])) / (1 + a * mu)).sum()) / y[at, g].sum()
        assert abs(score(label == "ctrl", r["intercept"])) < 1e-5 and abs(score(own, r["intercept"] + r["logfoldchange_raw_ln"])) < 1e-5
    top = {r["gene_id"] for r in out.where("lab = 'A' AND rank = 1").collect()}
    assert top == {0}


def test_model_scopes_and_dispersions(spark):
    x, obs, var, factors, y, label, depth = counts_screen(spark)
    run = lambda **o: {(r["lab"], r["gene_id"]): r for r in nbglm.nb_glm_test(x, obs, var, "lab", "ctrl", size_factors=factors, **o).collect()}
    wide = run(dispersion_scope="global")
    mu = depth[:, None] * y.sum(axis=0) / depth.sum()
    raw = (((y - mu) ** 2 - y) / mu**2).sum(axis=0) / (len(y) - 1)
    for (lab, g), r in wide.items():
        assert r["dispersion_raw"] == pytest.approx(raw[g]) and r["dispersion"] == pytest.approx(math.sqrt(raw[g] * r["dispersion_trend"]))
    pulled, grid = run(shrink_method="eb"), run(dispersion_method="cox-reid", shrink_dispersion=False)
    assert all(1e-3 <= r["dispersion"] <= 1e2 for r in grid.values())
    for r in pulled.values():
        low, high = sorted((r["dispersion_raw"], r["dispersion_trend"]))
        assert low * (1 - 1e-9) <= r["dispersion"] <= high * (1 + 1e-9)
    own = nbglm.nb_glm_test(x, obs, var, "lab", "ctrl", size_factor_scope="comparison")
    assert own.where("lab = 'A' AND rank = 1").first()["gene_id"] == 0
    for bad in ({"dispersion_scope": "cell"}, {"shrink_method": "none"}, {"freeze_control": True, "covariates": ("lab",)}, {"max_cells": 10}):
        with pytest.raises(ValueError):
            run(**bad)
    with pytest.raises(ValueError):
        nbglm.nb_glm_test(x, obs, var, "lab", "ctrl", size_factors=factors.limit(3))
    assert nbglm.deviance(np.array([3.0, 0.0]), np.array([3.0, 1e-12]), 0.5) == pytest.approx(0, abs=1e-9)


def test_outliers_are_replaced(spark):
    x, obs, var, factors, y, label, depth = counts_screen(spark, 5)
    at = int(np.flatnonzero(label == "B")[0])
    x = x.withColumn("value", F.when((F.col("cell_id") == at) & (F.col("gene_id") == 4), 50_000.0).otherwise(F.col("value")))
    run = lambda **o: nbglm.nb_glm_test(x, obs, var, "lab", "ctrl", size_factors=factors, **o).where("lab = 'B' AND gene_id = 4").first()
    assert abs(run(replace_outliers=True)["logfoldchange"]) < 0.6 < abs(run()["logfoldchange"])


def test_log_gamma_and_error_function():
    v = np.concatenate([np.logspace(-6, 9, 500), np.arange(1, 30)])
    assert np.allclose(special.lgamma(v), [math.lgamma(t) for t in v], rtol=1e-12, atol=1e-12)
    z = np.linspace(0, 25, 700)
    assert np.allclose(special.erfc(z), [math.erfc(t) for t in z], rtol=1e-11, atol=0)


def test_versions_layouts_slices_and_results(spark, screen, tmp_path):
    path = str(tmp_path / "s")
    screen.save(path, "genes")
    assert store.storage_format(spark, path) == "genes"
    held = Screen.load(spark, path)
    assert Screen.of((held.x, held.obs, held.var)).x.count() == Screen.of(screen).x.count()
    for _ in range(3):
        screen.save(path, "cells")
    assert store.storage_format(spark, path) == "cells" and len([p for p in (tmp_path / "s" / "x").iterdir() if p.name.startswith("v-")]) == 2
    assert Screen.of(path, spark).x.count() == screen.x.count()
    for bad in (5, (1, 2, 3)):
        with pytest.raises(TypeError):
            Screen.of(bad)
    with pytest.raises(ValueError):
        screen.write_obs(path, screen.obs.withColumn("cell_id", F.col("cell_id") + 1))
    screen.write_obs(path, screen.obs.withColumn("extra", F.lit(1)))
    assert "extra" in Screen.load_metadata(spark, path, "obs").columns and "obs" in screen.preview(2)
    screen.write_slot(path, "uns", spark.createDataFrame([("a", "1")], "key string, value string"))
    assert Screen.load(spark, path).slots["uns"].count() == 1
    with pytest.raises(FileNotFoundError):
        Screen.load_metadata(spark, path + "-none", "obs")
    with pytest.raises(ValueError):
        screen.write_slot(path, "x", screen.x)

    ordered = str(tmp_path / "sorted")
    store.write_sorted(screen.x, screen.obs, screen.var, ordered, "perturbation", "ctrl")
    with pytest.raises(ValueError):
        store.write_sorted(screen.x, screen.obs, screen.var, ordered, "perturbation", "ctrl")
    assert store.storage_format(spark, ordered) == "sorted" and store.label_bounds(spark, ordered, "B") == (4, 6)
    assert store.label_bounds(spark, path, "B") is None
    with pytest.raises(KeyError):
        store.label_bounds(spark, ordered, "Z")
    own = lambda d: sorted(map(tuple, d.select("cell_id", "gene_id", "value").collect()))
    assert own(store.label_slice(spark, ordered, "B", "perturbation")) == own(store.label_slice(spark, path, "B", "perturbation")) == own(screen.x.where("cell_id >= 4"))

    result = screen.pp.normalize_total_log1p().tl.rank_genes_groups("perturbation", method="t-test")
    saved = screen.tl.save_result(result, path, "ttest", {"min": 1})
    assert saved.endswith("screenloom_t_test") and screen.tl.load_result(path, "t-test", {"min": 1}).count() == result.count()
    assert screen.tl.load_result(path, "t-test", {"min": 2}) is None and screen.tl.load_result(path, "wilcoxon") is None
    wide = store.ranked_layout(result, 2).orderBy("rank").collect()
    first = result.where("rank = 1 AND lab = 'A'").first()
    assert [r["rank"] for r in wide] == [1, 2] and wide[0]["A"]["gene_id"] == first["gene_id"]


def test_blocks_of_a_matrix(screen):
    parts = [(a, b, rows.count()) for a, b, rows in store.iter_blocks(screen.x, "cell_id", 4)]
    assert parts == [(0, 4, sum(v > 0 for r in F1[:4] for v in r)), (4, 8, sum(v > 0 for r in F1[4:] for v in r))]
    assert [a for a, _, _ in store.iter_blocks(screen.x, "gene_id", 3)] == [0, 3]


def test_profiler_reads_time_and_memory():
    from screenloom.functions.profiling import Profiler

    p = Profiler(interval=0.001, trace=True)
    with p.section("held"):
        data = bytearray(50 << 20)
        data[::4096] = b"x" * len(data[::4096])
    with pytest.raises(ValueError), p.section("failed"):
        raise ValueError
    assert [s.name for s in p.sections] == ["held", "failed"] and p.sections[0].python_mb > 45 and p.sections[0].peak_mb > 50
    assert p.report().startswith("held: ")


def test_pseudobulk_refuses_unknown_labels(screen):
    with pytest.raises(ValueError):
        screen.pb.pseudobulk("perturbation", perturbations=["A", "none"])
    with pytest.raises(ValueError):
        screen.pb.pseudobulk("perturbation", baseline_count=0)
    assert {r["lab"] for r in screen.pb.pseudobulk("perturbation", perturbations=["A"]).collect()} == {"A"}


def test_demo_screen_and_genes_to_symbols(spark):
    x, obs, var = store.demo_screen(spark, 300, 40, 3)
    share = obs.where("perturbation = 'ctrl'").count() / 300
    assert obs.count() == 300 and var.count() == 40 and 0.2 < share < 0.4 and x.where("value <= 0").isEmpty()
    means = dict(differential.average_log_expression(x, obs, var, "perturbation", "ctrl").where("lab = 'KO1'").select("gene_id", "effect").collect())
    assert all(means[g] > 1 for g in range(5)) and abs(means[30]) < 1
    mapping = spark.createDataFrame([("gene1", "S1")], "id string, symbol string")
    names = {r["gene_id"]: r["gene_name"] for r in labels.map_genes(var, mapping, "gene_name").collect()}
    assert names[1] == "S1" and names[2] == "gene2"
    with pytest.raises(ValueError):
        labels.map_genes(var, mapping, "gene_name", "error")


def test_full_shrinkage_falls_back_on_a_grid():
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.poisson(20, 50), rng.poisson(40, 50)]).astype(float)
    mark = np.repeat([0.0, 1.0], 50)
    b, se = nbglm.posterior_mode(y, mark, np.zeros(100), 0.1, 0.5, math.log(20), math.log(2))
    assert 0 < b < math.log(2) and 0 < se < 0.2


def test_failed_labels_are_noted_and_tried_again(spark, tmp_path):
    path, broken = str(tmp_path / "run"), {"B", "D"}

    def compute(some):
        if broken & set(some):
            raise RuntimeError("no")
        return spark.createDataFrame([(c, 1) for c in some], "lab string, v int")

    with pytest.raises(RuntimeError):
        store.resumable(spark, str(tmp_path / "other"), ["B"], {}, compute)
    assert store.resumable(spark, path, list("ABCDE"), {}, compute, batch=2, skip_failed=True).count() == 3
    assert store.failed_labels(spark, path) == ["B", "D"]
    broken.clear()
    assert store.resumable(spark, path, list("ABCDE"), {}, compute, skip_failed=True).count() == 5 and store.failed_labels(spark, path) == []
    assert [store.checkpoint_interval(n) for n in (5, 100, 999, 1000)] == [1, 10, 10, 50]


def test_compressed_runs_of_rows_and_columns():
    from screenloom.sources.annotated import compressed

    y = np.array(F1, float)
    rows = [list(map(float, r)) for r in F1]
    data, indices, edges = [], [], [0]
    for r in rows[2:5]:
        at = np.flatnonzero(r)
        data += [r[i] for i in at] + [0.0]
        indices += [*at, 0]
        edges.append(len(data))
    got = sorted(compressed(np.array(data), np.array(indices), np.array(edges), 2, False))
    assert got == sorted((i, j, y[i, j]) for i in range(2, 5) for j in range(4) if y[i, j])
    assert {(j, i) for i, j, _ in got} == {(i, j) for i, j, _ in compressed(np.array(data), np.array(indices), np.array(edges), 2, True)}


def test_results_by_label(screen):
    out = frames.Results(screen.pp.normalize_total_log1p().tl.rank_genes_groups("perturbation", method="t-test"))
    assert list(out) == ["A", "B"] and len(out) == 2 and [r["rank"] for r in out["A"].collect()] == [1, 2, 3, 4]
    with pytest.raises(KeyError):
        out["C"]
