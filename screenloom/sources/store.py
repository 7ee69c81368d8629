"""Storage of screens: coordinate tables, layouts, atomic results and resumable runs."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one is made only where none is named on a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    own = tempfile.mkdtemp(prefix="screenloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def result_path(source: str, suffix: str, output_dir: str | None = None, data_name: str | None = None, prefix: str = "screenloom") -> str:
    """folder/prefix_[data_name_]suffix; a name that has them already keeps one prefix and suffix."""
    folder, _, stem = source.rstrip("/").rpartition("/")
    name = data_name if data_name is not None else ""
    name = name.removeprefix(f"{prefix}_").removesuffix(f"_{suffix}")
    return "/".join(p for p in (output_dir or folder, "_".join(p for p in (prefix, name, suffix) if p)) if p)


def fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    f, p = fs(spark, path)
    return f.exists(p)


POINTER = "_current"


def read_mark(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    f, p = fs(spark, path)
    if not f.exists(p):
        return None
    held = f.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(held)).decode()
    finally:
        held.close()


def write_mark(spark: SparkSession, path: str, text: str) -> None:
    f, p = fs(spark, path)
    out = f.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def table_path(spark: SparkSession, path: str) -> str:
    """The folder of a published table's present version (a plain table is its own)."""
    version = read_mark(spark, f"{path}/{POINTER}")
    return path if version is None else f"{path}/{version}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(table_path(spark, path))


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version, then move the pointer to it in one step: a reader sees the old table or the new one.

    The version before stays for readers that hold it; older ones go.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    f, p = fs(spark, path)
    before = table_path(spark, path).rpartition("/")[2] if f.exists(p) else None
    df.write.parquet(f"{path}/{version}")
    jvm = spark.sparkContext._jvm
    side = jvm.org.apache.hadoop.fs.Path(f"{path}/.{version}")
    write_mark(spark, f"{path}/.{version}", version)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    # Qualified with the file system that wrote it: a relative path may name another one.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(f.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(f.makeQualified(side), f.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")), options)
    for s in f.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            f.delete(s.getPath(), True)


def blocks(x: DataFrame, axis: str = "cell_id", size: int = 1024) -> DataFrame:
    """x with the block number of its cell_id or gene_id, size ids a block: the unit of blockwise work."""
    return x.withColumn("block", F.floor(F.col(axis) / size).cast("long"))


def iter_blocks(x: DataFrame, axis: str = "cell_id", size: int = 1024) -> Iterator[tuple[int, int, DataFrame]]:
    """(first id, end, rows) of the blocks that hold values, in order; rows are lazy."""
    for r in blocks(x, axis, size).select("block").distinct().orderBy("block").toLocalIterator():
        at = r["block"] * size
        yield at, at + size, x.where(F.col(axis).between(at, at + size - 1))


def map_blocks(x: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, axis: str = "cell_id", size: int = 1024) -> DataFrame:
    """run on the rows of each block; a task holds one block."""
    return blocks(x, axis, size).groupBy("block").applyInPandas(run, schema)


def from_dense(rows: DataFrame, vector: str = "values") -> DataFrame:
    """(cell_id, values array) -> (cell_id, gene_id, value) without zeros; gene_id is the place in the array."""
    return rows.select("cell_id", F.posexplode(vector).alias("gene_id", "value")).where("value <> 0").select("cell_id", "gene_id", F.col("value").cast("double").alias("value"))


def to_dense(x: DataFrame, n_genes: int) -> DataFrame:
    """(cell_id, values array) of the cells with values."""
    m = x.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("gene_id").cast("int"), "value"))).alias("m"))
    return m.select("cell_id", F.transform(F.sequence(F.lit(0), F.lit(n_genes - 1)), lambda g: F.coalesce(F.try_element_at("m", g), F.lit(0.0))).alias("values"))


def by_cell(x: DataFrame) -> DataFrame:
    """Row-major layout."""
    return x.repartitionByRange("cell_id").sortWithinPartitions("cell_id", "gene_id")


def by_gene(x: DataFrame) -> DataFrame:
    """Column-major layout."""
    return x.repartitionByRange("gene_id").sortWithinPartitions("gene_id", "cell_id")


def sorted_cells(obs: DataFrame, label: str, control: str) -> tuple[DataFrame, DataFrame]:
    """(cells with their place, control first, then labels by name, cells in order; (lab, start, end) of each label).

    Places are ranges of the sorted cells, counted range by range: no label's cells have to meet in one task.
    """
    lab = F.col(label).cast("string")
    order = [F.col("lab") != control, F.col("lab"), F.col("cell_id")]
    cells = obs.withColumn("lab", lab).repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    cells = written(cells.withColumn("range", F.shiftright(row, 33)).withColumn("place", row.bitwiseAND(F.lit((1 << 33) - 1))), "sorted-cells")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    cells = cells.join(F.broadcast(starts), "range").withColumn("place", F.col("first") + F.col("place")).drop("first", "range")
    bounds = cells.groupBy("lab").agg(F.min("place").alias("start"), (F.max("place") + 1).alias("end"))
    return cells, bounds


def write_sorted(x: DataFrame, obs: DataFrame, var: DataFrame, path: str, label: str, control: str, force: bool = False) -> None:
    """A screen with its cells in order of sorted_cells: x and obs by place, and the table bounds (lab, start, end).

    ValueError if path holds a sorted screen already, unless force.
    """
    if exists(x.sparkSession, f"{path}/bounds") and not force:
        raise ValueError(f"{path} is sorted already")
    cells, bounds = sorted_cells(obs, label, control)
    placed = x.join(cells.select("cell_id", "place"), "cell_id").repartitionByRange("place").sortWithinPartitions("place", "gene_id")
    replace_table(placed, f"{path}/x")
    replace_table(cells.drop("lab").repartitionByRange("place").sortWithinPartitions("place"), f"{path}/obs")
    replace_table(var, f"{path}/var")
    replace_table(bounds.coalesce(1), f"{path}/bounds")


def label_bounds(spark: SparkSession, path: str, lab: str) -> tuple[int, int] | None:
    """[start, end) of a label's places in a sorted screen; None if it is not sorted; KeyError for an unknown label."""
    if not exists(spark, f"{path}/bounds"):
        return None
    row = read_table(spark, f"{path}/bounds").where(F.col("lab") == lab).first()
    if row is None:
        raise KeyError(lab)
    return row["start"], row["end"]


def label_slice(spark: SparkSession, path: str, lab: str, label: str) -> DataFrame:
    """x of one label: a range of places that prunes row groups in a sorted screen, else a semi join with obs."""
    x = read_table(spark, f"{path}/x")
    found = label_bounds(spark, path, lab)
    if found:
        return x.where(F.col("place").between(found[0], found[1] - 1))
    obs = read_table(spark, f"{path}/obs").where(F.col(label).cast("string") == lab)
    return x.join(obs.select("cell_id"), "cell_id", "left_semi")


def storage_format(spark: SparkSession, path: str) -> str:
    """"sorted", "cells" or "genes": how a saved screen's x is laid out ("cells" if nothing says so)."""
    if exists(spark, f"{path}/bounds"):
        return "sorted"
    return read_mark(spark, f"{path}/_layout") or "cells"


def write_result(result: DataFrame, path: str, params: dict) -> str:
    """Publish a test's result with the parameters it was made with, by which load_result knows it again."""
    replace_table(result, path)
    write_mark(result.sparkSession, f"{path}/_params", fingerprint(params))
    return path


def load_result(spark: SparkSession, path: str, params: dict | None = None) -> DataFrame | None:
    """A published result; None if there is none, or one of other parameters."""
    if not exists(spark, f"{path}/{POINTER}"):
        return None
    if params is not None and read_mark(spark, f"{path}/_params") != fingerprint(params):
        return None
    return read_table(spark, path)


def ranked_layout(result: DataFrame, n_genes: int | None = None, columns: tuple[str, ...] = ("statistic", "pvalue", "pvalue_adj", "logfoldchange")) -> DataFrame:
    """(rank, a column per label): structs (gene_id, *columns) of each label's genes by rank, for export."""
    rows = result if n_genes is None else result.where(F.col("rank") <= n_genes)
    return rows.groupBy("rank").pivot("lab").agg(F.first(F.struct("gene_id", *[c for c in columns if c in result.columns])))


def contiguity(obs: DataFrame, label: str, n_labels: int = 20) -> float:
    """Mean over the first labels by name of cells / span of cell ids: 1 if labels lie together."""
    span = obs.groupBy(F.col(label).cast("string").alias("lab")).agg((F.count("*") / (F.max("cell_id") - F.min("cell_id") + 1)).alias("c"))
    return float(span.orderBy("lab").limit(n_labels).agg(F.avg("c").alias("c")).first()["c"] or 0.0)


def needs_sorting(obs: DataFrame, label: str, min_cells: int = 360_000, min_labels: int = 100, threshold: float = 0.5) -> bool:
    row = obs.agg(F.count("*").alias("n"), F.count_distinct(F.col(label)).alias("k")).first()
    return row["n"] >= min_cells and row["k"] >= min_labels and contiguity(obs, label) < threshold


def fingerprint(params: dict) -> str:
    return json.dumps(params, sort_keys=True, default=str)


def checkpoint_interval(n_labels: int) -> int:
    """Labels between two writes of a run: 1, 10 or 50 for fewer than 100, fewer than 1000, or more labels."""
    return 1 if n_labels < 100 else 10 if n_labels < 1000 else 50


def resumable(spark: SparkSession, path: str, labels: list[str], params: dict, compute: Callable[[list[str]], DataFrame], batch: int | None = None, force: bool = False, skip_failed: bool = False) -> DataFrame:
    """A result by label, computed in batches of labels; a rerun with the same parameters does what is missing.

    Each batch (checkpoint_interval labels unless given) is one write into its own folder, listed only once it is
    whole; other parameters start anew. With skip_failed a batch that fails is tried label by label, and labels that
    fail again are noted in _failed (failed_labels) and tried anew by the next run; else the error is raised.
    """
    mark = f"{path}/_params"
    if force or (exists(spark, path) and read_mark(spark, mark) != fingerprint(params)):
        f, p = fs(spark, path)
        f.delete(p, True)
    if not exists(spark, mark):
        write_mark(spark, mark, fingerprint(params))
    f, p = fs(spark, path)

    def parts() -> list[str]:
        found = [s.getPath().toString() for s in f.listStatus(p) if s.getPath().getName().startswith("part-of-")]
        return [x for x in found if exists(spark, f"{x}/_SUCCESS")]

    def write(some: list[str]) -> None:
        compute(some).write.parquet(f"{path}/part-of-{uuid.uuid4().hex}")

    done = parts()
    have = {r["lab"] for r in spark.read.parquet(*done).select("lab").distinct().collect()} if done else set()
    left, failed = [c for c in labels if c not in have], []
    step = batch or checkpoint_interval(len(labels))
    for i in range(0, len(left), step):
        some = left[i : i + step]
        try:
            write(some)
        except Exception:
            if not skip_failed:
                raise
            for one in some:
                try:
                    write([one])
                except Exception:  # noqa: BLE001
                    failed.append(one)
    write_mark(spark, f"{path}/_failed", json.dumps(failed))
    if failed and not parts():
        raise RuntimeError(f"every label failed: {failed}")
    return spark.read.parquet(*parts())


def failed_labels(spark: SparkSession, path: str) -> list[str]:
    """Labels that the last run of resumable could not do."""
    return json.loads(read_mark(spark, f"{path}/_failed") or "[]")


def demo_screen(spark: SparkSession, n_cells: int = 400, n_genes: int = 100, n_labels: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(x, obs, var) of a made-up screen: 30 % control cells; each label raises five genes."""
    rng = np.random.default_rng(seed)
    labels = np.where(rng.random(n_cells) < 0.3, "ctrl", np.array([f"KO{i + 1}" for i in range(n_labels)])[rng.integers(0, n_labels, n_cells)])
    y = rng.negative_binomial(20, 0.95, (n_cells, n_genes)).astype(float)
    for i in range(n_labels):
        at = np.flatnonzero(labels == f"KO{i + 1}")
        y[np.ix_(at, range(5 * i, min(5 * i + 5, n_genes)))] += rng.poisson(10, (len(at), min(5, max(0, n_genes - 5 * i))))
    c, g = np.nonzero(y)
    x = spark.createDataFrame(pd.DataFrame({"cell_id": c, "gene_id": g.astype("int32"), "value": y[c, g]}))
    obs = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n_cells), "cell_name": [f"cell_{i}" for i in range(n_cells)], "perturbation": labels, "celltype": rng.choice(["A", "B"], n_cells)}))
    var = spark.createDataFrame(pd.DataFrame({"gene_id": np.arange(n_genes, dtype="int32"), "gene_name": [f"gene{i}" for i in range(n_genes)]}))
    return x, obs, var
