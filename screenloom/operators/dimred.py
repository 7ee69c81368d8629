"""PCA from the Gram matrix or chunk by chunk, nearest neighbours, connectivities and UMAP."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.store import written

MAX_GENES, COVARIANCE_GENES = 100_000, 15_000
#: Nearest neighbours: so many blocks if these have BLOCK_ROWS points, bytes of vectors in a block and in a group of blocks
#: at most, queries and points multiplied at a time, pairs measured at a time.
BLOCKS, BLOCK_ROWS, BLOCK_BYTES, GROUP_BYTES = 48, 1024, 1 << 22, 1 << 25
QUERIES, POINTS, MEASURED = 256, 2048, 1 << 16


@dataclass(frozen=True)
class Pca:
    scores: DataFrame
    loadings: DataFrame
    variance: np.ndarray
    variance_ratio: np.ndarray


def _placed(x: DataFrame, genes: DataFrame) -> tuple[DataFrame, list]:
    """(cell_id, place, value) of the listed genes, whose places follow the order of their ids, and the ids."""
    ids = [r["gene_id"] for r in genes.select("gene_id").distinct().orderBy("gene_id").limit(MAX_GENES + 1).collect()]
    if len(ids) > MAX_GENES:
        raise ValueError(f"more than {MAX_GENES} genes; mark the variable ones")
    table = x.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), f"gene_id {dict(x.dtypes)['gene_id']}, place int")
    return x.join(F.broadcast(table), "gene_id").select("cell_id", "place", F.col("value").cast("double").alias("value")), ids


def gram_blocks(placed: DataFrame, n_genes: int, size: int = 1024, values_per_task: int = 1 << 22) -> DataFrame:
    """(i, j, block): sums over cells of outer products of gene blocks i <= j, each size x size doubles as bytes.

    A value travels once per block of genes, not once per other value of its cell; a task multiplies the dense blocks
    of a chunk of cells, and the chunks' sums are added per pair of blocks.
    """
    n_blocks = max(1, -(-n_genes // size))
    n_chunks = max(1, -(-placed.count() * n_blocks // values_per_task))
    own = F.floor(F.col("place") / size).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    rows = placed.select("cell_id", "place", "value", own.alias("own"), other.alias("other"), F.pmod(F.xxhash64("cell_id"), F.lit(n_chunks)).cast("int").alias("chunk"))
    rows = rows.select("chunk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cell_id", "place", "value")

    def multiply(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        cells = np.unique(t.column("cell_id").to_numpy(), return_inverse=True)[1]
        place, value = t.column("place").to_numpy(), t.column("value").to_numpy()
        total = np.zeros((size, size))
        order = np.argsort(cells, kind="stable")
        edges = np.searchsorted(cells[order], np.arange(0, cells.max() + 1025, 1024))
        for at, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            part = order[lo:hi]
            wide = np.zeros((1024, 2 * size))
            wide[cells[part] - 1024 * at, place[part] - np.where(place[part] // size == i, i, j - 1) * size] = value[part]
            left = wide[:, :size]
            total += left.T @ (left if i == j else wide[:, size:])
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b) for b in t.column("block").to_pylist()], axis=0)
        return pa.table({"i": t.column("i").slice(0, 1), "j": t.column("j").slice(0, 1), "block": pa.array([total.tobytes()], pa.binary())})

    kind = "i int, j int, block binary"
    return rows.groupBy("i", "j", "chunk").applyInArrow(multiply, kind).groupBy("i", "j").applyInArrow(add, kind)


def gram(x: DataFrame, size: int = 1024) -> DataFrame:
    """(g1, g2, s): sums over cells of products of the stored values, g1 <= g2; pairs whose sum is 0 are left out."""
    placed, ids = _placed(x, x)
    kind = dict(x.dtypes)["gene_id"]
    held = pa.array(ids, to_arrow_type(x.schema["gene_id"].dataType))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, block in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                s = np.frombuffer(block).reshape(size, size)
                a, c = np.nonzero(np.triu(s) if i == j else s)
                yield pa.RecordBatch.from_arrays([held.take(pa.array(a + i * size)), held.take(pa.array(c + j * size)), pa.array(s[a, c])], names=["g1", "g2", "s"])

    return gram_blocks(placed, len(ids), size).mapInArrow(rows, f"g1 {kind}, g2 {kind}, s double")


def _covariance(placed: DataFrame, n_genes: int, n: int, size: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, variances, loadings), largest first, from the Gram blocks; only genes x genes numbers reach the driver."""
    full = -(-n_genes // size) * size
    cov, mean = np.zeros((full, full)), np.zeros(n_genes)
    for r in placed.groupBy("place").agg(F.sum("value").alias("s")).collect():
        mean[r["place"]] = r["s"] / n
    for r in gram_blocks(placed, n_genes, size).toLocalIterator():
        block = np.frombuffer(r["block"]).reshape(size, size)
        i, j = r["i"] * size, r["j"] * size
        cov[i : i + size, j : j + size] = block
        cov[j : j + size, i : i + size] = block.T
    cov = (cov[:n_genes, :n_genes] - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    return mean, values[::-1], vectors[:, ::-1]


def _merged(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray], k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Two (rows, mean, singular values times directions) as one, of rank k."""
    n = a[0] + b[0]
    shift = math.sqrt(a[0] * b[0] / n) * (a[1] - b[1])
    s, v = np.linalg.svd(np.vstack((a[2], b[2], shift)), full_matrices=False)[1:]
    return n, (a[0] * a[1] + b[0] * b[1]) / n, s[:k, None] * v[:k]


def _incremental(placed: DataFrame, obs: DataFrame, n_genes: int, k: int, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(means, variances, loadings, total variance) by merging the leading directions of chunks of cells.

    Exact if the data has rank k or less, else close. A task holds a chunk of cells as dense rows; k directions a
    task reach the driver. Needs no gene by gene matrix.
    """
    n_parts = max(1, -(-obs.count() // chunk))
    part = F.pmod(F.xxhash64("cell_id"), F.lit(n_parts)).cast("int")
    cells = obs.select("cell_id", part.alias("part")).distinct()
    rows = cells.join(placed, "cell_id", "left")

    def one(t: pa.Table) -> pa.Table:
        at = np.unique(t.column("cell_id").to_numpy(), return_inverse=True)[1]
        place = t.column("place").to_numpy(zero_copy_only=False).astype(float)
        wide, some = np.zeros((at.max() + 1, n_genes)), ~np.isnan(place)
        wide[at[some], place[some].astype(int)] = t.column("value").to_numpy(zero_copy_only=False)[some]
        mean = wide.mean(axis=0)
        s, v = np.linalg.svd(wide - mean, full_matrices=False)[1:]
        return pa.table({"n": [len(wide)], "square": [float((s * s).sum())], "mean": pa.array([mean.tobytes()], pa.binary()), "sv": pa.array([(s[:k, None] * v[:k]).tobytes()], pa.binary())})

    held, inside, between = None, 0.0, 0.0
    for r in rows.groupBy("part").applyInArrow(one, "n long, square double, mean binary, sv binary").toLocalIterator():
        own = (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["sv"]).reshape(-1, n_genes))
        if held is not None:
            between += held[0] * own[0] / (held[0] + own[0]) * float(((held[1] - own[1]) ** 2).sum())
        inside += r["square"]
        held = own if held is None else _merged(held, own, k)
    n, mean, sv = held
    size = np.linalg.norm(sv, axis=1)
    return mean, size**2 / max(n - 1, 1), (sv / np.maximum(size, 1e-300)[:, None]).T, (inside + between) / max(n - 1, 1)


def project(placed: DataFrame, obs: DataFrame, vectors: np.ndarray, centre: np.ndarray, values_per_task: int = 1 << 20) -> DataFrame:
    """(cell_id, vec): every cell's values times the vectors, less centre. A task takes a chunk of cells; the vectors,
    at most MAX_GENES rows of n_comps numbers, go to each executor once."""
    n_chunks = max(1, -(-placed.count() // values_per_task))
    chunk = F.pmod(F.xxhash64("cell_id"), F.lit(n_chunks)).cast("int")
    shared = placed.sparkSession.sparkContext.broadcast((vectors, centre))

    def run(t: pa.Table) -> pa.Table:
        v, c = shared.value
        cells, first, at = np.unique(t.column("cell_id").to_numpy(), return_index=True, return_inverse=True)
        out, place, value = np.zeros((len(cells), len(c))), t.column("place").to_numpy(), t.column("value").to_numpy()
        for i in range(0, len(at), 1 << 14):
            part = slice(i, i + (1 << 14))
            np.add.at(out, at[part], value[part, None] * v[place[part]])
        rows = pa.FixedSizeListArray.from_arrays(pa.array((out - c).ravel()), len(c)).cast(pa.list_(pa.float64()))
        return pa.table({"cell_id": t.column("cell_id").take(pa.array(first)), "vec": rows})

    kind = dict(placed.dtypes)["cell_id"]
    found = placed.withColumn("chunk", chunk).groupBy("chunk").applyInArrow(run, f"cell_id {kind}, vec array<double>")
    empty = F.array(*[F.lit(-v) for v in centre.tolist()])
    return obs.select("cell_id").join(found, "cell_id", "left").select("cell_id", F.coalesce("vec", empty).alias("vec"))


def pca(x: DataFrame, obs: DataFrame, var: DataFrame, n_comps: int = 50, highly_variable: bool = True, method: str = "auto") -> Pca:
    """Principal components of centred values (n - 1 variance); signs make the largest loading of each positive.

    "covariance" takes the Gram matrix of at most MAX_GENES genes, "incremental" merges chunks of cells, "auto" is
    covariance up to COVARIANCE_GENES genes. Genes not marked in var.highly_variable are left out if that column exists.
    """
    if method not in ("auto", "covariance", "incremental"):
        raise ValueError(f"unknown method {method}")
    if highly_variable and "highly_variable" in var.columns:
        var = var.where("highly_variable")
    placed, genes = _placed(x, var)
    placed, n = written(placed, "placed"), obs.count()
    k = min(n_comps, len(genes))
    if method == "covariance" or (method == "auto" and len(genes) <= COVARIANCE_GENES):
        mean, values, vectors = _covariance(placed, len(genes), n)
        total = float(np.maximum(values, 0).sum())
    else:
        mean, values, vectors, total = _incremental(placed, obs, len(genes), k)
    values, vectors = np.maximum(values[:k], 0), vectors[:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    table = x.sparkSession.createDataFrame([(g, vectors[i].tolist()) for i, g in enumerate(genes)], f"gene_id {dict(var.dtypes)['gene_id']}, vec array<double>")
    scores = project(placed, obs, vectors, mean @ vectors)
    return Pca(scores, table, values, values / total if total > 0 else values)


def _blocks(points: DataFrame) -> tuple[DataFrame, int, int]:
    """(block int, ids binary, vecs binary) of about equal numbers of points, written, how many blocks, and how many make a
    group; ids ascend in each block."""
    first = points.select(F.size("vec").alias("dim")).first()
    n, dim = points.count(), first["dim"] if first else 1
    wide = 8 * max(dim, 1)
    rows = max(1, min(max(-(-n // BLOCKS), BLOCK_ROWS), BLOCK_BYTES // wide))
    n_blocks = max(1, -(-n // rows))

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in parts if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).sort_by("cell_id")
            block, ids = t.column("block")[0].as_py(), t.column("cell_id").to_numpy().astype(np.int64)
            vecs = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vecs.tobytes()], pa.binary())], names=["block", "ids", "vecs"])

    dealt = points.select("cell_id", "vec").repartition(n_blocks).select(F.spark_partition_id().alias("block"), "cell_id", "vec")
    return written(dealt.mapInArrow(pack, "block int, ids binary, vecs binary"), "blocks"), n_blocks, max(1, GROUP_BYTES // (wide * rows))


def _best(k: int, row: np.ndarray, dst: np.ndarray, d: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places of the k first of every row: its own point, then by distance and id."""
    order = np.lexsort((dst, d, ~own, row))
    r = row[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return order[nth < k]


def _measured(vecs: np.ndarray) -> np.ndarray:
    """The vectors with their squared norm as one more number."""
    return np.column_stack((vecs, (vecs * vecs).sum(axis=1)))


class _Nearest:
    """The k nearest of some queries among the points met so far; only points that may be among them are measured exactly."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k, self.norm = ids, vecs, k, (vecs * vecs).sum(axis=1)
        self.row, self.dst, self.d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        # A squared distance that no further point may exceed.
        self.limit = np.full(len(ids), np.inf)
        # Twice the most that rounding can move a squared distance, as a share of the two squared norms.
        self.slack = 8 * (vecs.shape[1] + 5) * np.finfo(float).eps
        # Times _measured points: squared distances less the query's squared norm and what rounding may have added.
        self.times = np.column_stack((-2 * vecs, np.full(len(ids), 1 - self.slack)))

    def meet(self, ids: np.ndarray, points: np.ndarray, held: np.ndarray) -> None:
        """ids ascend; points are _measured, held has room for the products. What is not a number leaves nothing out."""
        rough = np.matmul(self.times, points.T, out=held[: len(self.ids) * len(ids)].reshape(len(self.ids), len(ids)))
        if np.isinf(self.limit).any() and len(ids) > self.k:
            upper = np.partition(rough + 2 * self.slack * points[:, -1], self.k - 1, axis=1)[:, self.k - 1]
            self.limit = np.fmin(self.limit, upper + self.norm * (1 + self.slack))
        near = rough > (self.limit - self.norm * (1 - self.slack))[:, None]
        np.logical_not(near, out=near)
        low, high = np.searchsorted(ids, self.ids), np.searchsorted(ids, self.ids, "right")
        for i in np.flatnonzero(high > low):
            near[i, low[i] : high[i]] = True
        at = np.flatnonzero(near)
        for i in range(0, len(at), MEASURED):
            r, c = np.divmod(at[i : i + MEASURED], len(ids))
            d = np.sqrt(((points[c, :-1] - self.q[r]) ** 2).sum(axis=1))
            r, dst, d = np.concatenate((self.row, r)), np.concatenate((self.dst, ids[c])), np.concatenate((self.d, d))
            best = _best(self.k, r, dst, d, dst == self.ids[r])
            self.row, self.dst, self.d = r[best], dst[best], d[best]
        if len(at):
            full = np.bincount(self.row, minlength=len(self.ids)) >= self.k
            far = np.full(len(self.ids), -np.inf)
            np.maximum.at(far, self.row, self.d)
            self.limit = np.where(full, far * far * (1 + 8 * np.finfo(float).eps), self.limit)


def neighbours(points: DataFrame, k: int = 15) -> DataFrame:
    """(src, dst, distance, nth): the k nearest points of each by Euclidean distance, itself included; ties by id.

    points: (cell_id, vec). A task compares one block of queries with one group of blocks, each of bounded bytes; the
    groups' k nearest of a query are merged. All pairs are compared, so time grows with the square of the points, but
    no task or driver holds more than its blocks.
    """
    blocks, n_blocks, per_group = _blocks(points)
    n_groups = -(-n_blocks // per_group)
    queries = blocks.repartitionById(n_blocks, "block")
    others = blocks.select(F.col("ids").alias("ids2"), F.col("vecs").alias("vecs2"), F.pmod("block", F.lit(n_groups)).alias("grp")).repartitionById(n_groups, "grp").drop("grp")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found, held = None, [], np.empty(QUERIES * POINTS)
        for b in parts:
            for i in range(b.num_rows):
                own, ids, vecs, ids2, vecs2 = (b.column(c)[i] for c in range(5))
                if own.as_py() != block:
                    yield from results(block, found)
                    block, q = own.as_py(), np.frombuffer(ids.as_buffer(), np.int64)
                    v = np.frombuffer(vecs.as_buffer()).reshape(len(q), -1).copy()
                    found = [_Nearest(q[at : at + QUERIES].copy(), v[at : at + QUERIES], k) for at in range(0, len(q), QUERIES)]
                p = np.frombuffer(ids2.as_buffer(), np.int64)
                w = _measured(np.frombuffer(vecs2.as_buffer()).reshape(len(p), -1))
                for at in range(0, len(p), POINTS):
                    for f in found:
                        f.meet(p[at : at + POINTS], w[at : at + POINTS], held)
        yield from results(block, found)

    def results(block: int | None, found: list[_Nearest]) -> Iterator[pa.RecordBatch]:
        for i, f in enumerate(found):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([i], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (f.ids, f.row, f.dst, f.d))], names=["block", "part", "ids", "row", "dst", "d"])

    def merge(t: pa.Table) -> pa.Table:
        ids = np.frombuffer(t.column("ids")[0].as_buffer(), np.int64)
        row, dst, d = (np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in t.column(c)]) for c, kind in (("row", np.int64), ("dst", np.int64), ("d", float)))
        best = _best(k, row, dst, d, dst == ids[row])
        row = row[best]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        return pa.table({"src": ids[row], "dst": dst[best], "distance": d[best], "nth": nth.astype(np.int32)})

    pairs = queries.hint("shuffle_replicate_nl").crossJoin(others)
    near = pairs.mapInArrow(compare, "block int, part int, ids binary, row binary, dst binary, d binary")
    return near.groupBy("block", "part").applyInArrow(merge, "src long, dst long, distance double, nth int")


def connectivities(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): exp(-distance / sigma), sigma the mean distance of the farthest neighbour, made symmetric by half sums.

    The edges are read three times, so they are found once and written.
    """
    edges = written(edges, "edges")
    last = edges.groupBy("src").agg(F.max("distance").alias("far")).agg(F.avg("far").alias("sigma"))
    w = edges.crossJoin(F.broadcast(last)).select("src", "dst", F.exp(-F.greatest("distance", F.lit(1e-10)) / F.greatest("sigma", F.lit(1e-10))).alias("w"))
    both = w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") / 2).alias("weight"))


def curve(min_dist: float = 0.5, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + a d**(2 b)) comes closest to 1 up to min_dist and an exponential fall of that spread beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.array([0.0, 0.0])
    for _ in range(200):
        a, b = np.exp(p)
        t = a * d ** (2 * b)
        f = 1 / (1 + t)
        slope = np.stack((-f * f * t, -f * f * t * 2 * b * np.log(d)), axis=1)
        step = np.linalg.solve(slope.T @ slope + 1e-6 * np.eye(2), slope.T @ (want - f))
        p = p + np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-10:
            break
    return float(np.exp(p[0])), float(np.exp(p[1]))


def spectral(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, rng: np.random.Generator, dims: int = 2, rounds: int = 200) -> np.ndarray:
    """Leading non-constant eigenvectors of the normalised graph, by subspace iteration."""
    degree = np.sqrt(np.maximum(np.bincount(a, w, n), 1e-12))
    q = np.linalg.qr(np.column_stack((degree, rng.normal(size=(n, dims)))))[0]
    for _ in range(rounds):
        step = np.stack([np.bincount(a, w * (c / degree)[b], n) / degree for c in q.T], axis=1)
        q = np.linalg.qr(0.5 * (step + q))[0]
    return q[:, 1:] / np.maximum(np.abs(q[:, 1:]).max(axis=0), 1e-12)


def umap(edges: DataFrame, points: DataFrame | None = None, min_dist: float = 0.5, spread: float = 1.0, n_epochs: int = 200, negatives: int = 5, seed: int = 0, max_points: int = 100_000) -> DataFrame:
    """(cell_id, vec of 2): uniform manifold approximation of a weighted neighbour graph, on the driver (checked size).

    Starts from the graph's spectral embedding, or the first two coordinates of points if given. In each epoch an edge
    is drawn with its weight's share of the largest; its ends attract and negatives random points repel, by the
    gradients of the cross entropy of edge weights and 1 / (1 + a d**(2 b)).
    """
    nodes = edges.select(F.col("src").alias("cell_id")).unionByName(edges.select(F.col("dst").alias("cell_id"))).distinct()
    ids = np.sort(nodes.limit(max_points + 1).toPandas()["cell_id"].to_numpy())
    if len(ids) > max_points:
        raise ValueError(f"more than {max_points} points")
    rng, e = np.random.default_rng(seed), edges.where("src <> dst").orderBy("src", "dst").toPandas()
    i, j, w = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"]), e["weight"].to_numpy(float)
    if points is not None:
        held = points.toPandas().set_index("cell_id")["vec"].reindex(ids)
        pos = np.array([v[:2] for v in held], float)
        pos = pos / max(np.abs(pos).max(initial=0), 1e-12)
    else:
        pos = spectral(i, j, w, len(ids), rng)
    pos = 10 * pos + rng.normal(0, 1e-4, pos.shape)
    a, b = curve(min_dist, spread)
    w = w / max(w.max(initial=0), 1e-12)
    for t in range(n_epochs):
        use = np.flatnonzero(rng.random(len(w)) < w)
        rate = 1 - t / n_epochs
        d = pos[i[use]] - pos[j[use]]
        r = np.maximum((d * d).sum(axis=1, keepdims=True), 1e-12)
        pull = np.clip(-2 * a * b * r ** (b - 1) / (1 + a * r**b) * d, -4, 4)
        move = np.zeros_like(pos)
        np.add.at(move, i[use], pull)
        np.add.at(move, j[use], -pull)
        for _ in range(negatives):
            d = pos[i[use]] - pos[rng.integers(0, len(ids), len(use))]
            r = (d * d).sum(axis=1, keepdims=True)
            np.add.at(move, i[use], np.clip(2 * b / ((0.001 + r) * (1 + a * r**b)) * d, -4, 4))
        # Many edges meet in a point in one epoch: its moves are averaged over their number's square root.
        n = np.maximum(np.bincount(np.concatenate((i[use], j[use])), minlength=len(ids)), 1)
        pos = pos + rate * move / np.sqrt(n)[:, None]
    return edges.sparkSession.createDataFrame([(int(c), p.tolist()) for c, p in zip(ids, pos, strict=True)], "cell_id long, vec array<double>")
