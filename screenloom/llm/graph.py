"""Connected components of a distributed edge list by randomised contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place it reaches over the links a-b, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, root), one row per linked node; root is some member of its component.

    Each round every node moves to the member of its closed neighbourhood with the least hash, links are rewritten
    between those targets, and loops go. Hash order changes with the round, so long chains shrink geometrically.
    Every round ends in a written table; nothing is gathered on the driver.
    """
    live = materialise(_clean(edges), "links")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        if len(maps) >= max_rounds:
            raise RuntimeError("components did not converge")
        salt = F.lit(len(maps))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("x"))
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = materialise(best.select(F.col("a").alias("node"), F.least("m", rank("a"))["x"].alias("parent")), "parents")
        maps.append(step)
        left = live.join(step.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        moved = left.join(step.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        live = materialise(_clean(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "links")
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1].select("node", F.col("parent").alias("root"))
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("parent"), F.col("root").alias("later"))
        out = step.join(later, "parent", "left").select("node", F.coalesce("later", "parent").alias("root"))
    return out


def _clean(edges: DataFrame) -> DataFrame:
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pair.where("a <> b").distinct()
