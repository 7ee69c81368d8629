"""Exact deduplication over an extendible-hash index kept in shared files (DataFrame operations only)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, if_small, materialise, plain_text

CELL_BITS = 60


def normalised(text_col: str) -> Column:
    return F.regexp_replace(plain_text(text_col), SPACE, " ")


def sha256_text(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _cell(digest: Column) -> Column:
    """The leading 60 bits of a hex digest."""
    return F.conv(F.rpad(F.substring(digest, 1, CELL_BITS // 4), CELL_BITS // 4, "0"), 16, 10).cast("long")


def directory(digests: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket) for every slot of the directory, and its depth in bits.

    digests holds one row per distinct digest. The directory starts at the depth that fits its rows and doubles
    while some bucket is over capacity; a split looks at the rows of overfull buckets only. A bucket that stays at a
    lower depth owns several slots.
    """
    spark = digests.sparkSession
    cells = materialise(digests.select(_cell(F.col("digest")).alias("cell")), "cells")
    depth = least = max(0, math.ceil(math.log2(max(1, cells.count()) / capacity)))
    split: list[DataFrame] = []
    part = cells
    while depth < CELL_BITS:
        prefix = F.shiftright("cell", CELL_BITS - depth)
        over = materialise(part.groupBy(prefix.alias("prefix")).count().where(F.col("count") > capacity).select("prefix"), "split")
        if over.isEmpty():
            break
        # Rows with one and the same leading 60 bits cannot be told apart by doubling; they stay one chain.
        part = part.join(over, prefix == over["prefix"], "left_semi")
        if part.select("cell").distinct().limit(2).count() < 2:
            break
        split.append(over)
        depth += 1
    slots = spark.range(2**depth).select(F.col("id").alias("slot"))
    bucket = F.concat_ws("/", F.lit(least), F.shiftright("slot", depth - least))
    for i, over in enumerate(split):
        named = over.select(F.col("prefix").alias(f"p{i}"))
        slots = slots.join(named, F.shiftright("slot", depth - least - i) == F.col(f"p{i}"), "left")
        deeper = F.concat_ws("/", F.lit(least + i + 1), F.shiftright("slot", depth - least - i - 1))
        bucket = F.when(F.col(f"p{i}").isNotNull(), deeper).otherwise(bucket)
    return materialise(slots.select("slot", bucket.alias("bucket")), "directory"), depth


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 17, digest: Callable[[Column], Column] = sha256_text) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after each run of ASCII white space became one space; the least id of equal texts
    stays. The directory routes every digest to the bucket that owns its key range. Owners look up the entry of a
    digest in their bucket; where several rows share a digest, their texts are compared byte by byte within the
    bucket, and different ones make a chain of entries that is searched by the text. Only texts with a repeated
    digest move. The index (bucket, digest, least id, rows) is a table in the shared folder.

    Null texts are empty; long texts are compared whole. Every row of a repeated id counts. Null ids sort last: they
    stay only if no other id has the text, and a group of null ids keeps all of them. An empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    own = digest is sha256_text
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).withColumn("digest", digest(F.col("norm")))
    keys = materialise(rows.select("id", "digest", *([] if own else [sha256_text(F.col("norm")).alias("text_sha256")])), "keys")
    seen = materialise(keys.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")), "seen")
    slots, depth = directory(seen.select("digest"), capacity)
    slots = if_small(slots, "slots")

    def routed(df: DataFrame) -> DataFrame:
        return df.withColumn("slot", F.shiftright(_cell(F.col("digest")), CELL_BITS - depth)).join(slots, "slot").drop("slot")

    index = materialise(routed(seen).repartition("bucket").sortWithinPartitions("bucket", "digest"), "index")
    many = index.where("n > 1").select("bucket", "digest")
    few = if_small(many.select(F.xxhash64("digest").alias("h")).distinct(), "many")
    held = routed(rows.withColumn("h", F.xxhash64("digest")).join(few, "h", "left_semi").drop("h"))
    entries = held.groupBy("bucket", "digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    met = materialise(entries.select("bucket", "digest", "keep_id", "n").join(many, ["bucket", "digest"], "left_semi"), "entries")
    chains = materialise(met.groupBy("bucket", "digest").agg(F.count("*").alias("links")).where("links > 1").select("bucket", "digest"), "chains")
    # A digest met once is its own entry; one chain link needs no text to be found; longer chains are searched by it.
    lone = index.where("n = 1").select("bucket", "digest", F.col("least").alias("keep_id"), "n")
    linked = not chains.isEmpty()
    short = lone.unionByName(met.join(chains, ["bucket", "digest"], "left_anti") if linked else met)
    out = routed(keys).join(short, ["bucket", "digest"])
    if linked:
        full = rows.join(chains, "digest")
        apart = full.groupBy("bucket", "digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
        full = full.join(apart, ["bucket", "digest", "norm"]).withColumn("text_sha256", sha256_text(F.col("norm")))
        out = out.unionByName(full.select(*out.columns))
    sha = F.col("digest" if own else "text_sha256").alias("text_sha256")
    return out.select("id", "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), sha)
