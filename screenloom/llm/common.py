"""Shared pieces of the training-data operators: small tables, ordered batches, packed integer blobs."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written as materialise

#: A word is a maximal run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def plain_text(col: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def searchsorted(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are <= value, by binary search over a literal; nulls come first."""
    if not bounds:
        return F.lit(0)
    bits = len(bounds).bit_length()
    padded = [*bounds, *[2**63 - 1] * (2**bits - 1 - len(bounds))]
    table = F.lit(np.array(padded, dtype=np.int64))
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.element_at(table, at + s) <= value, at + s).otherwise(at))


def in_order_batches(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int) -> DataFrame:
    """(batch int, id long, data binary) where batches are ascending ranges of ids of about batch_bytes of text.

    The bounds are percentiles of all ids, so batches stay even however ids are spread. Null ids form part of batch 0.
    """
    stats = docs.agg(F.sum(F.octet_length(plain_text(text_col))).alias("bytes")).first()
    n = max(1, -(-int(stats["bytes"] or 0) // batch_bytes))
    bounds: list[int] = []
    if n > 1:
        cuts = [i / n for i in range(1, n)]
        found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), cuts, max(10000, 20 * n)).alias("q")).first()["q"]
        bounds = sorted(set(found or []))
    rid = F.col(id_col).cast("long")
    return docs.select(searchsorted(rid, bounds).cast("int").alias("batch"), rid.alias("id"), plain_text(text_col).cast("binary").alias("data"))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as zstd-compressed byte planes of their differences."""
    deltas = np.diff(values, prepend=values[:1] * 0) if len(values) else values
    width = max(1, (int(deltas.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(deltas.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def packed_count(blob: bytes) -> int:
    """How many values pack_sorted put into blob."""
    return int.from_bytes(blob[1:9], "little")


def unpack_sorted(blob: bytes) -> np.ndarray:
    width, n = blob[0], packed_count(blob)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[9:], max_output_size=width * n + 1), dtype=np.uint8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64)


def if_small(ids: DataFrame, name: str, max_rows: int = 1 << 21) -> DataFrame:
    """A written table of narrow rows, marked for broadcast only if counted at most max_rows (32 MB of long keys)."""
    held = materialise(ids, name)
    return F.broadcast(held) if held.count() <= max_rows else held


def chosen_rows(docs: DataFrame, dropped: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows of dropped (id, key): rows that share an id, or have none, are told apart by their key."""
    i, k = dropped.columns
    gone = if_small(dropped.select(F.col(i).alias("_gone"), F.col(k).alias("_key")), "dropped", 1 << 20)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (key == gone["_key"]), "left_anti")


def one_per_row(docs: DataFrame, what: Column, id_col: str = "doc_id") -> DataFrame:
    """Rows alike in id and in what leave one row; texts move only where an id does repeat."""
    if docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs
    name = "what"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, what).dropDuplicates([id_col, name]).drop(name)
