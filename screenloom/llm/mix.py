"""Mixing of sources to target weights by a low-discrepancy schedule over shuffled equal-token blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, plain_text, searchsorted

#: Slots that are ranked together, and the digits of the digest that buckets of documents share.
CHUNK, DIGITS = 1 << 16, 5


@dataclass(frozen=True)
class Share:
    source: str | None
    size: int
    target: float
    words: int


def targets(sizes: dict[str | None, int], weights: tuple[int, ...], cap: int) -> list[Share]:
    """Sources by code point, null last, weighed cyclically; targets share the total, none above cap times its size.

    What a capped source leaves is shared out again by weight among the others until none is above its cap.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_ = sum(sizes.values()), list(names)
    got: dict[str | None, float] = {}
    while open_:
        rest, w = total - sum(cap * sizes[s] for s in got), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / w > cap * sizes[s]]
        if not over:
            return [Share(s, sizes[s], float(got[s]) if s in got else rest * weight[s] / w, int((got[s] if s in got else rest * weight[s] / w) + 0.5)) for s in names]
        got |= {s: float(cap * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in got]
    return [Share(s, sizes[s], got[s], int(got[s])) for s in names]


def reversed_bits(t: Column, bits: int) -> Column:
    """The low bits of t in reverse order: times 2**-bits, the t-th van der Corput point."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(t, i).bitwiseAND(F.lit(1)), bits - 1 - i))
    return out


def schedule(spark: SparkSession, first: list[int], n_slots: int) -> DataFrame:
    """(line, rank, slot): slot reads the rank-th (from 0) block of a line; lines own first[i] to first[i + 1] - 1 of the cells.

    The first 2**k van der Corput points, 2**k >= n_slots, meet each of 2**k cells once; those under n_slots are dealt
    through the cumulative quotas to the lines. So every line gets its quota of slots exactly, and about its share of
    every prefix.
    """
    bits = max(0, (n_slots - 1).bit_length())
    cell = reversed_bits(F.col("id"), bits)
    points = spark.range(1 << bits).select(F.col("id").alias("slot"), cell.alias("cell")).where(F.col("cell") < n_slots)
    points = points.select("slot", searchsorted(F.col("cell"), first[1:]).alias("line"), F.shiftright("slot", CHUNK.bit_length() - 1).alias("chunk"))
    earlier = Window.partitionBy("line").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = points.groupBy("line", "chunk").agg(F.count("*").alias("n"))
    counts = materialise(counts.select("line", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "ranks")
    inside = F.row_number().over(Window.partitionBy("line", "chunk").orderBy("slot"))
    return points.withColumn("inside", inside).join(counts, ["line", "chunk"]).select("line", (F.col("before") + F.col("inside") - 1).alias("rank"), "slot")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 100_000) -> DataFrame:
    """One row per document: (id, source, size, source_size, target, taken, first_slot).

    size counts the words of the whole text (null: 0). Each source's documents, shuffled by a digest of id and text,
    make one stream of words cut into blocks; van der Corput points through the cumulative quotas deal slots to
    sources, and the r-th slot of a source reads its block r modulo the number of blocks. first_slot is the place in
    the schedule where a document's first word is first read (null: never). A source's slots add up to its target,
    rounded to a word, so no document is read more than cap times. Sources with no words and empty tables take
    nothing; null ids and repeated rows are documents of their own (rows alike in id and text are interchangeable);
    further columns are ignored, whatever their names. The table of sources must have at most max_sources rows: it is
    planned on the driver.
    """
    spark = docs.sparkSession
    size = F.regexp_count(plain_text(text_col), F.lit(WORD)).cast("long")
    order = F.md5(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(plain_text(text_col).cast("binary"))).cast("binary"))
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), order.alias("order")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    shares = targets({r["source"]: r["size"] for r in per_source}, weights, cap)
    n_rows, plan, n_slots = sum(r["n"] for r in per_source), [], 0
    for i, s in enumerate(shares):
        blocks = -(-s.size // block)
        rest = s.words % s.size if s.size else 0
        slots = (s.words // s.size if s.size else 0) * blocks + -(-rest // block)
        plan.append((i, s.source, s.size, s.target, n_slots, slots, max(1, blocks), rest - (-(-rest // block) - 1) * block if rest else 0))
        n_slots += slots
    table = spark.createDataFrame(plan or [], "src int, source string, source_size long, target double, first long, slots long, blocks long, last long")
    sizes = table.select("src", "source", "source_size", "target").withColumnRenamed("source", "name")
    rows = rows.join(sizes, F.col("source").eqNullSafe(F.col("name"))).drop("name")

    # Stream offsets: sums within buckets of the shuffled order, then over the buckets of a source (at most 16**DIGITS).
    digits = max(1, min(DIGITS, len(f"{n_rows // 1024:x}")))
    rows = rows.withColumn("bucket", F.substring("order", 1, digits))
    real = rows.where("size > 0")
    inside = Window.partitionBy("src", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(real.groupBy("src", "bucket").agg(F.sum("size").alias("all")).select("src", "bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base")), "offsets")
    placed = real.withColumn("upto", F.sum("size").over(inside)).join(bases, ["src", "bucket"]).withColumn("b", F.col("base") + F.col("upto")).withColumn("a", F.col("b") - F.col("size"))
    B = F.lit(block)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / B), F.floor((F.col("b") - 1) / B))))
    pieces = pieces.withColumn("lo", F.greatest("a", F.col("block") * B) - F.col("block") * B).withColumn("hi", F.least(F.col("b"), (F.col("block") + 1) * B) - F.col("block") * B)

    lines = [p for p in plan if p[5]]
    quota = spark.createDataFrame([(i, p[0], p[5], p[6], p[7]) for i, p in enumerate(lines)], "line int, src int, slots long, blocks long, last long")
    slots = schedule(spark, [p[4] for p in lines], n_slots).join(quota, "line")
    cut = (F.col("last") > 0) & (F.col("rank") == F.col("slots") - 1)
    uses = slots.groupBy("src", (F.col("rank") % F.col("blocks")).alias("block")).agg(
        F.count_if(~cut).alias("whole"), F.coalesce(F.max(F.when(cut, F.col("last"))), F.lit(0)).alias("part"),
        F.min(F.when(~cut, F.col("slot"))).alias("whole_slot"), F.min(F.when(cut, F.col("slot"))).alias("part_slot"))
    part = F.greatest(F.lit(0), F.least("hi", "part") - F.col("lo"))
    met = F.least("whole_slot", F.when(F.col("part") > F.col("lo"), F.col("part_slot")))
    head = F.floor(F.col("a") / B) == F.col("block")
    read = pieces.join(uses, ["src", "block"], "left").groupBy("src", "id", "a", "size").agg(F.sum(F.coalesce(F.col("whole") * (F.col("hi") - F.col("lo")) + part, F.lit(0))).alias("taken"), F.min(F.when(head, met)).alias("first_slot"))
    empty = rows.where("size = 0").select("src", "id", F.lit(0).cast("long").alias("a"), "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    back = table.select("src", "source", "source_size", "target")
    return read.unionByName(empty).join(back, "src").select("id", "source", "size", "source_size", "target", "taken", "first_slot")
