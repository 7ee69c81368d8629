"""Benchmark decontamination by greedy string tiling over a join of shared-token seeds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, materialise, plain_text

WORDS = re.compile(r"[^\W_]+")
BASE = 0x9E3779B97F4A7C15
#: Words whose hash a task remembers.
REMEMBERED = 1 << 19
#: Bits of the seed filter per seed of the benchmark, and its greatest size in bits (8 MB).
FILTER_BITS, MAX_FILTER = 1 << 10, 1 << 26


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def karp_rabin(h: np.ndarray, width: int) -> np.ndarray:
    """Running hashes (mod 2**64) of all runs of width word hashes."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + h[k : n - width + 1 + k]
    return out


def tile(pairs: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length): again and again the longest match of unmarked tokens, at least width long.

    pairs: (item position, doc position) of all equal runs of width tokens. Ties go to the first in the item, then in
    the document.
    """
    pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1] - pairs[:, 0]))]
    i, j = pairs[:, 0], pairs[:, 1]
    if not len(i):
        return []
    used_i, used_j = np.zeros(i.max() + width + 1, np.int64), np.zeros(j.max() + width + 1, np.int64)
    tiles = []
    while len(i):
        # A run of pairs on one diagonal is one longer match.
        at = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1))))
        size = np.diff(np.append(at, len(i)))
        top = at[size == size.max()]
        best = top[np.lexsort((j[top], i[top]))[0]]
        a, b, n = int(i[best]), int(j[best]), int(size.max()) + width - 1
        tiles.append((a, b, n))
        used_i[a : a + n] = 1
        used_j[b : b + n] = 1
        ci, cj = np.concatenate(([0], np.cumsum(used_i))), np.concatenate(([0], np.cumsum(used_j)))
        free = (ci[i + width] == ci[i]) & (cj[j + width] == cj[j])
        i, j = i[free], j[free]
    return tiles


def benchmark_seeds(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(h, seed, item, item_id, n_words, width, at): every run of width words of every test, a shorter test whole.

    A test is a different pair of id and text; item stands for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for item, item_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = WORDS.findall(text.lower())
                own = min(width, len(words))
                for at, h in enumerate(karp_rabin(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), own).view(np.int64).tolist() if words else ()):
                    rows.append((h, " ".join(words[at : at + own]), item, item_id, len(words), own, at))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "seed", "item", "item_id", "n_words", "width", "at"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), plain_text(text_col).alias("text")).distinct()
    item = F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "text").cast("binary")))
    return rows.select(item.alias("item"), "item_id", "text").mapInArrow(run, "h long, seed string, item binary, item_id long, n_words int, width int, at int")


def seed_filter(seeds: DataFrame) -> tuple[int, bytes, list[int]]:
    """(bits, bit map, widths): which hashes, cut to bits bits, any seed has. Its size is bounded for any benchmark."""
    n = max(1, seeds.count())
    size = min(MAX_FILTER, 1 << (n * FILTER_BITS - 1).bit_length())
    cut = F.col("h").bitwiseAND(F.lit(size - 1))
    found = seeds.groupBy(F.shiftright(cut, 3).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), cut.bitwiseAND(7).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(max(1, size >> 3), np.uint8)
    bits[found.column("byte").to_numpy()] = found.column("bits").to_numpy()
    return size, bits.tobytes(), sorted(r["width"] for r in seeds.select("width").distinct().collect())


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 5, min_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out_col: str = "contamination") -> DataFrame:
    """docs with columns (coverage, item_id, tokens, n_tests, contaminated) in a struct named out_col.

    Words are lower-cased runs of letters and digits. Runs of width words of documents (tests shorter than width:
    runs as long as they) are joined with those of the tests; per document and test, the longest match of shared
    seeds is marked, again and again. coverage is the largest share of a test's words that such tiles cover, wherever
    and in whatever order they stand in the text; item_id is that test, the smallest at a tie (null last). A text is
    contaminated if coverage is at least min_coverage for some test; n_tests counts those tests.

    Only seeds that pass a bit map of the benchmark's seeds leave a document, once for equal texts; the map's size
    has a bound for any benchmark. Null and empty texts and tests match nothing; whole texts count; repeated rows,
    null ids and further columns pass through (if docs has a column out_col, the struct's name gets underscores until
    it is free); an empty benchmark leaves every document clean.
    """
    while out_col in docs.columns:
        out_col += "_"
    seeds = materialise(benchmark_seeds(benchmark, width, item_col, item_text), "seeds")
    size, bits, widths = seed_filter(seeds)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, there, low = WordHashes(), np.frombuffer(bits, np.uint8), np.uint64(size - 1)
        for b in batches:
            keys, found = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = WORDS.findall(text.lower())
                h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                hit = []
                for w in widths:
                    cut = karp_rabin(h, w) & low
                    at = np.flatnonzero(there[(cut >> np.uint64(3)).astype(np.int64)] >> (cut & np.uint64(7)).astype(np.uint8) & 1)
                    hit += [(j, " ".join(words[j : j + w])) for j in at.tolist()]
                if hit:
                    keys.append(key)
                    found.append([{"j": j, "seed": s} for j, s in hit])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.struct([("j", pa.int32()), ("seed", pa.string())])))], names=["key", "found"])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs = None, []
        out: list[tuple] = []

        def close() -> None:
            if now:
                covered = sum(t[2] for t in tile(np.concatenate(pairs), now[4]))
                out.append((now[0], now[2], covered / now[3], covered))

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            ij = np.stack([b.column(5).to_numpy(), b.column(6).to_numpy()], axis=1)
            start = 0
            for at, head in enumerate(zip(*cols, strict=True)):
                if head != now:
                    pairs.append(ij[start:at])
                    close()
                    now, pairs, start = head, [], at
            pairs.append(ij[start:])
            if len(out) >= 1 << 14:
                yield _tiled(out)
                out = []
        close()
        yield _tiled(out)

    key = F.unhex(F.md5(plain_text(text_col).cast("binary")))
    mine = docs.select(key.alias("key"), plain_text(text_col).alias("text")).mapInArrow(find, "key binary, found array<struct<j: int, seed: string>>")
    mine = mine.groupBy("key").agg(F.first("found").alias("found")).select("key", F.explode("found").alias("f")).select("key", "f.j", "f.seed")
    # The benchmark's seeds go to every task only if counted small; a seed is the words themselves, so equal is equal.
    pairs = mine.join(if_small(seeds.drop("h"), "seeds-by-word", 1 << 17), "seed").select("key", "item", "item_id", "n_words", "width", F.col("at").alias("i"), "j")
    pairs = pairs.repartition("key", "item").sortWithinPartitions("key", "item")
    each = materialise(pairs.mapInArrow(tiled, "key binary, item_id long, coverage double, tokens long"), "tiles")
    place = Window.partitionBy("key").orderBy(F.desc("coverage"), F.col("item_id").asc_nulls_last())
    n_tests = F.count_if(F.col("coverage") >= min_coverage).over(Window.partitionBy("key"))
    best = each.withColumn("place", F.row_number().over(place)).withColumn("n_tests", n_tests).where("place = 1")
    found = F.struct("coverage", "item_id", "tokens", "n_tests", (F.col("coverage") >= min_coverage).alias("contaminated"))
    best = if_small(best.select(F.col("key").alias("_tiled"), found.alias(out_col)), "contamination", 1 << 18)
    clean = F.struct(F.lit(0.0).alias("coverage"), F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("n_tests"), F.lit(False).alias("contaminated"))
    out = docs.join(best, key == best["_tiled"], "left")
    return out.select(*[docs[c] for c in docs.columns], F.coalesce(best[out_col], clean).alias(out_col))


def _tiled(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * 4
    kinds = (pa.binary(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "item_id", "coverage", "tokens"])
