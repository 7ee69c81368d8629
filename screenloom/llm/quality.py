"""Quality: interpolated modified Kneser-Ney n-grams of bytes trained on trusted text, by sharded count joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, materialise, pack_sorted, plain_text, unpack_sorted

ORDER = 5
CHUNK = 1 << 21
#: Grams are dealt to shards by the leading bits of gram * MIX mod 2**GRAM_BITS, a permutation of all grams.
GRAM_BITS, MIX = 8 * ORDER, 6364137


def grams(data: bytes) -> np.ndarray:
    """The ORDER bytes that end at each byte, as one integer; zero bytes stand before the text."""
    b = np.concatenate((np.zeros(ORDER - 1, np.uint8), np.frombuffer(data, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(8)) | b[k : k + len(data)]
    return out


def _chunks(texts: list[bytes]) -> Iterator[np.ndarray]:
    held, size = [], 0
    for t in texts:
        for at in range(0, len(t), CHUNK):
            part = grams(t[max(0, at - ORDER + 1) : at + CHUNK])
            held.append(part[min(at, ORDER - 1) :])
            size += len(held[-1])
            if size >= CHUNK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n) of all texts (column data, binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _chunks(b.column(0).to_pylist()):
                keys, n = np.unique(part, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("c"))


def _low(col: str, n: int) -> Column:
    return F.col(col).bitwiseAND(F.lit((1 << 8 * n) - 1))


class KneserNey:
    """counts[n]: (gram, c) of order n, raw at the top, numbers of different bytes before below; contexts[n] likewise."""

    def __init__(self, top: DataFrame) -> None:
        self.counts, self.contexts, self.discounts = {}, {}, {}
        level = top
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                level = self.counts[n + 1].groupBy(_low("gram", n).alias("gram")).agg(F.count("*").alias("c"))
            self.counts[n] = level = materialise(level, f"grams{n}")
            of = level.groupBy(F.least("c", F.lit(5)).alias("c")).count().where("c < 5").collect()
            k = [0, *(next((r["count"] for r in of if r["c"] == i), 0) for i in range(1, 5))]
            y = k[1] / (k[1] + 2 * k[2]) if k[1] and k[2] else 0.5
            self.discounts[n] = [min(i, max(0.1, i - (i + 1) * y * k[i + 1] / k[i])) if k[i] else 0.5 for i in range(1, 4)]
            d1, d2, d3 = self.discounts[n]
            mass = F.sum(F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3))
            self.contexts[n] = materialise(level.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("c").alias("total"), mass.alias("mass")), f"contexts{n}")

    def log_probabilities(self, wanted: DataFrame) -> DataFrame:
        """(gram, logp) of distinct grams: each order joins its counts and contexts and falls back on the order below."""
        below = None
        for n in range(1, ORDER + 1):
            need = wanted.select(_low("gram", n).alias("gram")).distinct() if n < ORDER else wanted.select("gram")
            d1, d2, d3 = self.discounts[n]
            c = F.col("c")
            cut = F.when(c.isNull(), 0.0).otherwise(c - F.when(c == 1, d1).when(c == 2, d2).otherwise(d3))
            rows = need.join(self.counts[n], "gram", "left").withColumn("ctx", F.shiftright("gram", 8)).join(self.contexts[n], "ctx", "left")
            if below is None:
                lower = F.lit(1 / 256)
            else:
                rows = rows.withColumn("low", _low("gram", n - 1)).join(below, "low", "left")
                lower = F.col("p")
            p = F.when(F.col("total").isNull(), lower).otherwise((cut + F.col("mass") * lower) / F.col("total"))
            below = rows.select(F.col("gram").alias("low"), p.alias("p"))
        return below.select(F.col("low").alias("gram"), F.ln("p").alias("logp"))


def perplexities(docs: DataFrame, model: KneserNey, id_col: str, text_col: str, keep: tuple[str, ...], batch_bytes: int) -> DataFrame:
    """(id, *keep, n_bytes, perplexity) of every whole text.

    Each batch of documents asks for its distinct grams, shard by shard as sorted packed blobs; a shard joins the
    distinct grams of all batches with the model's counts once and answers every batch. Shards are ranges of mixed
    grams and their number grows with that of the batches, so none holds more than a few batches' worth. No table is
    sent to all tasks.
    """
    total = docs.agg(F.sum(F.octet_length(plain_text(text_col))).alias("n")).first()["n"] or 0
    n_batches = max(1, -(-total // batch_bytes))
    bits = max(7, min(GRAM_BITS, (n_batches // 16).bit_length() + 1))
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), plain_text(text_col)), F.lit(n_batches)).cast("int").alias("batch"), F.col(id_col).alias("id"), *keep, plain_text(text_col).cast("binary").alias("data"))
    shift = np.uint64(GRAM_BITS - bits)
    every = (1 << GRAM_BITS) - 1
    mixed = lambda g: (g * np.uint64(MIX)) & np.uint64(every)

    def distinct(texts: list[bytes]) -> np.ndarray:
        out = np.empty(0, np.uint64)
        for part in _chunks(texts):
            out = np.union1d(out, mixed(part))
        return out

    def shards(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        which = (keys >> shift).astype(np.int64)
        at = np.flatnonzero(np.diff(which, prepend=-1))
        return which[at], np.split(keys, at[1:]) if len(at) else []

    def ask(t: pa.Table) -> pa.Table:
        which, parts = shards(distinct(t.column("data").to_pylist()))
        return pa.table({"shard": pa.array(which, pa.int32()), "batch": pa.array([t.column("batch")[0].as_py()] * len(which), pa.int32()), "keys": pa.array([pack_sorted(p) for p in parts], pa.binary())})

    def gather(t: pa.Table) -> pa.Table:
        out = np.empty(0, np.uint64)
        for x in t.column("keys").to_pylist():
            out = np.union1d(out, unpack_sorted(x))
        back = (out * np.uint64(pow(MIX, -1, every + 1))) & np.uint64(every)
        return pa.table({"gram": pa.array(back.view(np.int64))})

    def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(keys := mixed(known.column("gram").to_numpy().view(np.uint64)))
        keys, logp = keys[order], known.column("logp").to_numpy()[order].astype(np.float32)
        out = [logp[np.searchsorted(keys, unpack_sorted(x))].tobytes() for x in asked.column("keys").to_pylist()]
        return pa.table({"batch": asked.column("batch"), "shard": asked.column("shard"), "logp": pa.array(out, pa.binary())})

    def finish(mine: pa.Table, told: pa.Table) -> pa.Table:
        texts = mine.column("data").to_pylist()
        keys = distinct(texts)
        by = dict(zip(told.column("shard").to_pylist(), told.column("logp").to_pylist(), strict=True))
        logp = np.concatenate([np.empty(0, np.float32), *(np.frombuffer(by[s], np.float32) for s in shards(keys)[0].tolist())])
        nll = [-sum(float(logp[np.searchsorted(keys, mixed(p))].sum(dtype=np.float64)) for p in _chunks([t])) / max(1, len(t)) for t in texts]
        out = mine.select(["id", *keep])
        return out.append_column("n_bytes", pa.array([len(t) for t in texts], pa.int64())).append_column("perplexity", pa.array(np.exp(nll), pa.float64()))

    sent = rows.groupBy("batch").applyInArrow(ask, "shard int, batch int, keys binary")
    wanted = sent.groupBy("shard").applyInArrow(gather, "gram long")
    known = model.log_probabilities(wanted).withColumn("shard", F.shiftright((F.col("gram") * F.lit(MIX)).bitwiseAND(F.lit(every)), GRAM_BITS - bits).cast("int"))
    told = sent.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(reply, "batch int, shard int, logp binary")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("id", *keep)) + ", n_bytes long, perplexity double"
    return rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(finish, schema)


def quality(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, left_out: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", batch_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: (id, lang, n_bytes, perplexity, threshold, keep).

    One in left_out trusted texts (by a hash of the text, so copies stay together) is kept out of the model; it
    counts all others (ids in the first column of trusted_ids). perplexity is per byte; empty and null texts have 1.
    A text is kept if it is at most the quantile of the left-out texts' perplexities in its language, or of all
    left-out texts if the language has none (null is a language of its own). If no trusted text is left out, or all
    are, the model and the quantile take all of them; without trusted texts all are kept. Texts of any length are
    read whole. Repeated rows and null ids are rows of their own; an empty table gives none; further columns are
    ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), plain_text(text_col).alias("text"))
    base = base.withColumn("out", F.pmod(F.xxhash64("text"), F.lit(left_out)) == 0)
    ids = if_small(trusted_ids.select(F.col(trusted_ids.columns[0]).alias("id")).where("id IS NOT NULL").distinct(), "trusted")
    trusted = base.join(ids, "id", "left_semi")
    kinds = {r["out"] for r in trusted.select("out").distinct().collect()}
    texts = trusted.where("NOT out") if len(kinds) == 2 else trusted
    model = KneserNey(count_grams(texts.select(F.col("text").cast("binary").alias("data"))))
    scored = materialise(perplexities(base, model, "id", "text", ("lang", "out"), batch_bytes), "perplexity")
    known = scored.join(ids, "id", "left_semi")
    known = known.where("out") if len(kinds) == 2 else known
    cut = F.percentile_approx("perplexity", quantile, 10000)
    by_lang = known.groupBy("lang").agg(cut.alias("own")).withColumnRenamed("lang", "of_lang")
    overall = known.agg(cut.alias("c")).first()["c"]
    out = scored.join(F.broadcast(by_lang) if by_lang.count() <= 100_000 else by_lang, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    threshold = F.coalesce(F.col("own"), F.lit(overall).cast("double"))
    return out.select("id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("keep"))
