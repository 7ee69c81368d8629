"""Documents to a training mixture: toxicity, exact and near deduplication, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.llm import exact, mix, simhash, tiling, toxic
from screenloom.llm.common import chosen_rows, materialise, one_per_row
from screenloom.llm.queries import TOXIC_AT, table, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the query's threshold. Null and empty texts stay; an empty table stays empty."""
    score = toxic.score(toxicity_model(spark, sf_dir))
    return docs.where(score < TOXIC_AT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of equal texts; rows alike in id and text leave one.

    Rows that share an id, or have none, are documents of their own where their texts differ.
    """
    found = exact.exact_groups(docs)
    norm = exact.normalised("text")
    gone = found.where("NOT kept").select("id", F.xxhash64("text_sha256").alias("key")).distinct()
    return one_per_row(chosen_rows(docs, gone, F.xxhash64(exact.sha256_text(norm))), norm)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group: shingles of five words, Jaccard similarity 0.8 or more.

    Rows that share an id, or have none, are documents of their own where their texts differ; null ids come last in
    their group. Null texts are empty; an empty table stays empty.
    """
    found = simhash.near_copies(docs, width=5, similarity=0.8)
    gone = found.where("NOT kept").select("id", "key").distinct()
    return one_per_row(chosen_rows(docs, gone, simhash.text_key()), simhash.text_key())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to 0.8 or more by tiles of five words. Null and empty texts stay."""
    found = tiling.contamination(docs, table(spark, sf_dir, "benchmark"), width=5, min_coverage=0.8)
    return found.where(~F.col(found.columns[-1])["contaminated"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left; null texts have no words. An empty table stays empty."""
    return mix.mix(docs).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL expresses neither the automata nor the ball hashing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
