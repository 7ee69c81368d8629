"""Label by gene sums kept up to date over a stream of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_sums(x: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """(lab, gene_id, s1, s2, nnz) of a streaming x joined with static obs; for output modes update and complete.

    State is one row per label and gene. Cells of a file must not come twice: sums are not idempotent.
    """
    lab = obs.select("cell_id", F.col(label).cast("string").alias("lab"))
    return x.join(lab, "cell_id").groupBy("lab", "gene_id").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.count_if(F.col("value") != 0).alias("nnz"))
