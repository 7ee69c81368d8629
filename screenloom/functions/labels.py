"""Clean-up and detection of labels, gene names and metadata columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that mean a control, a label column or a gene column, and accession prefixes.
CONTROL_EXACT = ("ctrl", "control", "nontarget", "non-target", "non_target")
CONTROL_ALIASES = ("ntc", "nt", "non-targeting", "nontargeting", "non_targeting", "scramble", "scrambled", "neg", "negative", "negative_control", "safe-targeting", "unperturbed")
LABEL_COLUMNS = ("perturbation", "perturbations", "gene_target", "target_gene", "target", "guide", "guide_identity", "condition", "treatment", "label")
GENE_COLUMNS = ("gene_symbol", "gene_symbols", "gene_name", "gene_names", "symbol", "feature_name", "gene")
ACCESSIONS = ("ENS", "FBG", "WBG", "AT1", "AT2", "AT3", "AT4", "AT5")


def control_label(obs: DataFrame, label: str, control: str | None = None, order: str = "cell_id") -> str:
    """The control's label: as given, else the first label in cell order of the first tier that has one.

    Tiers: exact known names; a known name inside; both "non" and "target" inside; known aliases. ValueError if none.
    """
    if control is not None:
        return control
    low = F.lower(F.col(label).cast("string"))
    tiers = [low.isin(*CONTROL_EXACT), F.greatest(*[F.contains(low, F.lit(n)) for n in CONTROL_EXACT]), F.contains(low, F.lit("non")) & F.contains(low, F.lit("target")), low.isin(*CONTROL_ALIASES)]
    row = obs.agg(*[F.min_by(F.col(label).cast("string"), F.when(t, F.col(order))).alias(f"t{i}") for i, t in enumerate(tiers)], *[F.max(t.cast("int")).alias(f"h{i}") for i, t in enumerate(tiers)]).first()
    for i in range(len(tiers)):
        if row[f"h{i}"]:
            return row[f"t{i}"]
    raise ValueError(f"no control label in column {label}")


def candidates(obs: DataFrame, label: str, control: str, chosen: list[str] | None = None) -> list[str]:
    """Labels to test in order of first cell: all but the control, or the chosen ones (unknown: ValueError)."""
    rows = obs.groupBy(F.col(label).cast("string").alias("l")).agg(F.min("cell_id").alias("first")).orderBy("first").collect()
    have = [r["l"] for r in rows if r["l"] is not None]
    if control not in have:
        raise ValueError(f"control {control} has no cells")
    if chosen is None:
        return [c for c in have if c != control]
    want = [str(c) for c in chosen if str(c) != control]
    if unknown := [c for c in want if c not in have]:
        raise ValueError(f"unknown labels {unknown}")
    if not want:
        raise ValueError("no label left to test")
    return want


def clean_label(c: Column, prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), suffix_regex: str | None = None, aliases: tuple[str, ...] = CONTROL_EXACT + CONTROL_ALIASES, canonical: str = "NTC") -> Column:
    """Prefixes, then suffixes, then the regex go; then any control alias, whatever its case, becomes canonical."""
    for p in prefixes:
        c = F.regexp_replace(c, "^" + re.escape(p), "")
    for s in suffixes:
        c = F.regexp_replace(c, re.escape(s) + "$", "")
    if suffix_regex:
        c = F.regexp_replace(c, suffix_regex, "")
    return F.when(F.lower(c).isin(*[a.lower() for a in aliases]), canonical).otherwise(c)


def clean_gene(c: Column) -> Column:
    """Version suffix off, mitochondrial prefix in upper case."""
    return F.regexp_replace(F.regexp_replace(c, r"\.\d+$", ""), "^mt-", "MT-")


def map_genes(var: DataFrame, mapping: DataFrame, column: str, unmapped: str = "keep") -> DataFrame:
    """column replaced by mapping (id, symbol); unmapped names are kept, kept with a count on request, or an error."""
    pair = mapping.toDF("_id", "_symbol")
    out = var.join(pair, F.col(column) == F.col("_id"), "left")
    if unmapped == "error" and not out.where("_symbol IS NULL").isEmpty():
        raise ValueError("genes without a symbol")
    return out.withColumn(column, F.coalesce("_symbol", column)).drop("_id", "_symbol")


def gene_names(var: DataFrame, column: str | None = None, index: str = "gene_name") -> DataFrame:
    """(gene_id, gene): the column's names, or the index; a missing "gene_symbols" falls back on the index.

    ValueError if there are no genes, the column is missing, or most names are accessions.
    """
    if column is not None and column not in var.columns and column != "gene_symbols":
        raise ValueError(f"no column {column}")
    name = F.col(column if column in var.columns else index).cast("string")
    out = var.select("gene_id", name.alias("gene"))
    share = out.agg(F.avg(F.upper(F.substring("gene", 1, 3)).isin(*ACCESSIONS).cast("double")).alias("s")).first()["s"]
    if share is None or share > 0.5:
        raise ValueError("gene names are missing or accessions, not symbols")
    return out


def detect_label_column(obs: DataFrame, skip: tuple[str, ...] = ("cell_id", "cell_name")) -> str | None:
    """Best scored column: +3 known name, +2 text, +1 for 2 to 5000 values, +2 a control among them; none above 0: None."""
    cols = [c for c in obs.columns if c not in skip]
    if not cols:
        return None
    kinds = dict(obs.dtypes)
    low = lambda c: F.lower(F.col(c).cast("string"))
    row = obs.agg(*[F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(cols)], *[F.max(low(c).isin(*CONTROL_EXACT, *CONTROL_ALIASES).cast("int")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    score = [3 * (c.lower() in LABEL_COLUMNS) + 2 * (kinds[c] == "string") + (2 <= row[f"n{i}"] <= 5000) + 2 * (row[f"c{i}"] or 0) for i, c in enumerate(cols)]
    best = max(range(len(cols)), key=lambda i: (score[i], -i))
    return cols[best] if score[best] > 0 else None


def detect_gene_column(var: DataFrame, skip: tuple[str, ...] = ("gene_id",)) -> str | None:
    """Best scored text column: +3 known name, +2 mostly no accessions, +1 none at all."""
    cols = [c for c, t in var.dtypes if c not in skip and t == "string"]
    if not cols:
        return None
    row = var.agg(*[F.avg(F.upper(F.substring(c, 1, 3)).isin(*ACCESSIONS).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    share = [1.0 if row[f"s{i}"] is None else row[f"s{i}"] for i in range(len(cols))]
    score = [3 * (c.lower() in GENE_COLUMNS) + 2 * (share[i] <= 0.5) + (share[i] == 0) for i, c in enumerate(cols)]
    best = max(range(len(cols)), key=lambda i: (score[i], -i))
    return cols[best] if score[best] > 0 else None


def infer_columns(obs: DataFrame, var: DataFrame) -> dict[str, str | None]:
    return {"perturbation_column": detect_label_column(obs), "gene_name_column": detect_gene_column(var)}
