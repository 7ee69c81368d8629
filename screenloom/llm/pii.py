"""Personal data: base patterns plus terms that disclose a protected entity (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, materialise, plain_text

KINDS = ("email", "ip", "card", "phone")
#: As the contract's patterns, with possessive repeats and run starts, so that time stays linear in the text:
#: a match can only start where a run of its first class starts, or where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text holds if a kind can match at all.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BYTE_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
#: A term is a run of letters, with single apostrophes or hyphens inside, that no letter, digit or underscore touches.
LEFT, RIGHT = r"(?<![\p{L}\p{M}\p{N}_])(?<![\p{L}\p{M}]['’-])", r"(?![\p{L}\p{M}\p{N}_])(?!['’-][\p{L}\p{M}])"
TERM = LEFT + r"\p{L}[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++)*+" + RIGHT
TERM_CHARS = (3, 40)
SPAN = "array<struct<start: int, kind: int, stop: int, value: string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a short digit string passes the Luhn check."""
    n = F.length(digits)
    value = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, F.lit(2)).otherwise(F.lit(1)) * F.substring(digits, i, F.lit(1)).cast("int"))
    total = F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(BYTE_PARTS)
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _checker(kind: str) -> Callable[[Column], Column]:
    return lambda s: _passes(kind, s["value"])


def located(text: Column, pattern: Column, kind: Column) -> Column:
    """The matches of pattern with their code point offsets: pieces between matches and the matches, summed up."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    steps = F.arrays_zip(pieces.alias("p"), matches.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        at = acc["at"] + F.length(s["p"])
        stop = at + F.coalesce(F.length(s["m"]), F.lit(0))
        span = F.struct(at.alias("start"), kind.alias("kind"), stop.alias("stop"), s["m"].alias("value"))
        return F.struct(stop.alias("at"), F.when(s["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

    return F.aggregate(steps, start, add)["out"]


def base_spans(text: Column) -> Column:
    """All base matches that pass their checks, by start, then kind as listed."""
    found = []
    for i, kind in enumerate(KINDS):
        spans = F.filter(located(text, F.lit(PATTERNS[kind]), F.lit(i)), _checker(kind))
        found.append(F.when(text.rlike(HINTS[kind]), spans).otherwise(F.expr(f"cast(array() as {SPAN})")))
    return F.array_sort(F.concat(*found))


def render(spans: Column, names: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined."""
    labels = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(labels, s["kind"] + 1), s["start"], s["stop"])), ",")


def without_entities(text: Column, spans: Column) -> Column:
    """text with its base spans blanked: as many code points, and no terms inside an e-mail or number."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.greatest(s["start"] - acc["at"], F.lit(0))
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, gap), F.repeat(F.lit(" "), F.greatest(s["stop"] - F.greatest(s["start"], acc["at"]), F.lit(0))))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, add)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def terms_of(plain: Column) -> Column:
    """The different terms of a text without entities."""
    return F.filter(F.array_distinct(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))), lambda t: F.length(t).between(*TERM_CHARS))


def disclosing_terms(found: DataFrame, texts: DataFrame, support: int, min_disclosure: float, min_share: float) -> DataFrame:
    """(term, entity, share, disclosure): terms that reveal a protected entity.

    found: (text, spans, plain) of texts with base spans; texts: (plain) of all, plain being the text without entities. With probabilities counted over all texts (rows), what a term t tells of an entity e is their pointwise
    mutual information log p(e | t) / p(e), and disclosure is its share of all there is to tell, -log p(e): 1 if the
    term implies the entity, 0 if it says nothing. A term is named if disclosure is at least min_disclosure, share,
    which is p(e | t), at least min_share, and the pair occurs in at least support different texts (so copies of one
    text count once). An entity in every text has nothing to disclose.
    """
    held = found.select("plain", F.xxhash64("text").alias("copy"), F.array_distinct(F.transform(F.filter("spans", lambda s: F.length(s["value"]) > 0), lambda s: F.xxhash64(s["value"]))).alias("entities"))
    of_entity = held.select("copy", F.explode("entities").alias("entity")).groupBy("entity", "copy").agg(F.count("*").alias("n"))
    of_entity = of_entity.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("copies"))
    # No pair occurs in more texts than its entity does.
    often = if_small(of_entity.where(F.col("copies") >= support).select("entity", "n_entity"), "entities")
    own = held.select("plain", "copy", F.explode("entities").alias("entity")).join(often.select("entity"), "entity", "left_semi")
    pairs = own.select("copy", "entity", F.explode(terms_of(F.col("plain"))).alias("term"))
    both = pairs.groupBy("term", "entity", "copy").agg(F.count("*").alias("n")).groupBy("term", "entity").agg(F.sum("n").alias("n_both"), F.count("*").alias("copies"))
    both = materialise(both.where(F.col("copies") >= support).select("term", "entity", "n_both"), "pairs")
    # Only terms of such pairs are counted over all texts.
    asked = if_small(both.select("term").distinct(), "terms", 1 << 18)
    counts = texts.select(F.explode(terms_of(F.col("plain"))).alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_texts"))
    if both.isEmpty():
        counts = asked.select("term", F.lit(0).cast("long").alias("n_texts"))
    both = both.join(counts, "term").join(often, "entity")
    n_all = texts.count()
    share = F.col("n_both") / F.col("n_texts")
    all_of_it = -F.log(F.col("n_entity") / F.lit(n_all))
    told = F.when(all_of_it > 0, (F.log(share) + all_of_it) / all_of_it).otherwise(0.0)
    named = both.select("term", "entity", share.alias("share"), told.alias("disclosure"))
    return named.where((F.col("disclosure") >= min_disclosure) & (F.col("share") >= min_share))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, min_disclosure: float = 0.75, min_share: float = 0.5) -> DataFrame:
    """One row per document: (id, text, spans, all_spans); spans are structs (start, kind, stop, value), code points, end exclusive.

    spans holds the base kinds; all_spans also every word of the text that discloses a protected entity (kind 4,
    "term"). Null texts are empty, long texts are read whole; repeated rows and null ids are rows of their own; an
    empty table gives none; further columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), plain_text(text_col).alias("text"))
    with_base = rows.withColumn("spans", base_spans(F.col("text")))
    plain = with_base.withColumn("plain", without_entities(F.col("text"), F.col("spans")))
    found = materialise(with_base.where(F.size("spans") > 0), "entities")
    found = found.withColumn("plain", without_entities(F.col("text"), F.col("spans")))
    terms = disclosing_terms(found, plain.select("plain"), support, min_disclosure, min_share)
    terms = if_small(terms.select("term").distinct(), "disclosing", 1 << 18)
    if terms.isEmpty():
        return with_base.select("id", "text", "spans", F.col("spans").alias("all_spans"))
    # Only a text's key travels with its words; the text meets its own terms once.
    words = plain.select(F.xxhash64("text").alias("key"), F.explode(terms_of(F.col("plain"))).alias("term"))
    hits = materialise(words.join(terms, "term", "left_semi").groupBy("key").agg(F.collect_set("term").alias("terms")), "hits")
    kind = F.lit(len(KINDS))
    at = lambda t: located(F.col("plain"), F.concat(F.lit(LEFT + r"\Q"), t, F.lit(r"\E" + RIGHT)), kind)
    out = plain.withColumn("key", F.xxhash64("text")).join(hits, "key", "left")
    more = F.when(F.col("terms").isNotNull(), F.flatten(F.transform("terms", at))).otherwise(F.expr(f"cast(array() as {SPAN})"))
    return out.select("id", "text", "spans", F.array_sort(F.concat("spans", more)).alias("all_spans"))


def sanitise(found: DataFrame) -> DataFrame:
    """(id, text) with base spans generalised to [KIND] and disclosing terms removed as [TERM]; overlaps merge into the first."""
    names = F.array(*[F.lit(f"[{n.upper()}]") for n in (*KINDS, "term")])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        clear = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(clear, out).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("all_spans", start, add)
    return found.select("id", F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))).alias("text"))


def of_kind(i: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == i


def all_kinds() -> tuple[str, ...]:
    return (*KINDS, "term")


__all__ = ["all_kinds", "of_kind", "base_spans", "disclosing_terms", "find_personal_data", "render", "sanitise"]
