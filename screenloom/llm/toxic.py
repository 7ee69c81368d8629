"""Toxicity: Levenshtein automata over a learned lexicon trie, with context windows that tell quotation from abuse."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, materialise, plain_text

TOKEN = re.compile(r"[^\W_]+")
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
#: A doc's features: hits by edits (0, 1, 2) in abuse, then in quotation; each as the bit length of its count.
N_FEATURES = 6
CACHE = 1 << 19
#: Words whose match, and words whose forms, a task remembers.
REMEMBERED, FORMS_OF = 1 << 19, 1 << 15
#: Lengths of the word beginnings that are tried as stems.
STEM = (4, 5, 6, 7)


def edits_allowed(n: int) -> int:
    """Edits within which a word of a term's length counts as its misspelling."""
    return 0 if n < 5 else 1 if n < 10 else 2


class Trie:
    """Terms as a trie; near() walks it with the Levenshtein automaton of a word. A term "stem*" takes any longer word."""

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        self.stems: dict[int, set[str]] = defaultdict(set)
        for t in terms:
            if t.endswith("*"):
                self.stems[len(t) - 1].add(t[:-1])
        terms = [t for t in terms if not t.endswith("*")]
        self.exact = set(terms)
        self.heads: dict[int, set[str]] = defaultdict(set)
        self.tails: dict[int, set[str]] = defaultdict(set)
        self.inner: dict[tuple[int, int], set[str]] = defaultdict(set)
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
            if k := edits_allowed(len(t)):
                # Of k + 1 pieces of a term, k edits leave one untouched, moved by less than k places.
                cut = [len(t) * i // (k + 1) for i in range(k + 2)]
                self.heads[cut[1]].add(t[: cut[1]])
                self.tails[len(t) - cut[k]].add(t[cut[k] :])
                for i in range(1, k):
                    for d in range(1 - k, k):
                        self.inner[cut[i] + d, cut[i + 1] + d].add(t[cut[i] : cut[i + 1]])

    def may_match(self, w: str) -> bool:
        return any(w[:n] in s for n, s in self.heads.items()) or any(w[-n:] in s for n, s in self.tails.items()) or any(w[i:j] in s for (i, j), s in self.inner.items())

    def near(self, w: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits (ties: first by code point), and the edits."""
        if w in self.exact:
            return w, 0
        for n, stems in self.stems.items():
            if n < len(w) and w[:n] in stems:
                return f"{w[:n]}*", 0
        if len(w) < 4 or not self.may_match(w):
            return None
        at: dict[str, int] = defaultdict(int)
        for i, c in enumerate(w):
            at[c] |= 1 << i
        m, found = len(w), []
        start = (1, 3, 7)
        stack = [(self.root, start)]
        while stack:
            node, (r0, r1, r2) = stack.pop()
            for c, child in node.items():
                if not c:
                    k = 0 if r0 >> m & 1 else 1 if r1 >> m & 1 else 2 if r2 >> m & 1 else 3
                    if k <= edits_allowed(len(child)):
                        found.append((k, child))
                    continue
                mask = at.get(c, 0)
                s0 = (r0 & mask) << 1
                s1 = (r1 & mask) << 1 | r0 << 1 | r0 | s0 << 1
                s2 = (r2 & mask) << 1 | r1 << 1 | r1 | s1 << 1
                full = (2 << m) - 1
                if s2 & full:
                    stack.append((child, (s0 & full, s1 & full, s2 & full)))
        if not found:
            return None
        k, term = min(found)
        return term, k


@dataclass
class Model:
    terms: list[str]
    exceptions: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [0.0] * (N_FEATURES + 1))
    window: int = 12

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.trie = model, Trie(model.terms)
        self.clean: set[str] = set()
        self.found: dict[str, tuple[str, int]] = {}

    def match(self, w: str) -> tuple[str, int] | None:
        if w in self.found:
            return self.found[w]
        m = None if w in self.model.exceptions else self.trie.near(w)
        if len(self.clean) + len(self.found) >= REMEMBERED:
            self.clean.clear()
            self.found.clear()
        if m:
            self.found[w] = m
        else:
            self.clean.add(w)
        return m

    def hits(self, text: str) -> list[tuple[str, int, bool]]:
        """(word, edits, quoted) of each occurrence of a term or misspelling."""
        low = text.lower()
        words = {w: m for w in set(TOKEN.findall(low)) - self.clean if (m := self.match(w))}
        if not words:
            return []
        spans = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(low)]
        return [(w, words[w][1], self._quoted(low, spans, i)) for i, (_, _, w) in enumerate(spans) if w in words]

    def _quoted(self, low: str, spans: list[tuple[int, int, str]], i: int) -> bool:
        """Whether a quotation opens before and closes after the word, both within the window of words and its line."""
        left = low[spans[max(0, i - self.model.window)][0] : spans[i][0]].rpartition("\n")[2]
        right = low[spans[i][1] : spans[min(len(spans) - 1, i + self.model.window)][1] + 1].partition("\n")[0]
        for a, b in QUOTES.items():
            inside = left.count(a) % 2 == 1 if a == b else left.rfind(a) > left.rfind(b)
            if inside and b in right:
                return True
        return False

    def features(self, text: str) -> tuple[int, ...]:
        return count_features([(k, q) for _, k, q in self.hits(text)])

    def score(self, text: str | None) -> float:
        x = self.features(text or "")
        z = self.model.weights[0] + sum(w * v for w, v in zip(self.model.weights[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def count_features(hits: list[tuple[int, bool]]) -> tuple[int, ...]:
    n = Counter(3 * q + k for k, q in hits)
    return tuple(n[i].bit_length() for i in range(N_FEATURES))


def fit_logistic(patterns: dict[tuple[int, ...], tuple[int, int]], ridge: float = 0.5) -> list[float]:
    """Weights (bias first) from counts of (rows, positive rows) by feature pattern, by Newton's method."""
    x = np.array([(1, *p) for p in patterns], float).reshape(-1, N_FEATURES + 1)
    n, y = np.array(list(patterns.values()), float).reshape(-1, 2).T
    w = np.zeros(N_FEATURES + 1)
    penalty = np.diag([1e-6] + [ridge] * N_FEATURES)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - n * p) - penalty @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def forms(w: str) -> list[str]:
    """A word and its strict beginnings of STEM lengths, marked by *."""
    return [w, *(f"{w[:n]}*" for n in STEM if n < len(w))]


def learn_lexicon(rows: DataFrame, max_terms: int, min_places: int = 3, min_share: float = 0.7) -> list[str]:
    """Words and stems (inflected words, "stem*") that mark toxic texts, from rows (text, toxic).

    A form's toxic evidence is its number of toxic texts, or of different neighbourhoods (word before, word, word
    after) in them if that is less, so copies of a text count once; its clean evidence the number of clean texts. A
    form passes if the excess over the base rate is too large for any of the forms by chance (Chernoff bound against
    the vocabulary's size). A stem needs at least min_places different words; it replaces the longer stems it covers.
    Words stay beside their stems, since only words are matched with edits. ValueError if more than max_terms pass.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {"clean": Counter(), "bad": Counter()}
        known: dict[str, list[str]] = {}
        for b in batches:
            places: set[tuple[str, int]] = set()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = TOKEN.findall(text.lower())
                if len(known) > FORMS_OF:
                    known.clear()
                own = set(words)
                for w in own:
                    if w not in known:
                        known[w] = forms(w)
                held["bad" if toxic else "clean"].update(set(chain.from_iterable(map(known.__getitem__, own))))
                if toxic:
                    places |= {(w, xxhash.xxh64_intdigest(f"{p} {w} {n}") >> 1) for p, w, n in zip(["", *words], words, [*words[1:], ""])}
            yield _counted([(f, w, p, 0, 0) for w, p in places for f in forms(w)])
            if sum(map(len, held.values())) > CACHE:
                yield from _flushed(held)
        yield from _flushed(held)

    counted = rows.select(plain_text("text").alias("text"), "toxic").mapInArrow(count, "form string, word string, place long, clean long, bad long")
    each = counted.groupBy("form", "word", "place").agg(F.sum("clean").alias("c"), F.sum("bad").alias("t"))
    each = each.groupBy("form", "word").agg(F.count("place").alias("places"), F.sum("c").alias("c"), F.sum("t").alias("t"))
    table = each.groupBy("form").agg(F.sum("places").alias("places"), F.count("word").alias("words"), F.sum("c").alias("c"), F.sum("t").alias("t"))
    table = materialise(table, "forms")
    both = table.where(F.col("places") >= min_places).where(~F.endswith("form", F.lit("*")) | (F.col("words") >= min_places))
    both = both.select("form", F.least("places", "t").cast("double").alias("s"), F.col("c").cast("double").alias("c"))
    base = rows.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"]
    n_forms = table.count()
    if not base or base >= 1 or not n_forms:
        return []
    n, share = F.col("s") + F.col("c"), F.col("s") / (F.col("s") + F.col("c"))
    rest = F.when(F.col("c") > 0, (F.col("c") / n) * F.log((F.col("c") / n) / (1 - base))).otherwise(0.0)
    gain = n * (share * F.log(share / base) + rest)
    found = bounded(both.where((share >= min_share) & (gain >= math.log(n_forms))).select("form"), max_terms)
    stems = {f[:-1] for f in found if f.endswith("*")}
    covered = lambda f: any(f[:i] in stems for i in range(1, len(f.rstrip("*"))))
    return sorted(f for f in found if not f.endswith("*") or not covered(f))


def bounded(words: DataFrame, most: int) -> set[str]:
    """All words of a one-column table; ValueError if there are more than most, so that none is left out."""
    found = {r[0] for r in words.limit(most + 1).collect()}
    if len(found) > most:
        raise ValueError(f"more than {most} words")
    return found


def _flushed(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    yield _counted([(f, None, None, n, 0) for f, n in held["clean"].items()] + [(f, None, None, 0, n) for f, n in held["bad"].items()])
    for c in held.values():
        c.clear()


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["form", "word", "place", "clean", "bad"])


def fit(docs: DataFrame, labels: DataFrame, max_terms: int = 200_000, window: int = 12, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from every labelled document; ValueError if the lexicon or the list of harmless near misses exceeds max_terms.

    Labels, ids and other columns decide nothing but the fit. Null labels and ids are left out; a repeated label row
    counts again. Without labelled rows the model scores every text 0.5. Long texts are read whole; further columns
    are ignored, whatever their names.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IS NOT NULL")
    rows = docs.select(F.col(id_col).alias("id"), plain_text(text_col).alias("text")).join(if_small(marked, "marked"), "id").select("text", "toxic")
    model = Model(learn_lexicon(rows, max_terms), window=window)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            out = [[{"w": w, "k": k, "q": q} for w, k, q in scorer.hits(t)] for t in b.column(0).to_pylist()]
            kind = pa.list_(pa.struct([("w", pa.string()), ("k", pa.int32()), ("q", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([pa.array(out, kind), b.column(1)], names=["hits", "toxic"])

    found = materialise(rows.mapInArrow(find, "hits array<struct<w: string, k: int, q: boolean>>, toxic int"), "hits")
    near = found.select("toxic", F.explode(F.array_distinct(F.transform(F.filter("hits", lambda h: h["k"] > 0), lambda h: h["w"]))).alias("w"))
    harmless = near.groupBy("w").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("bad")).where("clean > bad")
    exceptions = frozenset(bounded(harmless.select("w"), max_terms))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for hits, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[count_features([(h["k"], h["q"]) for h in hits if h["w"] not in exceptions]), toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([list(x) for x, _ in n], pa.list_(pa.int32())), pa.array(list(n.values()), pa.int64()), pa.array([c * t for (_, t), c in n.items()], pa.int64())], names=["x", "n", "y"])

    table = found.mapInArrow(patterns, "x array<int>, n long, y long").groupBy("x").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()
    if table:
        model.weights = fit_logistic({tuple(r["x"]): (r["n"], r["y"]) for r in table})
    model.exceptions = exceptions
    return model


def score(model: Model, text_col: str = "text") -> Column:
    """0 to 1 for each whole text, higher for toxic; null and empty texts score as texts without hits."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for s in parts:
            yield s.map(scorer.score, na_action=None).astype("float64")

    return run(F.col(text_col))
