"""Removal of repeated word passages by prefix-partitioned suffix trees.

The suffixes of all documents, cut at the window length, are split by variable-length prefixes into groups that fit
one task: the first word, and for common first words the whole window. Each batch of documents sorts its suffixes by
prefix doubling over its own exact word numbers (those whose window shares its hash with another; the rest repeat
nothing); suffixes that agree in a full window are the leaves of one deep internal node. A group merges the nodes of all batches: 32-bit edge tags first find nodes with leaves in more than one
batch, then one leaf a batch and node travels with a 128-bit key. The first leaf of a node stays and the others are
repeats. Neighbouring repeats with neighbouring first leaves join into maximal repeats, whose words are fetched from
where the first leaf lies and compared before anything goes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count as numbers_from

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order_batches, pack_sorted, plain_text, unpack_sorted

CELLS = 1 << 16
#: Different words that a task counts before it adds their counts up.
HELD_WORDS = 1 << 16
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
EMPTY_U64 = np.empty(0, np.uint64)


def _word_keys(words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the words' 128-bit keys, (low, high)."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2).astype(np.uint64)
    return halves[:, 1], halves[:, 0]


def _rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of all runs of width values."""
    n = len(values)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[:n])))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64))))
    return (sums[width:] - sums[:-width]) * back[: n - width + 1]


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (first[i], second[i]); where second has ended, the text has too and the rank is not used."""
    n = min(len(first), len(second))
    return np.unique(first[:n] * (second.max(initial=0) + 1) + second[:n], return_inverse=True)[1]


class Batch:
    """The words of a batch's documents in order of id (nulls first, then text)."""

    def __init__(self, table: pa.Table) -> None:
        ids, data = table.column("id").to_pylist(), table.column("data").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, data[i]))
        self.ids = [ids[i] for i in order]
        self.words: list[bytes] = []
        sizes = []
        for i in order:
            own = data[i].split()
            sizes.append(len(own))
            self.words += own
        self.ends = np.cumsum(np.array(sizes, dtype=np.int64))
        self.sizes = np.array(sizes, dtype=np.int64)

    def hash(self, window: int) -> Batch:
        number = defaultdict(numbers_from().__next__)
        at = np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))
        low, high = (x[at] for x in _word_keys(number))
        n = len(low)
        left = np.repeat(self.ends, self.sizes) - np.arange(n)
        self.starts = np.flatnonzero(left >= window)
        if not len(self.starts):
            self.low = self.high = self.cell = self.prefix = EMPTY_U64
            return self
        self.low, self.high = (_rolling(v, window, b)[self.starts] for v, b in zip((low, high), BASES, strict=True))
        self.cell = (low >> np.uint64(48)).astype(np.int64)[self.starts]
        self.prefix = self.high >> np.uint64(32)
        self.numbers = at
        return self

    def repeated(self, window: int) -> np.ndarray:
        """For each suffix in starts whether its first window words also start earlier in the batch, by prefix doubling (exact).

        Suffixes whose key no other has cannot share a node and are not doubled.
        """
        out = np.zeros(len(self.starts), bool)
        ranked = np.sort(self.low)
        shared = ranked[1:][ranked[1:] == ranked[:-1]]
        if not len(shared):
            return out
        asked = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, self.low), len(shared) - 1)] == self.low)
        # The words that their windows cover, each window in one piece.
        edge = np.zeros(len(self.numbers) + 1, np.int64)
        np.add.at(edge, self.starts[asked], 1)
        np.add.at(edge, self.starts[asked] + window, -1)
        covered = np.cumsum(edge)[:-1] > 0
        starts = (np.cumsum(covered) - 1)[self.starts[asked]]
        rank, width, node, done = self.numbers[covered], 1, None, 0
        while True:
            if window & width:
                node = rank if node is None else _paired(node, rank[done:])
                done += width
            if 2 * width > window:
                break
            rank = _paired(rank, rank[width:])
            width *= 2
        # The suffixes of a node in order of their place: the first is its leaf here, the others repeat it.
        out[asked] = True
        out[asked[np.unique(node[starts], return_index=True)[1]]] = False
        return out

    def keys(self, groups: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """group << 32 | tag of every window."""
        base, parts = groups
        group = base[self.cell] + (self.prefix % parts[self.cell])
        tag = (self.low * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
        return (group << np.uint64(32)) | tag


def suffix_groups(docs: DataFrame, text_col: str, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of CELLS cells of first words: its first group, and into how many groups longer prefixes split it.

    Counts every word of every document; the driver holds CELLS counts, however large the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(CELLS, np.int64), Counter()

        def settle() -> None:
            np.add.at(total, (_word_keys(held)[0] >> np.uint64(48)).astype(np.int64), np.fromiter(held.values(), np.int64, len(held)))
            held.clear()

        for b in batches:
            for data in b.column(0).to_pylist():
                held.update(data.split())
                if len(held) > HELD_WORDS:
                    settle()
        settle()
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], names=["cell", "n"])

    rows = docs.select(plain_text(text_col).cast("binary").alias("data")).mapInArrow(count, "cell int, n long")
    sizes = np.zeros(CELLS, np.int64)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    base, parts = np.zeros(CELLS, np.uint64), np.ones(CELLS, np.uint64)
    group = filled = 0
    for c, n in enumerate(sizes.tolist()):
        k = -(-2 * n // capacity) if n > capacity else 1
        if filled and (filled + n > capacity or k > 1):
            group, filled = group + 1, 0
        base[c], parts[c] = group, k
        if k > 1:
            group += k
        else:
            filled += n
    return base, parts


def _packed_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _packed(values: np.ndarray) -> bytes:
    return _packed_bytes(values.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4").astype(np.int64)


def _split(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    group = (keys >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(group, prepend=-1))
    return group[at], np.split(np.arange(len(keys)), at[1:]) if len(at) else []


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20, capacity: int = 1 << 21) -> DataFrame:
    """One row per document: (id, n_words, n_removed, removed, kept_text).

    A word goes if some window of window consecutive words covers it whose word sequence also starts earlier: in a
    document of smaller id, or earlier in the same one. removed lists the ranges [start, end) of words that go. Null
    and empty texts have no words; shorter texts than a window stay whole (words joined by one space). Rows that
    repeat an id count as documents of their own, in order of their text; null ids come first. Long texts are read
    whole, within one batch. An empty table gives no rows; further columns of docs are ignored, whatever their names.
    Passages with one key whose words differ stop the run; none is taken for a repeat.
    """
    groups = suffix_groups(docs, text_col, capacity)
    rows = in_order_batches(docs, id_col, text_col, batch_bytes)
    low32 = np.uint64(0xFFFFFFFF)

    def tags(t: pa.Table) -> pa.Table:
        # Sorted, not np.unique: that goes through a table of hashes, which takes many times as long here.
        keys = np.sort(Batch(t).hash(window).keys(groups))
        keys = keys[np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1]))]
        owner, at = _split(keys)
        blobs = [pack_sorted(keys[i] & low32) for i in at]
        return pa.table({"grp": pa.array(owner, pa.int64()), "batch": pa.array([t.column("batch")[0].as_py()] * len(owner), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        each = [unpack_sorted(x) for x in t.column("blob").to_pylist()]
        key = np.sort((np.concatenate(each) << np.uint64(32)) | np.repeat(np.arange(len(each), dtype=np.uint64), [len(x) for x in each]))
        tag = key >> np.uint64(32)
        same = np.concatenate(([False], tag[1:] == tag[:-1], [False]))
        hit = same[1:] | same[:-1]
        tag, whose = tag[hit], (key[hit] & low32).astype(np.int64)
        batches = t.column("batch").to_pylist()
        out = [(batches[w], pack_sorted(tag[whose == w])) for w in np.unique(whose).tolist()]
        return pa.table({"batch": pa.array([b for b, _ in out], pa.int32()), "grp": pa.array([t.column("grp")[0].as_py()] * len(out), pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    def leaves(mine: pa.Table, told: pa.Table) -> pa.Table:
        """Leaves that repeat in this batch are settled (grp null); the first of nodes that another batch may hold too go to their group."""
        out: list[tuple[int | None, bytes, bytes]] = []
        if mine.num_rows:
            b = Batch(mine).hash(window)
            keys, later = b.keys(groups), b.repeated(window)
            wanted = np.sort(np.concatenate([EMPTY_U64, *(unpack_sorted(x) | (np.uint64(g) << np.uint64(32)) for g, x in zip(told.column("grp").to_pylist(), told.column("blob").to_pylist(), strict=True))]))
            met = np.zeros(len(keys), bool)
            if len(wanted):
                met = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys
            out.append((None, pack_sorted(b.starts[later].astype(np.uint64)), b""))
            at = np.flatnonzero(met & ~later)
            at = at[np.argsort(keys[at], kind="stable")]
            for g, i in zip(*_split(keys[at]), strict=True):
                i = np.sort(at[i])
                out.append((int(g), pack_sorted(b.starts[i].astype(np.uint64)), b.low[i].tobytes() + b.high[i].tobytes()))
        who = mine.column("batch")[0].as_py() if mine.num_rows else 0
        return pa.table({"grp": pa.array([g for g, _, _ in out], pa.int64()), "batch": pa.array([who] * len(out), pa.int32()), "at": pa.array([x for _, x, _ in out], pa.binary()), "node": pa.array([x for _, _, x in out], pa.binary())})

    def settle(t: pa.Table) -> pa.Table:
        """(batch, at, home, first): later leaves of a batch, and the batch and places of their nodes' first leaves."""
        none = {"batch": pa.array([], pa.int32()), "at": pa.array([], pa.binary()), "home": pa.array([], pa.binary()), "first": pa.array([], pa.binary())}
        if t.column("grp")[0].as_py() is None:
            k = t.num_rows
            return pa.table({"batch": t.column("batch"), "at": t.column("at"), "home": pa.nulls(k, pa.binary()), "first": pa.nulls(k, pa.binary())})
        batch = np.array(t.column("batch").to_pylist(), np.int64)
        at = [unpack_sorted(x) for x in t.column("at").to_pylist()]
        node = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in t.column("node").to_pylist()]
        whose = np.repeat(np.arange(len(at)), [len(x) for x in at])
        low, high, place = np.concatenate([x[0] for x in node]), np.concatenate([x[1] for x in node]), np.concatenate(at)
        by = np.lexsort((batch[whose], high, low))
        low, high, place, whose = low[by], high[by], place[by], whose[by]
        new = np.concatenate((low[:1] == low[:1], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else by
        later = np.flatnonzero(~new)
        later = later[np.lexsort((place[later], whose[later]))]
        cuts = np.flatnonzero(np.diff(whose[later], prepend=-1))
        if not len(cuts):
            return pa.table(none)
        rows = []
        for i in np.split(later, cuts[1:]):
            rows.append((int(batch[whose[i[0]]]), pack_sorted(place[i]), _packed(batch[whose[head[i]]].astype("<u4")), _packed(place[head[i]].astype("<u4"))))
        return pa.table({c: pa.array([r[k] for r in rows], none[c].type) for k, c in enumerate(none)})

    def repeats(t: pa.Table) -> pa.Table:
        """(home, batch, first, at, n): maximal repeats, n windows from at in batch as from first in home."""
        held = [x for x in zip(*(t.column(c).to_pylist() for c in ("at", "home", "first")), strict=True) if x[1] is not None]
        at = np.concatenate([EMPTY_U64, *(unpack_sorted(a) for a, _, _ in held)]).astype(np.int64)
        home, first = (np.concatenate([np.empty(0, np.int64), *(_unpacked(x[k]) for x in held)]) for k in (1, 2))
        by = np.argsort(at, kind="stable")
        at, home, first = at[by], home[by], first[by]
        new = np.flatnonzero(np.concatenate((at[:1] == at[:1], (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1] + 1) | (home[1:] != home[:-1]))))
        n = np.diff(np.append(new, len(at)))
        order = np.argsort(home[new], kind="stable")
        new, n = new[order], n[order]
        cuts = np.flatnonzero(np.diff(home[new], prepend=-1))
        rows = [(int(home[i[0]]), _packed(first[i].astype("<u4")), _packed(at[i].astype("<u4")), _packed(k.astype("<u4"))) for i, k in zip(np.split(new, cuts[1:]), np.split(n, cuts[1:]), strict=True)] if len(cuts) else []
        who = [t.column("batch")[0].as_py()] * len(rows)
        return pa.table({"home": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array(who, pa.int32()), **{c: pa.array([r[k + 1] for r in rows], pa.binary()) for k, c in enumerate(("first", "at", "n"))}})

    def fetch(mine: pa.Table, asked: pa.Table) -> pa.Table:
        """The words of the asked places, one joined text a batch that asks."""
        out = []
        if mine.num_rows and asked.num_rows:
            words = Batch(mine).words
            for first, n in zip(asked.column("first").to_pylist(), asked.column("n").to_pylist(), strict=True):
                spans = zip(_unpacked(first).tolist(), _unpacked(n).tolist(), strict=True)
                out.append(_packed_bytes(b"\n".join(b" ".join(words[i : i + k + window - 1]) for i, k in spans)))
        return pa.table({"batch": asked.column("batch").slice(0, len(out)), "at": asked.column("at").slice(0, len(out)), "home": asked.column("n").slice(0, len(out)), "first": pa.array(out, pa.binary())})

    def cut(mine: pa.Table, told: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "removed": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_text": pa.array([], pa.string())})
        b = Batch(mine)
        edge = np.zeros(len(b.words) + 1, np.int64)
        for at, n, text in zip(*(told.column(c).to_pylist() for c in ("at", "home", "first")), strict=True):
            if text is None:
                at = unpack_sorted(at).astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                continue
            at, n = _unpacked(at), _unpacked(n) + window - 1
            spans = zip(at.tolist(), n.tolist(), strict=True)
            if b"\n".join(b" ".join(b.words[i : i + k]) for i, k in spans) != zstandard.ZstdDecompressor().decompress(text):
                raise RuntimeError("two different passages share a 128-bit key")
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
        gone = np.cumsum(edge)[:-1] > 0
        n_removed, spans, texts = [], [], []
        for start, end in zip((b.ends - b.sizes).tolist(), b.ends.tolist(), strict=True):
            own, words = gone[start:end], b.words[start:end]
            n = int(own.sum())
            n_removed.append(n)
            turn = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)) if n else ()
            spans.append([{"start": int(i), "end": int(j)} for i, j in zip(turn[::2], turn[1::2], strict=True)])
            texts.append(b" ".join(words if not n else [w for w, g in zip(words, own.tolist(), strict=True) if not g]))
        return pa.table({"id": pa.array(b.ids, pa.int64()), "n_words": pa.array(b.sizes), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

    sent = rows.groupBy("batch").applyInArrow(tags, "grp long, batch int, blob binary")
    told = sent.groupBy("grp").applyInArrow(meet, "batch int, grp long, blob binary")
    found = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(leaves, "grp long, batch int, at binary, node binary")
    # Settled rows of each batch keep a key of their own; they'd else meet in one group.
    own = F.when(F.col("grp").isNull(), -1 - F.col("batch")).otherwise(F.col("grp"))
    settled = found.groupBy(own.alias("key")).applyInArrow(settle, "batch int, at binary, home binary, first binary")
    asked = settled.where("home IS NOT NULL").groupBy("batch").applyInArrow(repeats, "home int, batch int, first binary, at binary, n binary")
    fetched = rows.groupBy("batch").cogroup(asked.groupBy("home")).applyInArrow(fetch, "batch int, at binary, home binary, first binary")
    # One plan: the shuffles of texts and leaves are made once and read again.
    told = settled.where("home IS NULL").unionByName(fetched)
    return rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(cut, "id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string")
