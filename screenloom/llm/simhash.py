"""SimHash near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, materialise, pack_sorted, packed_count, plain_text, unpack_sorted
from .graph import connected_components, least_reachable

SEED = 42
#: Low bits of a variant's tag that are compared before whole variants travel.
TAG_BITS = 29
#: Variants that a task holds at a time (17 MB an array); four times as many at most, on larger inputs.
VARIANTS = 1 << 21
#: Values that are compared at a time where whole arrays of them would need copies.
BLOCK = 1 << 16
#: Hashes of words that are remembered (more cost memory, and no less time).
CACHED_WORDS = 1 << 16
#: Bytes of text of the families that a task compares; a larger family is alone.
BIN_BYTES = 4 << 20
EMPTY = np.empty(0, np.uint64)


@dataclass(frozen=True)
class Shape:
    """A fingerprint is lanes of bits bits each; two meet if some lane differs in at most radius (even) bits.

    limit: bits of the whole fingerprint that a pair that meets may differ in; None if meeting is the link.
    """

    lanes: int = 1
    bits: int = 64
    radius: int = 4
    limit: int | None = None

    @property
    def masks(self) -> np.ndarray:
        """XOR masks of all flips of at most half the radius."""
        return np.array([sum(1 << i for i in c) for r in range(self.radius // 2 + 1) for c in combinations(range(self.bits), r)], dtype=np.uint64)

    def values(self, raw: list[bytes]) -> np.ndarray:
        """All lanes of the fingerprints, lane by lane, each told apart by its number above its bits."""
        v = np.frombuffer(b"".join(raw), f">u{self.bits // 8}").reshape(len(raw), self.lanes).T.astype(np.uint64)
        if self.lanes > 1:
            v |= np.arange(self.lanes, dtype=np.uint64)[:, None] << np.uint64(self.bits)
        return v.ravel()


#: 24 lanes of 32 bits: a pair of Jaccard similarity 0.8 differs in 15 % of the bits and meets with probability 0.95,
#: more similar pairs with more; whole fingerprints of such a pair differ in 116 of 768 bits, give or take 10.
SIMILAR = Shape(lanes=24, bits=32, radius=2, limit=148)


def fingerprint(data: bytes, width: int) -> int:
    """64-bit SimHash of the word shingles of UTF-8 data (A-Z lower-cased); no words: 0."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        part = zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)
        h = np.array([digest(joined[i:j], SEED) for i, j in part], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, fp binary): the 8 bytes of the fingerprint, highest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x, width).to_bytes(8, "big") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), plain_text(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(run, "id long, fp binary")


class Shingles(dict):
    """Turns texts into ascending hashes of their different word shingles; remembers the hashes of words."""

    def __init__(self, width: int) -> None:
        super().__init__()
        self.width = width

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h

    def of(self, data: bytes) -> np.ndarray:
        """A text of fewer words than width is one shingle; a text without words has none."""
        words = data.lower().split()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        if not k:
            return EMPTY
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def sketch(shingles: np.ndarray, bits: int) -> bytes:
    """SimHash of bits bits (a multiple of 64) of a set of hashes: a bit is 1 if over half of its hashes have it."""
    ones = np.zeros(bits, np.int64)
    salts = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(shingles), 255):
        x = shingles[at : at + 255, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def _tags(values: np.ndarray, masks: np.ndarray, shift: int) -> np.ndarray:
    """The leading bits of a multiplicative hash of every variant, value by value; blocks of values stay in cache."""
    out = np.empty((len(values), len(masks)), np.uint64)
    rows = max(1, (1 << 16) // len(masks))
    for i in range(0, len(values), rows):
        v = out[i : i + rows]
        np.bitwise_xor(values[i : i + rows, None], masks[None, :], out=v)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0x9E3779B97F4A7C15)
        v >>= np.uint64(shift)
    return out.ravel()


def _member(wanted: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Places of the tags that are in the ascending array wanted; a bit map rules most others out first."""
    if not len(wanted):
        return np.empty(0, np.int64)
    low = np.uint64((1 << 22) - 1)
    there = np.zeros(1 << 22, bool)
    there[wanted & low] = True
    at = np.concatenate([np.flatnonzero(there[tags[i : i + BLOCK] & low]) + i for i in range(0, len(tags), BLOCK)] or [np.empty(0, np.int64)])
    return at[wanted[np.minimum(np.searchsorted(wanted, tags[at]), len(wanted) - 1)] == tags[at]]


def _repeated(ranked: np.ndarray, shift: int = 0) -> np.ndarray:
    """Places of an ascending array whose value, without its low shift bits, equals the one before."""
    parts = [np.flatnonzero((ranked[i : i + BLOCK] ^ ranked[i - 1 : i + BLOCK - 1][: len(ranked) - i]) >> np.uint64(shift) == 0) + i for i in range(1, len(ranked), BLOCK)]
    return np.concatenate(parts or [np.empty(0, np.int64)])


def _united(v: np.ndarray, who: np.ndarray, raw: list[bytes], label: np.ndarray, limit: int | None) -> np.ndarray:
    """The least label that each member (place in raw) reaches over links between members that share a variant.

    With a limit, linked members are also within limit bits. In each variant a member of the rarest label is compared
    with all members of other labels and leaves, until one label is left: pairs of one label are connected already, and
    no other pair goes without its comparison.
    """
    n, size = len(raw), int(label.max(initial=-1)) + 1
    if limit is None:
        order = np.lexsort((who, v))
        v, who = v[order], label[who[order]]
        new = np.concatenate((v[:1] == v[:1], v[1:] != v[:-1]))
        return least_reachable(size, who, who[np.flatnonzero(new)][np.cumsum(new) - 1])[label] if len(v) else label
    words = np.frombuffer(b"".join(raw), np.uint64).reshape(n, -1)
    while len(v):
        of = label[who]
        order = np.lexsort((who, of, v))
        v, who, of = v[order], who[order], of[order]
        new = np.concatenate(([True], v[1:] != v[:-1]))
        run = np.flatnonzero(new | np.concatenate(([True], of[1:] != of[:-1])))
        variant, first = np.cumsum(new) - 1, np.cumsum(new)[run] - 1
        open_ = np.bincount(first) > 1
        length = np.diff(run, append=len(v))
        ranked = np.lexsort((length, first))
        centre = run[ranked[np.concatenate(([True], first[ranked][1:] != first[ranked][:-1]))]]
        c = centre[variant]
        asks = open_[variant] & (of != of[c])
        pair = np.unique(np.minimum(who[asks], who[c[asks]]) * n + np.maximum(who[asks], who[c[asks]]))
        a, b = pair // n, pair % n
        parts = [_apart(words, a[i : i + (1 << 16)], b[i : i + (1 << 16)]) <= limit for i in range(0, len(pair), 1 << 16)]
        near = np.concatenate([np.empty(0, bool), *parts])
        label = least_reachable(size, label[a[near]], label[b[near]])[label]
        stays = open_[variant]
        stays[centre] = False
        v, who = v[stays], who[stays]
    return label


def _apart(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)


def links(fps: DataFrame, shape: Shape) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp, binary) that connect all that meet, within the limit if any.

    Every lane makes all variants within half the radius; two lanes are within the radius exactly if they share one.
    Owners of variant ranges first compare short tags, sent as sorted packed blobs, and tell each batch which tags
    met another batch's. Only those variants then travel whole to their owner, each once per local component (or,
    with a limit, fingerprint, which then names its local component). A batch links its members to the least of their
    component, an owner links components to the least it connects: a group of any size makes links in proportion to
    its members. With a limit the ends of a link are connected by pairs within it, and may differ in more bits.
    """
    if shape.radius % 2:
        raise ValueError("radius must be even")
    masks, width = shape.masks, shape.lanes * shape.bits // 8
    n, each = fps.count(), shape.lanes * len(masks)
    held = min(4 * VARIANTS, max(VARIANTS, 16 * isqrt(n * each)))
    n_batches = max(1, -(-n * each // held))
    owner_bits = max(0, (n * each // held).bit_length())
    shift = 64 - owner_bits - TAG_BITS
    # A batch is little data and much work: a fixed number of partitions keeps them from being merged.
    rows = fps.select(F.pmod(F.xxhash64("fp"), F.lit(n_batches)).cast("int").alias("batch"), "fp").repartition(n_batches, "batch")

    def emit(t: pa.Table) -> pa.Table:
        tags = _tags(shape.values(t.column("fp").to_pylist()), masks, shift)
        tags.sort()
        edges = np.arange((1 << owner_bits) + 1, dtype=np.uint64) << np.uint64(TAG_BITS)
        cut = np.searchsorted(tags, edges)
        owner = np.flatnonzero(np.diff(cut))
        # One owner's tags at a time: the task holds one array of all variants.
        blobs = []
        for o in owner.tolist():
            own = tags[cut[o] : cut[o + 1]]
            blobs.append(pack_sorted(own[np.concatenate(([True], own[1:] != own[:-1]))] & np.uint64((1 << TAG_BITS) - 1)))
        k = len(owner)
        return pa.table({"owner": pa.array(owner, pa.int32()), "batch": pa.array([t.column("batch")[0].as_py()] * k, pa.int32()), "tags": pa.array(blobs, pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        blobs, low = t.column("tags").to_pylist(), np.uint64(64 - TAG_BITS)
        key, n = np.empty(sum(map(packed_count, blobs)), np.uint64), 0
        for i, x in enumerate(blobs):
            own = unpack_sorted(x)
            key[n : n + len(own)] = (own << low) | np.uint64(i)
            n += len(own)
        key.sort()
        same = _repeated(key, 64 - TAG_BITS)
        hit = np.zeros(len(key), bool)
        hit[same] = hit[same - 1] = True
        key = key[hit]
        tag, whose = key >> low, (key & np.uint64((1 << (64 - TAG_BITS)) - 1)).astype(np.int64)
        order = np.argsort(whose, kind="stable")
        tag, whose = tag[order], whose[order]
        at = np.flatnonzero(np.diff(whose, prepend=-1))
        batches = np.array(t.column("batch").to_pylist())
        return pa.table({"batch": pa.array(batches[whose[at]] if len(at) else [], pa.int32()), "owner": pa.array([t.column("owner")[0].as_py()] * len(at), pa.int32()), "tags": pa.array([pack_sorted(x) for x in np.split(tag, at[1:])] if len(at) else [], pa.binary())})

    def rows_of(a: list, b: list, far: list[tuple[int, bytes, bytes, bytes, bytes]]) -> pa.Table:
        k, m = len(a), len(far)
        cols = {"a": pa.array([*a, *[None] * m], pa.binary()), "b": pa.array([*b, *[None] * m], pa.binary()), "owner": pa.array([*[None] * k, *[f[0] for f in far]], pa.int32())}
        return pa.table(cols | {c: pa.array([*[None] * k, *[f[i] for f in far]], pa.binary()) for i, c in ((1, "keys"), (2, "at"), (3, "home"), (4, "fps"))})

    def answer(mine: pa.Table, told: pa.Table) -> pa.Table:
        raw = sorted(mine.column("fp").to_pylist())
        if not raw:
            return rows_of([], [], [])
        values = shape.values(raw)
        tags = _tags(values, masks, shift)
        parts = [unpack_sorted(x) + (np.uint64(o) << np.uint64(TAG_BITS)) for o, x in zip(told.column("owner").to_pylist(), told.column("tags").to_pylist(), strict=True)]
        wanted = np.sort(np.concatenate([EMPTY, *parts]))
        ranked = np.sort(tags)
        local = ranked[_repeated(ranked)]
        del ranked
        pick = _member(np.unique(np.concatenate((wanted, local))), tags)
        met = np.zeros(len(pick), bool)
        met[_member(wanted, tags[pick])] = True
        v, who = values[pick // len(masks)] ^ masks[pick % len(masks)], pick // len(masks) % len(raw)
        root = _united(v, who, raw, np.arange(len(raw)), shape.limit)
        a = np.flatnonzero(root != np.arange(len(raw)))
        if shape.limit is None:
            who = root[who]
        owner = (tags[pick] >> np.uint64(TAG_BITS)).astype(np.int64)[met]
        v, who = v[met], who[met]
        order = np.lexsort((who, v, owner))
        owner, v, who = owner[order], v[order], who[order]
        new = np.concatenate((v[:1] == v[:1], (v[1:] != v[:-1]) | (who[1:] != who[:-1])))
        owner, v, who = owner[new], v[new], who[new]
        far = []
        for i in np.split(np.arange(len(v)), np.flatnonzero(np.diff(owner)) + 1) if len(v) else []:
            own, at = np.unique(who[i], return_inverse=True)
            packed = zstandard.ZstdCompressor(level=1).compress(at.astype("<u4").tobytes())
            far.append((int(owner[i[0]]), pack_sorted(v[i]), packed, root[own].astype("<u4").tobytes(), b"".join(raw[j] for j in own.tolist())))
        return rows_of([raw[i] for i in a.tolist()], [raw[i] for i in root[a].tolist()], far)

    def settle(t: pa.Table) -> pa.Table:
        v, at, homes, blobs, n_before = [], [], [], [], 0
        for k, (keys, who, home, fps) in enumerate(zip(*(t.column(c).to_pylist() for c in ("keys", "at", "home", "fps")), strict=True)):
            v.append(unpack_sorted(keys))
            at.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(who, max_output_size=4 * len(v[-1]) + 1), "<u4").astype(np.int64) + n_before)
            homes.append(np.frombuffer(home, "<u4").astype(np.int64) + (k << 32))
            blobs += [fps[i : i + width] for i in range(0, len(fps), width)]
            n_before += len(fps) // width
        # Members in ascending order, so the least stands for its component; each comes from one batch.
        order = np.array(sorted(range(len(blobs)), key=blobs.__getitem__), np.int64)
        raw, place = [blobs[i] for i in order.tolist()], np.empty(len(blobs), np.int64)
        place[order] = np.arange(len(blobs))
        _, first, label = np.unique(np.concatenate(homes)[order], return_index=True, return_inverse=True)
        label = first[label]
        root = _united(np.concatenate(v), place[np.concatenate(at)], raw, label, shape.limit)
        a = np.flatnonzero((label == np.arange(len(raw))) & (root != label))
        return pa.table({"a": pa.array([raw[i] for i in a.tolist()], pa.binary()), "b": pa.array([raw[i] for i in root[a].tolist()], pa.binary())})

    sent = rows.groupBy("batch").applyInArrow(emit, "owner int, batch int, tags binary")
    told = sent.groupBy("owner").applyInArrow(meet, "batch int, owner int, tags binary")
    found = materialise(rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(answer, "a binary, b binary, owner int, keys binary, at binary, home binary, fps binary"), "variants")
    across = found.where("owner IS NOT NULL").groupBy("owner").applyInArrow(settle, "a binary, b binary")
    return found.where("owner IS NULL").select("a", "b").unionByName(across).distinct()


def near_groups(docs: DataFrame, width: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, fp, component). component is the least id reachable over links of radius bits.

    Null and empty texts have fingerprint 0 and link like any other; texts shorter than width words are one shingle,
    long texts are read whole. Repeated rows each keep a row; null ids are rows too, and a component of null ids only
    is null. An empty table gives no rows; other columns of docs are ignored, whatever their names.
    """
    rows = materialise(fingerprints(docs, width, id_col, text_col), "fingerprints")
    least = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(links(least.select("fp"), Shape(radius=radius))).select(F.col("node").alias("fp"), "root")
    least = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component"))
    comp = materialise(least.join(of_root, "root").select("fp", "component"), "components")
    return rows.join(comp, "fp").select("id", "fp", "component")


def text_key(text_col: str = "text") -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(plain_text(text_col).cast("binary")))


def _least_similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The least place that each set reaches over links of Jaccard similarity or more; empty sets are alike.

    A set of the rarest label is compared with all sets of other labels and leaves, until one label is left.
    """
    n = len(sets)
    label, sizes = np.arange(n), np.array([len(x) for x in sets], np.int64)
    label[sizes == 0] = np.flatnonzero(sizes == 0).min(initial=n)
    live = np.flatnonzero(sizes)
    if len(live) < 2:
        return label
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(sizes)))
    held = np.bincount(flat)
    # The most typical sets first: as centres they settle most of a group.
    live = live[np.argsort([-held[flat[start[i] : start[i + 1]]].mean() for i in live.tolist()], kind="stable")]
    mark = np.zeros(len(held), np.uint8)
    of, entries, at = np.empty(0, np.int64), flat, start[:-1]
    while len(live) > 1:
        if 2 * len(live) < len(of) or not len(of):
            of = np.sort(live)
            entries = np.concatenate([flat[start[i] : start[i + 1]] for i in of.tolist()])
            at = np.concatenate(([0], np.cumsum(sizes[of])[:-1]))
        many = np.bincount(label[live], minlength=n)[label[live]]
        if many[0] == len(live):
            break
        k = int(np.argmin(many))
        c = int(live[k])
        live = np.delete(live, k)
        own = flat[start[c] : start[c + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[entries], at, dtype=np.int64)
        mark[own] = 0
        near = of[both >= similarity * (sizes[of] + sizes[c] - both)]
        met = np.unique(label[near])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return label


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, shape: Shape = SIMILAR, id_col: str = "doc_id", text_col: str = "text", most: int = 4096, most_bytes: int = 24 << 20) -> DataFrame:
    """One row per document: (id, key, component, kept); a component's document of least id (then key) is kept.

    Texts are linked if the Jaccard similarity of their sets of word shingles (A-Z lower-cased) is at least
    similarity, by exact count. A family is what is connected by pairs of which some lane of the fingerprint meets and
    whose whole fingerprints differ in at most shape.limit bits: pairs just at 0.8 are found with probability 0.95,
    closer ones more surely, and those that others connect always. One task holds a family and compares its texts until
    no pair is open. A family of more than most texts or most_bytes is dealt into parts, and each two parts are held by
    a task. key stands for the text; null texts are empty; texts without words are alike; long texts are read whole.
    Rows of one text and id share their fate; null ids come last. An empty table gives no rows; other columns are
    ignored.
    """
    bits = shape.lanes * shape.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for b in batches:
            texts = b.column(2).to_pylist()
            fps = [sketch(shingles.of(x), bits) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "key", "fp", "bytes"])

    def compare(t: pa.Table) -> pa.Table:
        shingles, a, b = Shingles(width), [], []
        units = np.array(t.column("unit").to_pylist(), np.int64)
        keys, data = t.column("key").to_pylist(), t.column("data").to_pylist()
        order = np.argsort(units, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(units[order])) + 1):
            root = _least_similar([shingles.of(data[i]) for i in part.tolist()], similarity)
            moved = np.flatnonzero(root != np.arange(len(part)))
            a += [keys[i] for i in part[moved].tolist()]
            b += [keys[i] for i in part[root[moved]].tolist()]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    whole = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), plain_text(text_col).cast("binary").alias("data"))
    rows = materialise(whole.mapInArrow(run, "id long, key binary, fp binary, bytes long"), "sketches")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    node = F.unhex(F.md5("fp"))
    texts = materialise(rows.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bytes").alias("bytes"), F.min(order).alias("first")), "texts")
    nodes = materialise(texts.groupBy("fp").agg(F.count("*").alias("n")).select("fp", node.alias("node"), "n"), "nodes")
    met = links(nodes.select("fp"), shape).select(F.unhex(F.md5("a")).alias("a"), F.unhex(F.md5("b")).alias("b"))
    family = nodes.join(connected_components(met), "node", "left").where("n > 1 OR root IS NOT NULL").select("node", F.coalesce("root", "node").alias("family"))
    mates = materialise(texts.select("key", "bytes", node.alias("node")).join(family, "node").select("key", "bytes", "family"), "families")
    total = mates.groupBy("family").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    large = total.where((F.col("n") > most) | (F.col("bytes") > most_bytes))
    halves = F.ceil(F.greatest(2 * F.col("n") / most, 2 * F.col("bytes") / most_bytes)).cast("int")
    mates = mates.join(if_small(large.select("family", halves.alias("parts")), "large"), "family", "left")
    own = F.pmod(F.xxhash64("key"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.when(i != own, F.xxhash64("family", F.least(i, own.cast("int")), F.greatest(i, own.cast("int")))))
    mates = materialise(mates.select("key", "bytes", F.when(F.col("parts").isNull(), F.array(F.xxhash64("family"))).otherwise(F.array_compact(pairs)).alias("units")), "units")
    held = mates.agg(F.sum(F.col("bytes") * F.size("units")).alias("bytes")).first()["bytes"] or 0
    n_bins = max(1, -(-held // BIN_BYTES))
    found = whole.select("key", "data").join(if_small(mates.select("key", "units"), "asked", 1 << 19), "key").dropDuplicates(["key"])
    found = found.select("key", "data", F.explode("units").alias("unit")).withColumn("bin", F.pmod("unit", F.lit(n_bins)).cast("int"))
    linked = found.repartition(n_bins, "bin").groupBy("bin").applyInArrow(compare, "a binary, b binary")
    roots = connected_components(linked).select(F.col("node").alias("key"), "root")
    texts = texts.select("key", "first").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = texts.groupBy("root").agg(F.min("first").alias("best"))
    chosen = materialise(texts.join(best, "root").select("key", "best"), "chosen")
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))
    return rows.select("id", "key").join(chosen, "key").select("id", "key", F.col("best.id").alias("component"), kept.alias("kept"))


def fp_hex(col: str) -> Column:
    return F.lower(F.hex(F.col(col)))
