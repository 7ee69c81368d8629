"""Training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import re
import tracemalloc
from unittest.mock import MagicMock

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from screenloom.llm import chat, exact, mix, pii, quality, queries, simhash, substring, tiling, toxic, warc

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, batch int, word string"


def docs(spark, rows):
    """Rows (doc_id, text) with further columns, some of them named like internal ones."""
    return spark.createDataFrame([(i, t, None, f"s{(i or 0) % 2}" if i != 3 else None, 0, "x", 7, "w") for i, t in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, "a b"), (4, "a  b"), (4, "a b"), (None, "lone words here"), (6, "x " * 50_000)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(queries.SQL[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    found = queries.QUERIES[name](spark, DIR)
    assert sorted(found.columns) == columns
    # Plain Python values on both sides: whole numbers stay whole and nulls are None whatever the column's type.
    assert sorted(repr(tuple(r)) for r in found.select(*columns).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_simhash_matches_brute_force(spark):
    d = pd.read_parquet(f"{DIR}/documents.parquet")
    near = [(10_000 + i, t + " extra") for i, t in enumerate(d.text[:40])]
    rows = [*zip(d.doc_id.tolist(), d.text), *near, *[x for x in EDGE if x[0] is not None]]
    got = simhash.near_groups(docs(spark, rows), width=4).collect()

    def slow(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = [{**r.asDict(), "fp": int.from_bytes(r["fp"], "big")} for r in got]
    assert sorted((r["id"], r["fp"]) for r in got) == sorted((i, slow(t)) for i, t in rows)
    fps = sorted({r["fp"] for r in got})
    root = {f: f for f in fps}
    for _ in fps:
        moved = False
        for a in fps:
            best = min(root[b] for b in fps if (a ^ b).bit_count() <= 4)
            moved |= best != root[a]
            root[a] = best
        if not moved:
            break
    least = {}
    for r in got:
        least[root[r["fp"]]] = min(least.get(root[r["fp"]], 1 << 60), r["id"])
    assert all(r["component"] == least[root[r["fp"]]] for r in got)


def test_links_of_tight_clusters_grow_with_their_members(spark):
    rng = np.random.default_rng(4)
    found = []
    for n in (1000, 2000, 4000):
        flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(n)]
        fps = {0x0123456789ABCDEF ^ f for f in flips}
        table = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")),) for f in fps], "fp binary")
        got = [(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in simhash.links(table, simhash.Shape()).collect()]
        up = {f: f for f in fps}
        for a, b in got:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        assert len({f for f in fps if up[f] == f}) == 1
        found.append(len(got) / len(fps))
    assert max(found) < 2


def test_tasks_of_links_hold_few_arrays_of_variants(monkeypatch):
    tasks, frame = [], MagicMock()
    frame.count.return_value = n = 235_748
    for way in ("select", "repartition", "groupBy", "cogroup", "where"):
        getattr(frame, way).return_value = frame
    frame.applyInArrow.side_effect = lambda f, schema: tasks.append(f) or frame
    monkeypatch.setattr(simhash, "F", MagicMock())
    monkeypatch.setattr(simhash, "materialise", lambda df, name: df)
    simhash.links(frame, simhash.Shape())
    emit, meet, answer, _ = tasks

    def peak(task, *tables):
        tracemalloc.start()
        try:
            out = task(*tables)
            return out, tracemalloc.get_traced_memory()[1] / (8 * simhash.VARIANTS)
        finally:
            tracemalloc.stop()

    n_batches = -(-n * 2081 // simhash.VARIANTS)
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 2**64, n // n_batches, dtype=np.uint64)
    fps[:20] = fps[20:40] ^ np.uint64(1 << 7)
    mine = pa.table({"batch": pa.array([5] * len(fps), pa.int32()), "fp": pa.array([int(x).to_bytes(8, "big") for x in fps], pa.binary())})
    sent, emitting = peak(emit, mine)
    owner_bits = n_batches.bit_length()
    tags = np.unique(simhash._tags(fps, simhash.Shape().masks, 64 - owner_bits - simhash.TAG_BITS))
    got = [simhash.unpack_sorted(x) + np.uint64(o << simhash.TAG_BITS) for o, x in zip(sent.column("owner").to_pylist(), sent.column("tags").to_pylist(), strict=True)]
    assert np.array_equal(np.concatenate(got), tags)
    batches = [b for b in range(n_batches) if b != 5]
    others = [simhash.pack_sorted(np.unique(rng.integers(0, 1 << simhash.TAG_BITS, 8192, dtype=np.uint64))) for _ in batches]
    blobs = [sent.column("tags")[0].as_py(), *others]
    of_owner = pa.table({"owner": pa.array([0] * len(blobs), pa.int32()), "batch": pa.array([5, *batches], pa.int32()), "tags": pa.array(blobs, pa.binary())})
    told, meeting = peak(meet, of_owner)
    times = np.unique(np.concatenate([simhash.unpack_sorted(x) for x in blobs]), return_counts=True)
    shared = times[0][times[1] > 1]
    assert {b: simhash.unpack_sorted(x).tolist() for b, x in zip(told.column("batch").to_pylist(), told.column("tags").to_pylist(), strict=True)} == {b: y for b, x in zip([5, *batches], blobs, strict=True) if (y := np.intersect1d(simhash.unpack_sorted(x), shared).tolist())}
    found, answering = peak(answer, mine, told.slice(0, 1))
    assert len({frozenset(x) for x in zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True) if x[0]}) == 20
    assert max(emitting, meeting, answering) < 2.25


def test_near_copies_match_exact_jaccard(spark):
    rng = np.random.default_rng(11)
    rows, base = [], [[f"w{x}" for x in rng.integers(0, 4000, 120)] for _ in range(60)]
    for i, words in enumerate(base):
        rows.append((i, " ".join(words)))
        for k, edits in enumerate((1, 2, 3, 8)):
            other = list(words)
            for at in rng.choice(120, edits, replace=False):
                other[at] = f"new{k}"
            rows.append((1000 * (k + 1) + i, " ".join(other)))
    got = simhash.near_copies(docs(spark, rows + [(None, rows[0][1]), (5, None), (9001, " ")])).collect()
    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i % 1000 == j % 1000 and i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    of = {r["id"]: r["component"] for r in got if (r["id"], r["key"]) != (5, simhash_key(None))}
    assert all(of[i] == root[i] for i in sets) and of[None] == 0 and of[9001] == 5
    assert sum(r["kept"] for r in got) == len(set(root.values())) + 1


def least_linked(n, linked):
    """For each of n places the least place it reaches, by trying every pair."""
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("variants", [1 << 14, 1 << 21])
def test_large_families_make_few_links_and_lose_none(spark, monkeypatch, variants):
    """Texts close to the threshold, most pairs of them under it: few rows, whatever meets; the groups of brute force."""
    rng = np.random.default_rng(5)
    base, rows = [f"w{x}" for x in rng.integers(0, 4000, 150)], []
    for i in range(500):
        other = list(base)
        for at in rng.choice(150, rng.integers(1, 7), replace=False):
            other[at] = f"new{rng.integers(0, 1000)}"
        rows.append((i, " ".join(other)))
    monkeypatch.setattr(simhash, "VARIANTS", variants)
    shape, shingles = simhash.SIMILAR, simhash.Shingles(5)
    fps = sorted({simhash.sketch(shingles.of(t.encode()), shape.lanes * shape.bits) for _, t in rows})
    lanes = np.array([np.frombuffer(f, ">u4") for f in fps])
    bits = np.bitwise_count(lanes[:, None, :] ^ lanes[None, :, :])
    met = (bits.min(axis=2) <= shape.radius) & (bits.sum(axis=2, dtype=np.int64) <= shape.limit)
    found = simhash.links(spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary"), shape).collect()
    place = {f: i for i, f in enumerate(fps)}
    pairs = {tuple(sorted((place[bytes(r["a"])], place[bytes(r["b"])]))) for r in found}
    assert len(found) < 2 * len(fps)
    assert least_linked(len(fps), lambda i, j: (j, i) in pairs) == least_linked(len(fps), lambda i, j: met[i, j])
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    want = least_linked(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    for most in (4096, 128):
        got = simhash.near_copies(docs(spark, rows), most=most).collect()
        assert [r["component"] for r in sorted(got, key=lambda r: r["id"])] == want


def simhash_key(text):
    return bytearray(hashlib.md5((text or "").encode()).digest())


def test_exact_chains_weak_digests(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)] + EDGE
    weak = exact.exact_groups(docs(spark, rows), capacity=2, digest=lambda n: F.substring(F.sha2(n, 256), 1, 1))
    strong = exact.exact_groups(docs(spark, rows))
    key = lambda df: sorted(map(str, df.select("id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert key(weak) == key(strong) and strong.count() == len(rows)


def test_personal_data_matches_brute_force(spark):
    rows = [(1, "mail a.b@x-y.org, call +1 (555) 010-9999 or 10.0.0.256 and 192.168.1.9."), (2, "card 4111 1111 1111 1111 and 4111 1111 1111 1112"), (3, "é a@b.c_d@e.fg +12345"), *[x for x in EDGE if x[0] not in (3, None)]]
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    def ok(kind, m):
        n = re.sub("[^0-9]", "", m)
        return [True, all(int(p) < 256 for p in m.split(".")) if kind == 1 else True, 14 <= len(n) <= 19 and luhn(n), 10 <= len(n) <= 15][kind]

    got = {(r["id"], r["text"]): r["s"] for r in pii.find_personal_data(docs(spark, rows)).select("id", "text", pii.render(F.col("spans"), pii.KINDS).alias("s")).collect()}
    for i, t in rows:
        found = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t or "") if ok(k, m[0]))
        assert got[i, t or ""] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_disclosing_terms_go_and_common_ones_stay(spark):
    rows = [(i, f"note{i} Zorblatt wrote from q@r.st about item{i} the day") for i in range(6)] + [(10 + i, f"the day of item{i} went by") for i in range(6)]
    found = pii.find_personal_data(docs(spark, rows))
    clean = {r["id"]: r["text"] for r in pii.sanitise(found).collect()}
    assert clean[0].startswith("note0 [TERM]") and "[EMAIL]" in clean[0] and clean[10] == "the day of item0 went by"


def test_disclosing_terms_far_from_entities_and_beside_punctuation(spark):
    far = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"(Zorblatt), of case {i}: {far} so q@r.st it is. Quibble-Knorr. quorn") for i in range(4)]
    rows += [(10, "a Zorblatt. and Zorblatts stay"), (11, "quorn by itself"), (12, "quorn once more")]
    # Copies of one text count once, and what is inside an entity is no term.
    rows += [(20 + i, "Vumbric wrote x@vumbric.st") for i in range(5)]
    clean = {r["id"]: r["text"] for r in pii.sanitise(pii.find_personal_data(docs(spark, rows))).collect()}
    assert clean[0] == f"([TERM]), of [TERM] 0: {far} so [EMAIL] it is. [TERM]. quorn"
    assert clean[10] == "a [TERM]. and Zorblatts stay" and clean[11] == "quorn by itself"
    assert clean[20] == "Vumbric wrote [EMAIL]"


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(1, "u\r\nX", "<a>"), (2, "v", "<a>"), (3, None, None), (4, "w", ""), (5, "z", "é" * 9000)], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    index = {r["record_id"]: r for r in warc.read_index(archive).collect()}
    assert [index[i]["record_type"] for i in range(1, 6)] == ["revisit", "response", "revisit", "response", "response"]
    assert index[1]["refers_to"] == "2" and index[5]["payload_sha1"] == base64.b32encode(hashlib.sha1(("é" * 9000).encode()).digest()).decode()
    records = {r["record_id"]: bytes(r["record"]) for r in warc.read_records(archive).collect()}
    head, _, body = records[5].partition(b"\r\n\r\n")
    assert body == ("é" * 9000).encode() + b"\r\n\r\n" and b"Content-Length: 18000" in head and b"u%0D%0AX" in records[1]


def test_chat_folds_edits_and_regenerations(spark):
    log = [(1, 0, 1, 0, "start", "", "user"), (1, 0, 1, 1, "delta", "he", None), (1, 0, 1, 2, "delta", "y", None), (1, 1, 1, 0, "start", "", "assistant"), (1, 1, 1, 1, "delta", "bad", None), (1, 1, 1, 2, "regenerate", "", None), (1, 1, 1, 3, "delta", "good|<s>\\", None), (1, 1, 1, 4, "edit", "[INST] best", None), (1, 1, 1, 5, "delta", None, None)]
    m = chat.fold(spark.createDataFrame(log, "conv_id long, turn long, copy int, seq int, kind string, text string, role string"))
    out = chat.read_back(chat.render(m)).collect()[0]
    assert out["loss_sha256"] == hashlib.sha256(b"[INST] best").hexdigest() and out["n_turns"] == 2
    assert out["turns_sha256"] == hashlib.sha256(b"user\nhey\nassistant\n[INST] best\n").hexdigest()


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, d).where("held_out").toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"))
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.8 and hit / max(1, (got.predicted == 1).sum()) > 0.9


def test_misspellings_and_quotations():
    s = toxic.Model(["pathetic", "idiot", "vile*"]).scorer()
    assert [(k, q) for _, k, q in s.hits('so pathetik, idiots! he said "you idiot" vileness')] == [(1, False), (1, False), (0, True), (0, False)]
    assert s.hits("clean words") == [] and s.score(None) == 0.5


def test_misspelt_words_with_a_learned_stem(spark):
    forms = ("idiot", "idiots", "idiotic")
    rows = [(f"p{i} {forms[i % 3]} q{i}", 1) for i in range(60)] + [(f"r{i} plain words s{i}", 0) for i in range(600)]
    terms = toxic.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), 100)
    assert set(forms) < set(terms) and "idio*" in terms and "idiot*" not in terms
    s = toxic.Model(terms).scorer()
    assert [k for _, k, _ in s.hits("ibiot idiotism iddiots")] == [1, 0, 1]


def test_quality_threshold_from_left_out_texts(spark):
    d = pd.read_parquet(f"{DIR}/documents.parquet").drop_duplicates("text").head(120)
    rows = [(int(i), t, "en", "s", 0, "x", 7, "w") for i, t in zip(d.doc_id, d.text)]
    every = spark.createDataFrame(rows, DOCS)
    got = quality.quality(every, every.select("doc_id"), quantile=0.5).toPandas()
    # Texts that the model holds are likelier to it: far more than half are under the left-out texts' median.
    assert got.threshold.nunique() == 1 and got.keep.mean() > 0.6


def test_tiling_catches_reordered_passages(spark):
    w = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, None), (3, ""), (4, "Two words")], "item_id long, text string")
    rows = [(1, " ".join(w[15:] + ["x"] + w[:15])), (2, " ".join(w[:10])), (3, "two, WORDS"), (4, None), (5, "")]
    got = {r["doc_id"]: r["contamination"] for r in tiling.contamination(docs(spark, rows), bench).collect()}
    assert [got[i]["contaminated"] for i in range(1, 6)] == [True, False, True, False, False]
    assert got[1]["coverage"] == 1.0 and got[1]["item_id"] == 1 and got[2]["coverage"] == pytest.approx(1 / 3)


def test_kneser_ney_sums_to_one_and_flags_junk(spark):
    text = "the cat sat on the mat and the dog sat on the log " * 3
    top = quality.count_grams(spark.createDataFrame([(bytearray(text.encode()),)], "data binary"))
    model = quality.KneserNey(top)
    ctx = int.from_bytes(b"the ", "big") << 8
    p = model.log_probabilities(spark.range(256).select((F.lit(ctx) + F.col("id")).alias("gram"))).agg(F.sum(F.exp("logp")).alias("s")).first()["s"]
    assert p == pytest.approx(1.0)
    rows = docs(spark, [(1, text), (2, "the dog sat on the mat"), (3, "#$%^ &*(@ zzqx"), (4, None)])
    got = {r["id"]: r for r in quality.quality(rows, spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert got[3]["perplexity"] > got[2]["perplexity"] > 1 and not got[3]["keep"] and got[4]["keep"]


def test_edges_and_empty_tables(spark):
    for rows in (EDGE, []):
        d, n = docs(spark, rows), len(rows)
        assert simhash.near_groups(d).count() == n
        assert exact.exact_groups(d).count() == n
        assert pii.find_personal_data(d).count() == n
        assert substring.remove_repeats(d).count() == n
        assert mix.mix(d).count() == n
        assert tiling.contamination(d, docs(spark, []).select(F.col("doc_id").alias("item_id"), "text")).count() == n
        assert quality.quality(d, d.select("doc_id").limit(2)).count() == n


def test_empty_tables_of_the_other_operators(spark):
    none = docs(spark, [])
    model = toxic.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.terms == [] and none.select(toxic.score(model)).count() == 0
    assert {r["s"] for r in docs(spark, EDGE).select(toxic.score(model).alias("s")).collect()} == {0.5}
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.render(chat.fold(chat.turn_events(turns)))).count() == 0
    assert warc.read_index(warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_chat_takes_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 2, "assistant", "a\r\n|>"), (2, 0, "assistant", ""), (3, 0, "assistant", "long \\ " * 40_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(chat.turn_events(turns)))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"\nfirst\nuser\n\nuser\n\n").hexdigest()
    assert got[None]["loss_chars"] == 5 and got[None]["loss_sha256"] == hashlib.sha256(b"a\r\n|>").hexdigest()
    assert got[3]["loss_chars"] == 280_000 and got[3]["loss_sha256"] == hashlib.sha256(b"long \\ " * 40_000).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()


def test_targets_share_everything():
    got = mix.targets({"a": 10, "b": 1000, None: 5}, (5, 2, 1), 3)
    assert [s.source for s in got] == ["a", "b", None] and sum(s.target for s in got) == pytest.approx(1015)
    assert got[0].target == 30 and got[2].target == 15 and np.isclose(got[1].target, 970)


def test_dedup_stages_keep_other_texts_of_repeated_and_missing_ids(spark):
    import corpus_pipeline

    long = " ".join(f"word{i}" for i in range(400))
    rows = [(1, "same text"), (2, "same  text"), (2, "its own text"), (None, "same text"), (None, "no id one"), (None, "no id two"), (None, "no id two"), (5, None), (6, ""), (7, long), (8, long + " more"), (8, "far from that")]
    left = corpus_pipeline.drop_copies(spark, docs(spark, rows), DIR)
    own = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    want = [(1, "same text"), (2, "its own text"), (None, "no id one"), (None, "no id two"), (5, None), (7, long), (8, long + " more"), (8, "far from that")]
    assert own(left) == sorted(want, key=str) and left.columns == docs(spark, []).columns
    # Decisions are by row: the near copy goes, the other text of its id stays.
    assert own(corpus_pipeline.drop_near_copies(spark, left, DIR)) == sorted((x for x in want if x != (8, long + " more")), key=str)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_contaminated):
        none = stage(spark, docs(spark, []), DIR)
        assert none.columns == docs(spark, []).columns and none.count() == 0
    assert corpus_pipeline.mix_sources(spark, docs(spark, []), DIR).count() == 0
    assert corpus_pipeline.drop_toxic(spark, docs(spark, EDGE), DIR).count() == len(EDGE)
    assert corpus_pipeline.drop_contaminated(spark, docs(spark, EDGE), DIR).count() == len(EDGE)
    assert corpus_pipeline.mix_sources(spark, docs(spark, EDGE), DIR).count() == len(EDGE)


def greedy_tiles(item, doc, width):
    """Words of item that greedy string tiling covers, by trying every pair of places."""
    used_i, used_j, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_j:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < width:
            return covered
        used_i |= set(range(i, i + n))
        used_j |= set(range(j, j + n))
        covered += n


def test_tiling_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    line = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 4, n))
    tests = [(i, line(rng.integers(1, 25))) for i in range(6)] + [(None, line(12)), (2, "same v1 v2"), (2, "same v1 v2")]
    texts = [(i, line(rng.integers(0, 60))) for i in range(25)]
    texts += [texts[3], (None, texts[4][1])]
    bench = spark.createDataFrame(tests, "item_id long, text string")
    some = docs(spark, texts).withColumn("contamination", F.lit("mine")).withColumn("_tiles", F.lit(1))
    got = tiling.contamination(some, bench, width=3)
    assert got.columns == [*some.columns, "contamination_"]
    for r in got.collect():
        doc, best = r["text"].split(), {}
        for item_id, t in set(tests):
            w = t.split()
            c = greedy_tiles(w, doc, min(3, len(w)))
            if c:
                best[item_id, t] = (c / len(w), c)
        c = r["contamination_"]
        assert c["coverage"] == max((b[0] for b in best.values()), default=0.0)
        assert c["n_tests"] == sum(b[0] >= 0.8 for b in best.values()) and c["contaminated"] == (c["coverage"] >= 0.8)
        if best:
            ids = [k[0] for k, b in best.items() if b[0] == c["coverage"]]
            assert c["item_id"] == min((i for i in ids if i is not None), default=None)


def test_substring_doubles_only_suffixes_that_may_repeat(monkeypatch):
    tasks, frame, doubled = [], MagicMock(), []
    for way in ("groupBy", "cogroup", "where", "unionByName"):
        getattr(frame, way).return_value = frame
    frame.applyInArrow.side_effect = lambda f, schema: tasks.append(f) or frame
    monkeypatch.setattr(substring, "F", MagicMock())
    monkeypatch.setattr(substring, "suffix_groups", lambda *_: (np.zeros(substring.CELLS, np.uint64), np.ones(substring.CELLS, np.uint64)))
    monkeypatch.setattr(substring, "in_order_batches", lambda *_: frame)
    paired = substring._paired
    monkeypatch.setattr(substring, "_paired", lambda a, b: doubled.append(len(a)) or paired(a, b))
    substring.remove_repeats(frame)
    leaves = tasks[2]
    words = [str(i % 97 * 1000 + i % 89) for i in range(8000)]
    words[5000:5030] = words[100:130]
    words[7000:7030] = ["again"] * 30
    mine = pa.table({"batch": pa.array([0, 0], pa.int32()), "id": pa.array([1, 2], pa.int64()), "data": pa.array([" ".join(x).encode() for x in (words[:6000], words[6000:])], pa.binary())})
    told = pa.table({"grp": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    found = leaves(mine, told)
    assert found.column("grp").to_pylist() == [None]
    seen, want = set(), []
    for at in range(len(words) - 19):
        if not 6000 - 20 < at < 6000:
            own = tuple(words[at : at + 20])
            want += [at] * (own in seen)
            seen.add(own)
    assert simhash.unpack_sorted(found.column("at")[0].as_py()).tolist() == want and len(want) == 21
    assert max(doubled) < 200


def test_substring_over_many_batches_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    passage = [f"p{i}" for i in range(70)]
    texts = []
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 90))]
        at = rng.integers(0, len(words) + 1)
        cut = sorted(rng.integers(0, 71, 2))
        texts.append((int(i), " ".join(words[:at] + (passage[cut[0] : cut[1]] if i % 2 else ["a"] * int(rng.integers(0, 60))) + words[at:])))
    texts += [(500, texts[7][1]), (501, texts[7][1] + " tail"), (None, texts[9][1]), (7, "again " + texts[9][1])]
    got = {(r["id"], r["n_words"], r["kept_text"]): r["n_removed"] for r in substring.remove_repeats(docs(spark, texts), window=5, batch_bytes=700, capacity=300).collect()}
    seen, want = set(), {}
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        w, gone = t.split(), set()
        for k in range(len(w) - 4):
            key = tuple(w[k : k + 5])
            if key in seen:
                gone |= set(range(k, k + 5))
            seen.add(key)
        want[i, len(w), " ".join(x for k, x in enumerate(w) if k not in gone)] = len(gone)
    assert got == want


def test_trie_matches_levenshtein_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abc"), n))
    terms = sorted({word(rng.integers(3, 13)) for _ in range(60)})
    trie = toxic.Trie(terms)
    for w in {word(rng.integers(1, 14)) for _ in range(1500)} | {t[:2] + "z" + t[3:] for t in terms}:
        near = [(d, t) for t in terms if (d := distance(w, t)) <= toxic.edits_allowed(len(t))]
        want = min(near, default=None)
        if want and (want[0] == 0 or len(w) >= 4):
            assert trie.near(w) == (want[1], want[0]), w
        else:
            assert trie.near(w) is None, w


def test_kneser_ney_matches_a_plain_model(spark):
    train, other = [b"abracadabra abrac", b"banana band abra"], [b"abra banana", b"xyz", b"", b"aaaa"]
    pad = lambda t: bytes(4) + t
    counts = {5: {}}
    for t in train:
        for i in range(len(t)):
            g = pad(t)[i : i + 5]
            counts[5][g] = counts[5].get(g, 0) + 1
    for n in range(4, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    cuts = {}
    for n, c in counts.items():
        k = [sum(v == i for v in c.values()) for i in range(5)]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] and k[2] else 0.5
        cuts[n] = [min(i, max(0.1, i - (i + 1) * y * k[i + 1] / k[i])) if k[i] else 0.5 for i in (1, 2, 3)]

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        of = {h: c for h, c in counts[n].items() if h[:-1] == g[:-1]}
        if not of:
            return p(g[1:])
        cut = lambda c: cuts[n][min(c, 3) - 1]
        c = counts[n].get(g)
        return ((c - cut(c) if c else 0) + sum(map(cut, of.values())) * p(g[1:])) / sum(of.values())

    texts = train + other
    want = [np.exp(-sum(np.log(p(pad(t)[i : i + 5])) for i in range(len(t))) / max(1, len(t))) for t in texts]
    model = quality.KneserNey(quality.count_grams(spark.createDataFrame([(bytearray(t),) for t in train], "data binary")))
    rows = docs(spark, [(i, t.decode()) for i, t in enumerate(texts)])
    got = {r["id"]: r["perplexity"] for r in quality.perplexities(rows, model, "doc_id", "text", (), 16).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-5)


def test_internal_names_may_be_columns(spark):
    d = docs(spark, EDGE).select("*", *[F.lit("x").alias(c) for c in ("id", "_id", "key", "fp", "norm", "bucket", "slot", "order", "size", "out", "spans", "plain", "_what", "_gone", "_key", "data", "toxic", "own", "_lang")])
    n = len(EDGE)
    assert quality.quality(d, d.select("doc_id").limit(2)).count() == n
    assert simhash.near_copies(d).count() == n and exact.exact_groups(d).count() == n and mix.mix(d).count() == n
    assert pii.find_personal_data(d).count() == n and substring.remove_repeats(d).count() == n
    assert toxic.fit(d, d.select("doc_id", F.lit(1).alias("toxic"))).terms == []
    from screenloom.llm import common

    assert common.one_per_row(d, F.col("text")).columns == d.columns
    assert common.chosen_rows(d, d.select("doc_id", F.lit(1).alias("k")).limit(1), F.lit(2)).columns == d.columns


def test_schedule_is_exact_and_balanced_in_every_prefix(spark):
    quota = [600, 250, 100, 50]
    slots = mix.schedule(spark, [0, 600, 850, 950], 1000).orderBy("slot").toPandas()
    assert slots.line.value_counts().sort_index().tolist() == quota and slots.slot.is_unique
    for n in (50, 137, 400, 777):
        have = slots.head(n).line.value_counts().reindex(range(4), fill_value=0)
        assert all(abs(have[i] - n * q / 1000) <= 12 for i, q in enumerate(quota))
    for _, one in slots.groupby("line"):
        assert one["rank"].tolist() == list(range(len(one)))
    # Taken words of sources stay in proportion over the schedule: no source is read first.
    d = pd.DataFrame({"i": range(400)})
    got = mix.mix(docs(spark, [(int(i), f"w{i} " * 50) for i in d.i]), block=64).toPandas()
    early = got.sort_values("first_slot").head(200).source.value_counts(normalize=True)
    assert got.first_slot.notna().any() and early.min() > 0.1


def test_addresses_with_zero_parts(spark):
    text = "10.0.0.1 192.168.0.7 0.0.0.0 000.00.0.1 010.020.030.040 256.0.0.1 1.2.3.0256 8.8.8.8"
    got = pii.find_personal_data(docs(spark, [(1, text)])).first()["spans"]
    assert [s["value"] for s in got] == ["10.0.0.1", "192.168.0.7", "0.0.0.0", "000.00.0.1", "010.020.030.040", "8.8.8.8"]


def test_disclosing_terms_match_brute_force(spark):
    rng = np.random.default_rng(9)
    people = ["an@x.org", "bo@y.org", "cy@z.org"]
    rows = []
    for i in range(60):
        who = i % 5
        words = [f"common{x}" for x in rng.integers(0, 6, 5)] + ([f"Mark{who}"] if rng.random() < 0.8 else []) + ([people[who]] if who < 3 and rng.random() < 0.7 else [])
        rows.append((i, " ".join(rng.permutation([*words, f"only{i}"]).tolist())))
    got = pii.find_personal_data(docs(spark, rows)).collect()
    split = [(set(re.findall(r"\S+@\S+", t)), {w.rstrip("0123456789") + w[len(w.rstrip("0123456789")) :] for w in t.split() if "@" not in w}) for _, t in rows]
    # A term has letters only, so words that end in a digit are none.
    assert all(s["kind"] != 4 for r in got for s in r["all_spans"])
    name = lambda k: "abcdefghij"[int(k)]
    rows = [(i, re.sub(r"(Mark|common|only)([0-9]+)", lambda m: m[1] + "".join(map(name, m[2])), t)) for i, t in rows]
    split = [(set(re.findall(r"\S+@\S+", t)), {w for w in t.split() if "@" not in w}) for _, t in rows]
    named = set()
    for e in people:
        n_e = sum(e in s for s, _ in split)
        for t in set().union(*(w for _, w in split)):
            n_t, both = sum(t in w for _, w in split), sum(e in s and t in w for s, w in split)
            if both >= 3 and both / n_t >= 0.5 and np.log(both / n_t * len(rows) / n_e) / np.log(len(rows) / n_e) >= 0.75:
                named.add(t)
    assert named
    for r in pii.find_personal_data(docs(spark, rows)).collect():
        found = [(s["start"], s["value"]) for s in r["all_spans"] if s["kind"] == 4]
        assert found == [(m.start(), m[0]) for m in re.finditer(r"\S+", r["text"]) if m[0] in named]


def test_records_have_their_length_and_digest(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").unionByName(spark.createDataFrame([(-1, "u", "é" * 400_000), (-2, "v", None)], "page_id long, url string, html string"))
    archive = warc.write_archive(pages)
    records = {r["record_id"]: bytes(r["record"]) for r in warc.read_records(archive).collect()}
    index = {r["record_id"]: r for r in warc.read_index(archive).collect()}
    for r in pages.collect():
        head, _, rest = records[r["page_id"]].partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        payload = (r["html"] or "").encode()
        response = fields["WARC-Type"] == "response"
        assert rest == (payload if response else b"") + b"\r\n\r\n" and int(fields["Content-Length"]) == len(rest) - 4
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert index[r["page_id"]]["sound"] and index[r["page_id"]]["payload_bytes"] == len(payload)
    broken = warc.Archive(archive.payloads, archive.headers.withColumn("header", F.regexp_replace("header", "Content-Length: ", "Content-Length: 1")))
    assert not any(r["sound"] for r in warc.read_index(broken).collect())


def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline

    d = pd.read_parquet(f"{DIR}/documents.parquet")
    scorer = queries.toxicity_model(spark, DIR).scorer()
    left = d[[scorer.score(t) < queries.TOXIC_AT for t in d.text]].sort_values("doc_id")
    left = left[~left.text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)).duplicated()]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in left.text)]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    left = left[[g == i for i, g in enumerate(group)]]
    bench = [re.findall(r"[^\W_]+", t.lower()) for t in pd.read_parquet(f"{DIR}/benchmark.parquet").text]
    seeds = [(w, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for w in bench if len(w) >= 5]

    def clean(text):
        w = re.findall(r"[^\W_]+", text.lower())
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        # Tiles cover no word that no shared seed covers, so few seeds rule a test out.
        return not any(5 * len(s & own) >= 0.8 * len(t) and greedy_tiles(t, w, 5) >= 0.8 * len(t) for t, s in seeds)

    left = left[left.text.map(clean)]
    got = corpus_pipeline.run(spark, DIR).toPandas()
    assert sorted(got.doc_id) == sorted(left.doc_id)
    con = duckdb.connect()
    con.register("documents", left[["doc_id", "text", "source"]])
    want = con.execute(queries.SQL["op3_mix"]).fetchdf()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(want.doc_id, want.taken))
