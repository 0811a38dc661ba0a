import hashlib

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkstrata.llm import shingle_sets, simhash_blocks, simhash_cover, substring_dedup
from sparkstrata.llm.common import group_labels
from sparkstrata.llm.components import connected_components
from sparkstrata.llm.ordered import in_ranges


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """Component of each (id, fingerprint) by comparing all pairs."""
    n = len(prints)
    pairs = [(i, j) for i in range(n) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= 3]
    label = group_labels(n, np.array([i for i, _ in pairs], int), np.array([j for _, j in pairs], int))
    out = {}
    for k in range(n):
        out.setdefault(label[k], []).append(prints[k][0])
    return {k: min((d for d in out[label[k]] if d is not None), default=None) for k in range(n)}


def test_simhash_groups_equal_all_pairs(spark, docs):
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash_cover.near_groups(docs).collect()), key=str)
    own = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    label = plain_groups(own)
    assert got == sorted(((d, f, label[k]) for k, (d, f) in enumerate(own)), key=str)


def test_large_buckets_are_dealt_again(spark):
    r = np.random.default_rng(1)
    base = int(r.integers(1 << 62))
    prints = {base ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 7)), replace=False)) for _ in range(300)}
    rows = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "fp long, id long")
    want = plain_groups([(k, p) for k, p in enumerate(sorted(prints))])
    for bucket in (8, 1024):
        got = {x.node: x.component for x in connected_components(simhash_cover.near_edges(df, bucket)).collect()}
        assert {k: got.get(k, k) for k in want} == want


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=3))
def test_every_close_pair_meets_in_a_table(x, bits):
    y = x ^ sum(1 << b for b in bits)
    assert any(x & m == y & m for m in simhash_cover.MASKS)
    assert all(any(x & f == y & f for f in simhash_cover.FINER[k]) for k, m in enumerate(simhash_cover.MASKS) if x & m == y & m)


def test_masks_leave_bounded_buckets():
    assert max(64 - f.bit_count() for row in simhash_cover.FINER for f in row) <= 16


def test_keep_one(docs, no_docs):
    kept = simhash_cover.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(None) == 2
    assert not {100, 101, 102} & set(ids) and {0, 1, 2} <= set(ids)
    assert simhash_cover.keep_one(no_docs).count() == 0
    assert simhash_cover.near_groups(no_docs).count() == 0


def plain_shingles(text, k=5):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {b" ".join(w)}


@pytest.mark.parametrize("block", [1 << 21, 2000])
def test_copies_equal_all_pairs_by_jaccard(spark, block):
    r = np.random.default_rng(14)
    texts = []
    for n in (40, 120, 300, 700):
        for _ in range(4):
            base = [f"w{x}" for x in r.integers(0, 5000, n)]
            texts += [" ".join(base)] * 2
            for edits in (1, 1, 2, 3, 5, 8, 14):
                own = list(base)
                for at in r.choice(n, max(1, edits * n // 200), replace=False):
                    own[at] = f"x{r.integers(1000)}"
                texts.append(" ".join(own[: n - int(r.integers(0, 4))]))
    texts = [texts[k] for k in r.permutation(len(texts))]
    sets = [plain_shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    unequal = [(i, j) for i, j in pairs if sets[i] != sets[j]]
    assert len(unequal) > 100 and any(len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j]) for i, j in unequal)
    label = group_labels(len(sets), np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in shingle_sets.copy_groups(docs, block=block).collect()}
    assert got == dict(enumerate(label.tolist()))
    if block > 2000:
        assert {x.doc_id for x in simhash_cover.keep_one(docs).collect()} == set(label.tolist())


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_components(spark, most):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 80, (60, 2))] + [(200, k) for k in range(201, 240)] + [(k, k + 1) for k in range(300, 330)] + [(5, 5)]
    nodes = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    label = group_labels(len(nodes), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    want = {x: nodes[label[k]] for k, x in enumerate(nodes)}
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), most).collect()}
    assert all(got.get(k, k) == v for k, v in want.items()) and len(got) == len(set(got))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranges_are_ordered_and_split_ties(spark):
    keys = [(None if i % 5 < 3 else i * 37 % 101, i * 7919 % 1009) for i in range(1000)]
    df = spark.createDataFrame(keys, "k int, h int").repartition(3)
    rows = in_ranges(df, ["k", "h"], []).withColumn("at", F.spark_partition_id()).collect()
    assert all(r.part == r["at"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.part, []).append((-1 if r.k is None else r.k, r.h))
    assert [x for p in sorted(by) for x in by[p]] == sorted((-1 if k is None else k, h) for k, h in keys)
    assert max(map(len, by.values())) < 2 * len(keys) / 4  # 600 rows have no key


def test_fingerprints_of_edits(spark, docs, no_docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    got = simhash_blocks.with_edits(docs).collect()
    assert len(got) == len(rows)
    found = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.hi, r.lo) for r in got)
    want = []
    for k, (d, t) in enumerate(rows):
        h, n = len(t) // 2, rows[(k + 1) % len(rows)][1]
        hi, lo = (simhash_blocks._signed(x) for x in simhash_blocks.fingerprint(t))
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest(), hi, lo))
    assert found == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long_ = [r for r in got if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long_]) > np.mean([r.near_next for r in long_])
    assert simhash_blocks.with_edits(no_docs).count() == 0
    lone = spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")
    assert simhash_blocks.with_edits(lone).first().near_next == 1.0


def test_fingerprint_is_the_weighted_vote():
    text = "The quick Brown fox the quick élan fox"
    words = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(w) for w in words]
    weight = [min(len(w), 16) ** 1.5 for w in words]
    mask = (1 << 64) - 1

    def spread(x):
        x ^= x >> 32
        x = x * 0x9E3779B97F4A7C15 & mask
        x ^= x >> 29
        x = x * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    terms = {}
    for x, w in zip(h, weight):
        terms.setdefault(x, [w, 0])[1] += 1
    for a, b, v, w in zip(h, h[1:], weight, weight[1:]):
        terms.setdefault(spread((a * 0x9E3779B97F4A7C15 + b) & mask), [(v + w) / 2, 0])[1] += 1
    votes = {x: w * (1 + np.log(n)) for x, (w, n) in terms.items()}
    for got, salt in zip(simhash_blocks.fingerprint(text), (0x2545F4914F6CDD1D, 0xA0761D6478BD642F)):
        for bit in range(64):
            ones = sum(w for x, w in votes.items() if spread(x ^ salt) >> bit & 1)
            assert abs(ones * 2 - sum(votes.values())) < 1e-3 or (got >> bit & 1) == (ones * 2 > sum(votes.values()))


def test_edits_of_hostile_rows(spark):
    rows = [(None, "b c"), (None, "a"), (None, None), (2, "x" * 70_000), (2, "x" * 70_000), (1, ""), (1, "a b c d")]
    got = simhash_blocks.with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(((d if d is not None else -1, t or "") for d, t in rows), key=lambda x: (x[0], x[1]))
    want = []
    for k, (d, t) in enumerate(order):
        h = len(t) // 2
        want.append((d, hashlib.sha256((t[: len(t) - h] + order[(k + 1) % len(order)][1][:h]).encode()).hexdigest()))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.edited_sha256) for r in got) == sorted(want)
    found = simhash_blocks.near_groups(spark.createDataFrame([], "doc_id long, hi long, lo long"))
    assert found.count() == 0
    ties = spark.createDataFrame([(5, 7, 7), (3, 7, 7), (None, 7, 7), (None, 1 << 62, -1)], "doc_id long, hi long, lo long")
    assert [tuple(x) for x in simhash_blocks.near_groups(ties).collect()] == [(7, 7, 3)]


def test_block_tables_find_all(spark):
    r = np.random.default_rng(5)
    base = [(int(r.integers(1 << 62)), int(r.integers(1 << 62))) for _ in range(15)]
    prints = set(base)
    for h, l in base:
        for _ in range(8):
            x, y = h, l
            for b in r.choice(128, int(r.integers(0, 5)), replace=False):
                x, y = (x ^ (1 << int(b)), y) if b < 63 else (x, y ^ (1 << int(b) % 63))
            prints.add((x, y))
    prints = sorted(prints)
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(prints)], "doc_id long, hi long, lo long")
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i][0] ^ prints[j][0]).bit_count() + (prints[i][1] ^ prints[j][1]).bit_count() <= 3]
    label = group_labels(len(prints), np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    for bucket in (3, 1024):
        got = {(x.hi, x.lo): x.near_id for x in simhash_blocks.near_groups(df, bucket=bucket).collect()}
        assert got == {p: label[k] for k, p in enumerate(prints)}


def plain_removal(rows, window=13):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            key = b" ".join(w[k : k + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[b" ".join(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeated_windows(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substring_dedup.dedup_digest(docs).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == plain_removal([x for x in rows if x[0] is not None])
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert sum(r.n_removed for r in got) > 400
    assert substring_dedup.dedup_digest(no_docs).count() == 0


def test_remove_repeats_keeps_the_rest_of_the_text(spark):
    p = " ".join(f"w{k}" for k in range(20))
    d = spark.createDataFrame([(1, f"head\n{p}  tail", "x"), (2, f"other  bend\n\n{p} end", "y"), (3, p, "z"), (4, None, "n")], "doc_id long, text string, at string").withColumn("rest", F.lit(1)).withColumn("th", F.lit("q"))
    out = substring_dedup.remove_repeats(d)
    assert out.columns == d.columns
    got = {r.doc_id: (r.text, r["at"]) for r in out.collect()}
    assert got == {1: (f"head\n{p}  tail", "x"), 2: ("other  bend\n\nend", "y"), 4: ("", "n")}


@pytest.mark.parametrize("hot", [0, 1 << 40])
def test_extended_prefixes_give_the_same_repeats(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1 << 40)
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 4096)
    got = sorted(tuple(x) for x in substring_dedup.dedup_digest(docs).collect() if x.doc_id is not None)
    assert got == plain_removal([(x.doc_id, x.text) for x in docs.collect() if x.doc_id is not None])


def test_suffix_nodes_are_repeats():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    start = np.sort(rng.choice(380, 200, replace=False))
    owner = rng.integers(0, 50, 200)
    order, least = substring_dedup.suffix_nodes(words, start, owner, 5)
    keys = [(*words[s : s + 5].tolist(), o) for s, o in zip(start, owner)]
    assert [keys[k] for k in order] == sorted(keys)
    for k, x in zip(order, least):
        assert x == min(o for key, o in zip(keys, owner) if key[:5] == keys[k][:5])
    assert [len(x) for x in substring_dedup.suffix_nodes(words, start[:0], owner[:0], 5)] == [0, 0]


def test_pipeline_takes_candidates_from_covering_tables(spark, monkeypatch):
    """Where the tables of minima find nothing, fingerprints within 3 bits still do, and the sets decide."""
    monkeypatch.setattr(shingle_sets, "table_keys", lambda s: np.arange(32) + shingle_sets.set_print(s))
    base = [f"w{x}" for x in np.random.default_rng(5).integers(0, 5000, 900)]
    phrase = " ".join(["five words say it all"] * 400)
    texts = [" ".join(base), " ".join(base[:-1] + ["other"]), " ".join(base[::-1]), phrase + " " + " ".join(base[:60]), phrase + " " + " ".join(base[60:120])]
    prints = [plain_fingerprint(t, 5) for t in texts]
    assert prints[0] != prints[1] and (prints[0] ^ prints[1]).bit_count() <= 3 and (prints[3] ^ prints[4]).bit_count() <= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {0, 2, 3, 4}
