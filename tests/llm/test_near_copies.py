"""The pipeline's near-dedup against exact shingle similarity by brute force."""

import importlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import near_copies


def brute_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = [b if r == a else r for r in root]
    return {rows[r][0] for r in root}


def copies():
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 3000, 300)]
        rows.append(" ".join(base))
        for changes in (0, 1, 3, 5, 6, 7, 9, 14):  # a changed word takes five of about 300 shingles
            words = list(base)
            for k in rng.choice(300, changes, replace=False):
                words[k] = f"x{rng.integers(1 << 30)}"
            rows.append(" ".join(words))
    return [(i, t) for i, t in enumerate([*rows, "", "", "one two", "one two", "ONE two"])]


@pytest.mark.parametrize("block", [2, 256])
def test_near_copies_equal_brute_force(spark, block):
    rows = copies()
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = [r.doc_id for r in near_copies.keep_one(docs, block=block).collect()]
    assert None in got and {x for x in got if x is not None} == brute_kept(rows)


def test_the_stage_drops_copies_of_similarity_08(spark):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(importlib.import_module("corpus_pipeline").STAGES)["simhash near-dedup"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == brute_kept(rows)


def test_similar_counts_exactly():
    a = [np.arange(10, dtype=np.uint64), np.arange(8, dtype=np.uint64), np.arange(7, dtype=np.uint64), np.zeros(0, np.uint64)]
    assert near_copies.similar(a, None, Fraction(4, 5)) == [(0, 1), (1, 2)]
    assert near_copies.similar(a[:1], a[1:], Fraction(4, 5)) == [(0, 0)]


def test_no_documents(spark):
    assert near_copies.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    """A group of 256 copies of a long text whose sets don't fit one block, with columns of clashing names."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 3_000)]
    rows = [(i, " ".join(words[: 2_990 - i % 40] + [f"end{i}"])) for i in range(256)]
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, fp string, component_id string")
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", 20 * 8 * 3_000)
    seen, plain = [], near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", lambda df, what: seen.append((what, plain(df, what))) or seen[-1][1])
    assert [r.doc_id for r in near_copies.keep_one(docs).collect()] == [0]
    blocks = next(made for what, made in seen if what == "near-copy-blocks")[0]
    sizes = [r.n for r in blocks.selectExpr("aggregate(sets, 0L, (a, s) -> a + length(s.shingles)) AS n").collect()]
    assert len(sizes) >= 10 and max(sizes) < 3 * 20 * 8 * 3_000


@pytest.mark.parametrize(("common", "one", "two"), [(8, 1, 1), (80, 10, 10), (80, 0, 20)])
def test_sets_of_similarity_08_meet_at_an_anchor_of_their_fingerprints(common, one, two):
    """The stage named SimHash went by MinHash bands."""
    rng = np.random.default_rng(common + two)
    sets = [rng.integers(0, 1 << 63, common + one + two, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, dtype=np.uint64) for _ in range(400)]
    a = np.stack([near_copies.fingerprint(s[: common + one]) for s in sets])
    b = np.stack([near_copies.fingerprint(np.append(s[:common], s[common + one :])) for s in sets])
    votes = ((sets[0][: common + one, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
    assert int(a[0, 0]) == sum(1 << k for k, v in enumerate(votes.tolist()) if 2 * v > common + one)
    code = near_copies.GolayAnchors(1)
    sent = [set(zip(*(v.tolist() for v in near_copies.anchors(w, code)), strict=True)) for w in (a, b)]
    assert {row for row, _ in sent[0] & sent[1]} == set(range(400)) and len(sent[0]) < 400 * 80
    assert (np.bitwise_count(a ^ b)[:, : near_copies.CHECKED].sum(1) <= near_copies.NEAR).all()


@pytest.mark.parametrize("n", [1, 200, 900])
def test_joined_fingerprints_are_those_of_brute_force(n):
    """Above 256 rows a large group is met by a few of its rows first."""
    rng = np.random.default_rng(n)
    words = rng.integers(0, 1 << 63, (n, near_copies.CHECKED), dtype=np.uint64)
    for k in range(n // 2):
        words[n // 2 + k] = (words[0] if k % 3 else words[k // 9]) ^ np.packbits(rng.random(192) < 0.1).view(np.uint64)
    words = words[rng.permutation(n)]
    bits = np.bitwise_count(words[:, None] ^ words[None]).astype(int)
    near = (bits.sum(2) <= near_copies.NEAR) & (bits[:, :, :2].sum(2) <= near_copies.NEAR_TWO)

    def groups(pairs):
        root = list(range(n))
        for i, j in pairs:
            root = [root[i] if r == root[j] else r for r in root] if root[i] != root[j] else root
        return len(set(root)), {frozenset(k for k in range(n) if root[k] == r) for r in set(root)}

    i, j = near_copies.joined(np.ascontiguousarray(words.T))
    assert near[i, j].all() and len(i) < max(1, n)
    assert groups(zip(i.tolist(), j.tolist(), strict=True)) == groups(np.argwhere(np.triu(near, 1)).tolist())


def test_anchors_of_several_blocks_join_the_same(spark):
    rows = [(i, int(i), np.array([k] * near_copies.WORDS, "<u8").tobytes()) for i, k in enumerate([5, 5 ^ 7, 1 << 60, 5 ^ 1 << 9, 5 ^ 3, (1 << 60) + 1, 0xF0F0F0F0F0F0F0F])]
    distinct = spark.createDataFrame(rows, "least long, fp long, words binary")
    for block in (2, 1 << 15):
        found = {r.node: r.root for r in near_copies.components(near_copies.candidates(distinct, block)).collect()}
        assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
