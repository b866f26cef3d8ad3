"""Quartile bucket digests against a plain count, and documents against their successors by brute force."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bucket_digest as D


def plain_counts(data):
    x, out = data + bytes(4), np.zeros(D.BUCKETS, np.int64)
    f = [int(v) for v in D.FACTORS]
    for i in range(len(data)):
        for kind, places in enumerate(D.TRIPLETS):
            h = sum(x[i + p] * f[k] for k, p in enumerate(places)) + f[3] * (kind + 1)
            h &= 0xFFFFFFFF
            h ^= h >> 15
            out[(h * f[4] & 0xFFFFFFFF) >> 22] += 1
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=6))
def test_counts_equal_plain_ones(parts):
    got = D.triplet_counts([(p, len(p)) for p in parts])
    assert (got == np.stack([plain_counts(p) for p in parts])).all()


def test_long_texts_in_steps_and_parts_of_texts(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 5_000, np.uint8).tobytes()
    want = plain_counts(data)
    monkeypatch.setattr(D, "STEP", 700)
    assert (D.triplet_counts([(data, len(data))])[0] == want).all()
    two = D.triplet_counts([(data[:3_000], 2_996), (data[2_996:], 2_004)])
    assert (two.sum(0) == want).all()


def test_likeness_is_bounded_and_falls_with_the_edit():
    rng = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(3_000)]
    text = lambda: " ".join(rng.choice(words, 900))
    a, b = text(), text()
    mixed = [a[: len(a) - len(a) * k // 6] + b[: len(b) * k // 6] for k in range(7)]
    near = [D.likeness(D.fingerprint(a.encode()), D.fingerprint(m.encode())) for m in mixed]
    assert near[0] == 1.0 and all(x > y for x, y in zip(near[:5], near[1:6], strict=True)) and 0 <= near[6] < 0.5
    most = D.difference(bytes([255, 255]) + bytes([255]) * (D.BUCKETS // 4), bytes(2 + D.BUCKETS // 4))
    assert most == 3 * D.BUCKETS + 30 + D.MOST_LENGTH


def brute(rows):
    out = []
    for k, (doc_id, text, _) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        made = text[: len(text) - n] + after[:n]
        a, b, c = (D.fingerprint(x.encode()) for x in (text, made, after))
        out.append((doc_id, len(text), hashlib.sha256(made.encode()).hexdigest(), a.hex(), b.hex(), D.likeness(a, b), D.likeness(a, c)))
    return out


def test_edited_equals_brute_force(spark):
    rows = [(i, f"document {i} " * (i % 40 + 1)) for i in range(0, 300, 3)] + [(None, "no id"), (None, None), (8, ""), (8, None), (8, "same"), (8, "same"), (9, "🙂é" * 400), (10, "x" * 200_000)]
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, part string, h string").repartition(6)
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("hash", F.xxhash64("t")).collect()
    order = sorted((tuple(r) for r in hashed), key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1].encode()))
    # many ranges, so that documents meet across tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = D.edited(docs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(order)))


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in D.edited(one).collect()] == [(1, 6, hashlib.sha256(b"abcdab").hexdigest())]
    assert D.edited(one.where("doc_id > 1")).collect() == [] and D.fingerprints(one.where("doc_id > 1")).collect() == []


def test_fingerprints_and_pairs(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, "some words here"), (3, None), (None, "other")], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in D.fingerprints(docs).collect()}
    assert prints[1] == prints[2] == D.fingerprint(b"some words here").hex() and len(set(prints.values())) == 3
    pairs = spark.createDataFrame([(prints[1], prints[2]), (prints[1], prints[3]), (None, prints[1])], "a string, b string")
    assert [r.near for r in D.compared(pairs, "a", "b").collect()][:2] == [1.0, D.likeness(bytes.fromhex(prints[1]), bytes.fromhex(prints[3]))]
