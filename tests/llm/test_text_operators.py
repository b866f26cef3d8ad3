"""Token counts, SentencePiece, packing, media and SimHash against the libraries or brute force."""

import functools
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import media, packing, sentencepieces, simhash, token_counts

WORDS = ["the", "Tide", "comes", "in", "über", "naïve", "100", "don't", "日本語", "🙂🙂", "aaaaaaaa", "<|endoftext|>", "▁x", "\x1cq"]
TEXTS = [
    None, "", " ", "a", "  two  spaces ", "\n\n\ttabs\r\n", "The tide comes in. The tide goes out.", "The tide comes in. The tide goes out.",
    " ".join(WORDS), "▁▁ ▁", "x" * 3000, " ".join(WORDS * 400), "<|endoftext|><|endoftext|> end", "\x00\x1c\x1f\x85\u2003 odd",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", "c", "c", 0), (7, "a repeated id", "c", "c", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, n_tokens string, start int")


def plain(t):
    return t or ""


def test_token_counts_equal_the_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, path, public_tokenizers.PATTERN).collect()
    want = [(r.doc_id, len(plain(r.text).encode()), n := len(t.encode(plain(r.text), add_special_tokens=False).ids), n > 512) for r in docs.collect()]
    assert Counter(map(tuple, got)) == Counter(want)


@functools.cache
def counter_and_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.TokenCounter(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8))
def test_token_counts_of_any_text(texts):
    counter, library = counter_and_library()
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_sentencepiece_equals_the_library_and_spans_tile_the_text(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepieces.encode(docs, path, ("ids", "starts", "ends", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"))
    by_text = {}
    for r in docs.collect():
        by_text.setdefault(r.doc_id, []).append(plain(r.text))
    for r in rows.collect():
        match = [t for t in by_text[r.doc_id] if sp.encode(t) == list(r.ids)]
        assert match
        data = match[0].encode()
        assert r.decoded == sp.decode(list(r.ids)) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        at = 0
        for a, b in zip(r.starts, r.ends, strict=True):
            assert a == at and b >= a
            at = b
        assert at == len(data) or not r.ids
    back = sentencepieces.decode(rows.select("doc_id", "ids"), path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.decoded) for r in rows.collect())


def test_packing_keeps_every_token_once(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("doc_id").coalesce(1)
    want = {r.doc_id: [*t.encode(plain(r.text), add_special_tokens=False).ids, 1] for r in some.collect()}
    rows = packing.pack(some, path, 1, window=256, block_tokens=1 << 20).collect()
    got, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got.setdefault(r.doc_id, [])) and r.length == len(r.token_ids) and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id] += r.token_ids
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 256
    crc = packing.pack(some, path, 1, window=256, block_tokens=1 << 20, ids="crc32").collect()
    by = {(r.doc_id, r.start): r.token_ids for r in rows}
    assert all(c.ids_crc32 == zlib.crc32(np.array(by[c.doc_id, c.start], "<u4").tobytes()) for c in crc)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_is_what_a_plain_scan_gives(sizes):
    sequence, offset, n = packing.best_fit(np.array(sizes, np.int64), 64)
    room, opened = [], []
    for i in np.argsort(-np.array(sizes, np.int64), kind="stable"):
        fits = [k for k in range(len(room)) if room[k] >= sizes[i]]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= sizes[i]
        else:
            room.append(64 - sizes[i])
            opened.append(i)
    used = np.zeros(n, np.int64)
    np.add.at(used, sequence, np.array(sizes, np.int64))
    assert sorted(64 - used) == sorted(room)


def test_media_round_trip_and_shots(docs):
    rows = media.features(media.to_media(docs)).collect()
    want = Counter()
    for r in docs.collect():
        raw = plain(r.text).encode()
        p = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        want[r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    cut = media.clips(media.to_media(docs)).collect()
    per = {}
    for r in sorted(cut, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.clip)):
        per.setdefault(r.doc_id, []).append((r.first_frame, r.end_frame, r.start_sec))
    assert all(x[0][0] == 0 and all(s == f / media.FPS for f, _, s in x) for x in per.values())


def test_a_shot_begins_where_the_picture_changes():
    dark, light = np.zeros((10, 32), np.int64), np.zeros((10, 32), np.int64)
    dark[:, 0] = light[:, 31] = 64
    assert media.shots(np.concatenate([dark, light])) == [(0, 10), (10, 20)]


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=9000))
def test_any_payload_survives_the_file(raw):
    p = raw + b"\0" * (-len(raw) % 64)
    assert media.read_media(media.write_avi(p))["payload"] == p


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_equal_brute_force():
    for t in map(plain, TEXTS):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("block", [3, 8192])
def test_links_join_what_brute_force_joins(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = [int(b) for b in base]
    for _ in range(160):  # chains of near copies
        x = prints[rng.integers(len(prints))]
        for k in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= 1 << int(k)
        prints.append(x)
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df, 4, block)).collect()}
    want = brute_components(prints)
    groups = {}
    for x, w in zip(signed.tolist(), want, strict=True):
        groups.setdefault(w, set()).add(x)
    got = {}
    for x in signed.tolist():
        got.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(1)
    code = simhash.GolayAnchors(2)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(300):
        for k in rng.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1 << int(k))
    ra, xa = simhash.anchors(a.view(np.int64), code)
    rb, xb = simhash.anchors(b.view(np.int64), code)
    for i in range(300):
        assert set(xa[ra == i].tolist()) & set(xb[rb == i].tolist())


def test_near_duplicates_of_odd_rows(docs):
    rows = simhash.near_duplicates(docs).collect()
    source = docs.collect()
    prints = [brute_fingerprint(plain(r.text)) for r in source]
    root = brute_components(prints)
    least = {}
    for r, k in zip(source, root, strict=True):
        if r.doc_id is not None:
            least[k] = min(least.get(k, 1 << 60), r.doc_id)
    want = Counter((r.doc_id, f"{p:016x}", least.get(k)) for r, p, k in zip(source, prints, root, strict=True))
    assert Counter(map(tuple, rows)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    gone = {d for d, _, c in want if d is not None and d != c}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in source if r.doc_id not in gone)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0
    assert sentencepieces.encode(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0
    assert media.features(media.to_media(none)).count() == 0


def test_packing_gives_back_batches_bounded_by_tokens(monkeypatch):
    """Up to 20,000 pieces (8 million tokens) were one batch, which worker and executor held whole."""
    from types import SimpleNamespace

    import pyarrow as pa

    held = {}
    docs = SimpleNamespace(schema={"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))})
    docs.select = lambda *_: SimpleNamespace(mapInArrow=lambda run, _: held.update(run=run))
    monkeypatch.setattr(packing, "text_or_empty", lambda name: name)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing, "BATCH_TOKENS", 4096, raising=False)
    packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), separator=1)
    texts = ["one two three " * k for k in (900, 5, 1, 3000, 0)]
    found = list(held["run"](iter([pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["doc_id", "text"])])))
    assert max(sum(map(len, b.column("token_ids").to_pylist())) for b in found) <= 4096
    pieces = sorted((i, s, t) for b in found for i, s, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "token_ids")), strict=True))
    coder = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for k, text in enumerate(texts):
        assert [x for i, _, t in pieces if i == k for x in t] == [*coder.encode([text])[0].tolist(), 1]
