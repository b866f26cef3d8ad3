"""Fill-in-the-middle against a plain computation per document, and its boundary lists against all offsets."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import fill_middle as M

TEXTS = [None, "", "a", "plain text of some words", "über naïve 日本語 🙂🙂", "holds <P> itself", "<S>", "a<", "<S", "x" * 70_000, "日本" * 9_000, "\r\n\t \x00"]


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    i, j = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text, text
    p, m, s = text[:i], text[i:j], text[j:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, len(text), form, i, j - i, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.integers(1, 40))
def test_boundary_lists_give_every_offset(text, times):
    data = (text * times).encode()
    got = M.Boundaries(data)
    want = [*(k for k, b in enumerate(data) if b & 0xC0 != 0x80), len(data)]
    assert got.n == len(text) * times and [got[k] for k in range(got.n + 1)] == want


def test_lists_are_as_small_as_the_method_says(monkeypatch):
    monkeypatch.setattr(M, "STEP", 1000)
    for text in ("a" * 100_000, "日" * 50_000, "🙂" * 30_000, "aé" * 40_000):
        data = text.encode()
        got = M.Boundaries(data)
        assert 8 * (len(got.high) + len(got.low)) <= (2 + np.log2(len(data) / len(text))) * (len(text) + 1) + 24
        assert got[len(text) // 2] == len(text[: len(text) // 2].encode()) and got[len(text)] == len(data)


def test_documents_of_all_kinds(spark):
    rows = [(i, t, "c", "c") for i, t in enumerate(TEXTS * 8)] + [(None, "no id", "c", "c"), (3, TEXTS[3], "c", "c"), (3, TEXTS[3], "c", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, __key string").repartition(5)
    got = [tuple(r) for r in M.transform(docs, outputs=("output", "restored")).collect()]
    assert sorted(map(repr, got)) == sorted(repr(plain(i, t)) for i, t, *_ in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_copies_are_dealt_and_stay_whole(spark):
    rows = [(i, "one text that all but a few documents hold" if i % 9 else f"text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.transform(docs, outputs=("output", "restored"), part_rows=50)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain(*r)) for r in rows)


def test_texts_of_one_digest_have_an_entry_each(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("00"))
    rows = [(i, f"text {i % 3}") for i in range(30)]
    got = M.transform(spark.createDataFrame(rows, "doc_id long, text string"), outputs=("output", "restored"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain(*r)) for r in rows)


def test_empty_table(spark):
    assert M.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
