"""Alignment of two tokenizers against the libraries and plain loops."""

import bisect
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import token_alignment as L
from tidemark.llm.token_counts import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "The tide comes in.", "The tide goes out.", "The tide comes in.", "  two  spaces\n\n", "▁ is a space there", "a <|endoftext|> b <s> </s> <unk>",
    "ünï 💡\x00漢字かな\r\n\t x  y   " * 9, "日本語のテキスト" * 60, "\U0001f468‍\U0001f469" * 50, "1234567890" * 30, "ก็ด้" * 80, "x" * 3_000,
]


def plain(rows):
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_alphabet())}

    def of_a(i):
        return bytes(back[c] for c in one.id_to_token(i))

    def of_b(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    held, n_docs = [], Counter()
    for doc_id, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        data = (" " + (text or "")).encode()
        if not text or b"".join(map(of_a, a)) != data or b"".join(map(of_b, b)) != data:
            held.append((doc_id, None))
            continue
        ends = [np.cumsum([len(f(i)) for i in x]).tolist() for f, x in ((of_a, a), (of_b, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, (ids, e) in enumerate(zip((a, b), ends, strict=True)):
            for i, at in zip(ids, e, strict=True):
                groups[bisect.bisect_left(cuts, at)][side].append(i)
        links = [(x, y) for p, q in groups for x in p for y in q]
        n_docs.update(set(links))
        held.append((doc_id, (len(a), len(b), groups, links)))
    most = defaultdict(int)
    for (x, _), n in n_docs.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, found in held:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(n_docs[x] == most[x[0]] for x in links), sum(n_docs[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1, 1 << 24])
def test_documents_equal_plain_loops(spark, block):
    rows = [*enumerate(TEXTS), (None, "no id"), (4, "The tide comes in."), (5, "a <|endoftext|> b <s> </s> <unk>")]
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, block string, a string").repartition(3)
    aligned = L.alignments(docs, A, public_tokenizers.PATTERN, B, block)
    got = L.scored(aligned, L.pair_counts(aligned)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))


def test_empty_table(spark):
    assert L.align(spark.createDataFrame([], "doc_id long, text string"), A, public_tokenizers.PATTERN, B).collect() == []


@pytest.mark.parametrize(("long_group", "together"), [(1 << 14, 1 << 21), (1, 1 << 21), (8, 3), (1 << 14, 5)])
def test_links_by_groups_long_and_short(monkeypatch, long_group, together):
    monkeypatch.setattr(L, "LONG_GROUP", long_group)
    monkeypatch.setattr(L, "LINKS", together)
    rng = np.random.default_rng(3)
    width_a, width_b = np.array([1, 2, 3, 5]), np.array([1, 2, 4])

    def tokens(width, size):
        ids, left = [], size
        while left:
            i = int(rng.choice(np.flatnonzero(width <= left)))
            ids.append(i)
            left -= width[i]
        return ids

    docs = [(tokens(width_a, n), tokens(width_b, n)) for n in (7, 0, 40, 0, 1, 25)]
    a, b = (np.array([i for d in docs for i in d[k]], np.int32) for k in (0, 1))
    n_a, n_b = (np.array([len(d[k]) for d in docs]) for k in (0, 1))
    found = L.Alignment(a, n_a, width_a, b, n_b, width_b)
    want, n_groups, n_links = Counter(), [], []
    for doc, (x, y) in enumerate(docs):
        cuts = sorted(set(np.cumsum(width_a[x]).tolist()) & set(np.cumsum(width_b[y]).tolist())) if x else []
        n_groups.append(len(cuts))
        before = sum(want.values())
        for i, e in zip(x, np.cumsum(width_a[x]) if x else [], strict=True):
            for j, f in zip(y, np.cumsum(width_b[y]), strict=True):
                want[doc * 12 + i * 3 + j] += bisect.bisect_left(cuts, e) == bisect.bisect_left(cuts, f)
        n_links.append(sum(want.values()) - before)
    keys, times = found.links(3, 12)
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == +want
    assert found.n_groups.tolist() == n_groups and found.n_links.tolist() == n_links
