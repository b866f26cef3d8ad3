"""The packing's word tokenizer against the library on any text."""

import functools

import public_tokenizers
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing


@functools.cache
def coder_and_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.WordTokenizer(path), Tokenizer.from_file(path)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8))
@example(["İstanbul", "DİYARBAKIR İ"])
def test_word_ids_of_any_text(texts):
    coder, library = coder_and_library()
    assert [x.tolist() for x in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_ids_of_every_character():
    coder, library = coder_and_library()
    for lo in range(0, 0x110000, 1 << 12):
        texts = [f"a{chr(c)}b {chr(c)}" for c in range(lo, lo + (1 << 12)) if not 0xD800 <= c < 0xE000]
        got = coder.encode(texts)
        assert [t for t, x in zip(texts, got, strict=True) if x.tolist() != library.encode(t, add_special_tokens=False).ids] == []
