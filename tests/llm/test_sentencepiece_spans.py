"""Own normalisation, ids and spans against the library, for the public model and with character maps put into it."""

import functools

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from tidemark.llm import sentencepieces

KINDS = ["public", "nfkc", "nfkc squeezed", "nmt_nfkc_cf suffix", "symbols"]


@functools.cache
def encoder(kind, folder):
    """The public model with another normalisation: (own encoder, library)."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    if kind.startswith("n"):
        rules = sentencepiece.SentencePieceNormalizer(rule_name=kind.split()[0])
        spec.normalizer_spec.precompiled_charsmap = sentencepiece_model_pb2.ModelProto.FromString(rules.serialized_model_proto()).normalizer_spec.precompiled_charsmap
        spec.normalizer_spec.remove_extra_whitespaces = "squeezed" in kind or "suffix" in kind
        spec.trainer_spec.treat_whitespace_as_suffix = "suffix" in kind
    if kind == "symbols":
        for i, word in ((300, "tide"), (301, "ti de")):
            spec.pieces[i].piece, spec.pieces[i].type = word, 4
    path = f"{folder}/{kind.replace(' ', '-')}.model"
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    return sentencepieces.OffsetEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("models"))


ODD = ["", " ", "   a  b ", "▁▁ ▁", "ﬁne ①②  ㍿", "Ａ Ｂ　Ｃ", "é é ﷺ", "tab\tnew\nline​", "ti de tide", "­ soft", "ẞß İ", "가각가", "🙂 日本"]


@pytest.mark.parametrize("kind", KINDS)
@settings(max_examples=80, deadline=None)
@example(ODD)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁aﬁ①　")), max_size=30), max_size=6))
def test_ids_and_normalised_text_equal_the_library(kind, folder, texts):
    coder, library = encoder(kind, folder)
    assert [coder.normalize(t)[0].decode() for t in texts] == [library.normalize(t) for t in texts]
    assert [x.tolist() for x in coder.encode(texts)] == library.encode(texts)


@pytest.mark.parametrize("kind", KINDS)
def test_spans_equal_the_library_s(kind, folder):
    coder, library = encoder(kind, folder)
    for text in [*ODD, " ".join(ODD) * 3]:
        norm, place = coder.normalize(text)
        ids = coder.encode([text])[0]
        spans = coder.spans(norm, place, ids).tolist()
        want = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert [w[0] for w in want] == ids.tolist()
        # of a character's byte pieces the library gives all but the last an empty span; here each has its byte
        assert [(a, b) for (a, b), w in zip(spans, want, strict=True) if not coder.library.is_byte(w[0])] == [w[1:] for w in want if not coder.library.is_byte(w[0])]


@pytest.mark.parametrize("kind", KINDS[:2])
def test_every_character_normalises_like_the_library(kind, folder):
    coder, library = encoder(kind, folder)
    chars = [f"x{chr(c)}y" for c in [*range(0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x11000), *range(0x1D000, 0x20000)]]
    assert [t for t in chars if coder.normalize(t)[0].decode() != library.normalize(t)] == []
    assert [t for t, x, w in zip(chars, coder.encode(chars), library.encode(chars), strict=True) if x.tolist() != w] == []
