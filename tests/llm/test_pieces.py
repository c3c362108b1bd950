"""Sentence pieces against the library: ids, byte spans, decoded texts."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from filingframe.llm import pieces

from . import samples

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab é日本'1! \n\t<s>▁　😀ﬁ한글\0Å"


def numbers(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def by_library(library, text: str) -> tuple[list[int], list[int], list[int]]:
    found = library.encode_as_proto(text).pieces
    return [p.id for p in found], [p.begin for p in found], [p.end for p in found]


def test_articles(spark):
    articles = samples.articles(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for r in articles.collect():
        text = r["content"] or ""
        ids, begins, ends = by_library(library, text)
        n = len(text.encode())
        coded = [1, *ids, 2]
        want.append((str(r["url"]), len(coded), coded, [0, *begins, n], [0, *ends, n], library.decode(coded)))
    got = [(str(r["url"]), r["n_tokens"], *(numbers(r[c]) for c in ("ids", "begins", "ends")), r["decoded"]) for r in pieces.encode_articles(articles, MODEL).collect()]
    assert sorted(got) == sorted(want)
    none = pieces.encode_articles(samples.no_articles(spark), MODEL)
    assert none.count() == 0 and none.columns == ["url", "n_tokens", "ids", "begins", "ends", "decoded"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=80))
def test_any_text(text):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = pieces.piece_encoder(MODEL)
    assert tuple(x.tolist() for x in own.encode([text.encode()])[0]) == by_library(library, text)


@pytest.mark.parametrize("part", [1, 7, 64])
def test_parts_of_a_long_text_equal_the_whole(part, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = pieces.piece_encoder(MODEL)
    monkeypatch.setattr(pieces, "_PART", part)
    for text in ("word  and\n more " * 40, "日本語漢字" * 60, "a" * 500, "▁▁ x▁y  " * 30, "éàü😀 " * 50):
        assert tuple(x.tolist() for x in own.encode([text.encode()])[0]) == by_library(library, text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("suffix", [False, True])
def test_compiled_character_maps(tmp_path, rule, squeeze, suffix):
    """The same vocabulary behind the character maps that the library brings along."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    form = sentencepiece_model_pb2.ModelProto()
    form.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = form.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    model.trainer_spec.treat_whitespace_as_suffix = suffix
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.PieceEncoder(str(path))
    assert own.map is not None
    texts = ["", "  ", "ﬁne Ａ１ ㌔ ½ Å é ｶﾞ 　x  y \t z ", "ẞ İ Σς ①②③ ­​ a", "日本語 ㈱ 한글 가 😀", "x ", " ▁ y"]
    for text in texts:
        assert tuple(x.tolist() for x in own.encode([text.encode()])[0]) == by_library(library, text), text


def test_unknown_pieces(tmp_path):
    """Without byte pieces a run of unknown characters is one piece."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.byte_fallback = False
    for p in model.pieces:
        if p.type == 6:
            p.type = 1
    path = tmp_path / "unknown.model"
    path.write_bytes(model.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.PieceEncoder(str(path))
    for text in ("a 😀😀 b\U0001f9ff", "\U0001f9ff x \U0001f9ff\U0001f9ff y", "plain"):
        assert tuple(x.tolist() for x in own.encode([text.encode()])[0]) == by_library(library, text)
