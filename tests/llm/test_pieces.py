from __future__ import annotations

import math

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelflink.llm.sentence_pieces import BLANK, VOCABULARY, Decoder, Encoder, encode, encoded_and_checked, load_pieces

TEXTS = [
    None, "", " ", "a", "  two  blanks ", "Hello world, this is a test.", "línea única ñandú\n\tüber", "日本語 と 😀 \x00\x7f",
    "▁literal ▁▁ mark▁", "\n\n\n", "x" * 5000, "the " * 20_000, "�", " lead", "trail ",
]
text = st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.text("the an▁ \n", max_size=40)


@pytest.fixture(scope="module")
def stored():
    return load_pieces(scores="stored")


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


@pytest.fixture(scope="module")
def library():
    """The library's own unigram segmentation of the same pieces and scores."""
    raw, out, at = open(VOCABULARY, "rb").read(), b"", 0

    def read():
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        key, length = read(), read()
        payload = raw[at : at + length]
        at += length
        if key >> 3 == 2:
            # Model type 1 (unigram) comes last and so holds.
            payload += bytes([3 << 3, 1])
        out += _field(key >> 3, payload)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


@settings(max_examples=300, database=None, derandomize=True, deadline=None)
@given(text)
def test_round_trip(text):
    for scores in ("zipf", "stored"):
        pieces = PIECES.setdefault(scores, load_pieces(scores=scores))
        encoder = ENCODERS.setdefault(scores, Encoder(pieces))
        assert DECODERS.setdefault(scores, Decoder(pieces)).decode(encoder.encode(text)) == text


PIECES, ENCODERS, DECODERS = {}, {}, {}


def _cost(pieces, ids: list[int], unknown_characters: int) -> float:
    return sum(pieces.score[i] for i in ids if pieces.byte[i] < 0) + unknown_characters * pieces.unknown


def test_best_score_against_dynamic_programming(stored):
    number = {p: i for i, p in enumerate(stored.text) if stored.usable[i]}
    longest = max(map(len, number))
    encoder = Encoder(stored)
    for sample in ("internationalization", "thththereering", "ñandú日x", "a▁b", "ouqueauxelle", BLANK * 9 + "word"):
        sample = sample.replace(" ", BLANK)
        best = [0.0] + [-math.inf] * len(sample)
        for end in range(1, len(sample) + 1):
            for start in range(max(0, end - longest), end):
                if (i := number.get(sample[start:end])) is not None:
                    best[end] = max(best[end], best[start] + stored.score[i])
            if sample[end - 1] not in number:
                best[end] = max(best[end], best[end - 1] + stored.unknown)
        ids = encoder.segment(sample)
        unknown = sum(c not in number for c in sample)
        assert _cost(stored, ids, unknown) == pytest.approx(best[-1])


def test_no_worse_than_the_library_and_readable_by_it(stored, library):
    encoder = Encoder(stored)
    samples = ["Hello world, this is a test.", "Thntblere of then edtioner in inea", "línea única ñandú", "Released under the MIT License."]
    for sample in samples:
        ours, theirs = encoder.encode(sample), library.encode(sample)
        assert _cost(stored, ours, 0) >= _cost(stored, theirs, 0) - 1e-6
        assert library.decode(ours) == sample


def test_tables(docs_of):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "a")]
    got = encoded_and_checked(docs_of(rows)).collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (0, 1)} == {0}
    assert encoded_and_checked(docs_of([])).count() == 0
    assert encode(docs_of(rows).withColumnRenamed("lang", "ids")).count() == len(rows)
