"""The table of pre-tokens of op8: what it keeps, and how vocabularies and ids are read."""

import base64

import numpy as np
import public_tokenizers as P
import pytest

from sluice.llm import bpe


class Counted:
    """A processor that counts the strings and pre-tokens that it is given."""

    def __init__(self, processor):
        self.processor, self.strings, self.tokens = processor, 0, 0

    def Encode(self, texts, **options):  # noqa: N802
        self.strings, self.tokens = self.strings + len(texts), self.tokens + sum(t.count("\x01") + 1 for t in texts)
        return self.processor.Encode(texts, **options)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def test_each_pretoken_is_merged_once_and_many_in_one_string(ranks):
    encoder = bpe.Encoder(bpe.serialise_model(ranks), P.PATTERN)
    encoder.processor = Counted(encoder.processor)
    letters = np.array(list("abcdefghij"))
    words = ["".join(letters[[int(d) for d in f"{i:06d}"]]) for i in range(100_000)]
    texts = [" ".join(words[i : i + 400]) for i in range(0, len(words), 400)]
    first = encoder.encode(texts)
    distinct, strings = encoder.processor.tokens, encoder.processor.strings
    assert encoder.encode(texts) == first
    assert encoder.processor.tokens == distinct and strings < distinct / 30
    decoder = bpe.Decoder(ranks)
    assert [decoder.decode(x).decode() for x in first] == texts


def test_long_pretokens_do_not_pile_up(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHARACTERS", 10_000)
    encoder, decoder = bpe.Encoder(bpe.serialise_model(ranks), P.PATTERN), bpe.Decoder(ranks)
    for i in range(20):
        text = "xyzé\x01"[i % 5] * 3_000 + str(i)
        assert decoder.decode(encoder.encode([text])[0]).decode() == text
        assert sum(map(len, encoder.known)) <= 10_000
    assert decoder.decode(None) == decoder.decode(b"") == b""


def test_a_byte_without_rank_is_an_error(tmp_path):
    lines = [f"{base64.b64encode(bytes([b])).decode()} {b}" for b in range(255)]
    (tmp_path / "short.tiktoken").write_text("\n".join(lines))
    with pytest.raises(ValueError, match="single byte"):
        bpe.read_ranks(str(tmp_path / "short.tiktoken"))
