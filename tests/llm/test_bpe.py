import hashlib
import random

import public_tokenizers
import pytest
import regex

from pulse.llm import bpe
from tests.llm.conftest import table_texts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as file:
        return bpe.Codec(file.read(), PATTERN)


def each_match(codec, text):
    return [i for m in regex.finditer(PATTERN, text) for i in codec._encoding._encode_single_piece(m[0])]


def test_texts_are_encoded_match_by_match(spark, documents, codec, odd_rows):
    texts = [(r["doc_id"] + 100, r["text"]) for r in table_texts()[:60]] + odd_rows
    want = []
    for i, text in texts:
        ids = each_match(codec, text or "")
        spelled = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), spelled, hashlib.sha256((text or "").encode()).hexdigest()))
    found = bpe.encoded(documents(texts), RANKS, PATTERN)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in found.collect())
    back = sorted(((r.doc_id, r.text) for r in bpe.decoded(found, RANKS, PATTERN).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in texts), key=str)


def test_cuts_never_go_through_a_match(codec, monkeypatch):
    rnd = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", " \n", "'s", "1", "é", "!", "　", "字", "'", "'ll", "\x1c", "\x85"]
    for _ in range(1500):
        blank = rnd.choice((2, 3, 1000))
        monkeypatch.setattr(bpe, "LONG", rnd.choice((3, 8, 20)))
        monkeypatch.setattr(bpe, "BLANK", blank)
        monkeypatch.setattr(bpe, "_BLANK", regex.compile(rf"\p{{White_Space}}{{{blank},}}"))
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))
        assert codec.encode(text) == codec._encoding.encode_ordinary(text), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("text", [" " * 300_000, "a" * 300_000, "!" * 300_000, "\n" * 200_000 + "x", "x" + "\n " * 200_000])
def test_very_long_runs(codec, text):
    assert codec.decode(codec.encode(text)) == text.encode()


def test_empty_table(documents):
    assert bpe.encoded(documents([]), RANKS, PATTERN).count() == 0
