"""Ids and decoded texts equal those of the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tesseraql.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def both():
    return bpe.PrefixBPE(PATH), Tokenizer.from_file(PATH)


def test_random_texts(both):
    mine, lib = both
    rng = random.Random(5)
    bits = ["ab", "aaa", "the", "ing", "'s", "'", "é", "É", "ß", "İ", "Σ", "ΑΣ", "é", "中文", "1", "23", "½", "_", "--", "!!!", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "\x85", "😀", "'ll", "\x00", "K", "ﬁ", " ", "\n", "\t", " ", "‍", "ı", "DŽ"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) if rng.random() < 0.5 else "".join(rng.choice("abehlnorstain") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(0, 8)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_the_pattern_for_latin_letters_changes_nothing(both, monkeypatch):
    """The same ids with the tokenizer's own rules alone, and however few words and pairs are remembered."""
    mine, lib = both
    rng = random.Random(8)
    letters = [chr(c) for c in range(1, 0x250)] + ["'s", "'LL", "1st", " ", "\n", "e\u0301"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["Plain words, don't they'll 12 3!"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert mine.plain_rules and [mine.encode(t) for t in texts] == want
    monkeypatch.setattr(mine, "plain_rules", False)
    assert [mine.encode(t) for t in texts] == want
    monkeypatch.setattr(bpe, "MEMO", 4)
    assert [mine.encode(t) for t in texts] == want


def test_every_token_that_stands_for_itself(both):
    mine, _ = both
    sample = list(mine.parts)[::97]
    assert all(mine.own(t) for t in sample)


def test_very_long_word(both):
    mine, lib = both
    text = "ab" * 20_000 + " " + "x" * 5000
    assert mine.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_frame(spark, both):
    _, lib = both
    rows = [(1, "Hello there, world's end", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (None, " \n ", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column with a result's name
    got = sorted(map(tuple, bpe.digest(bpe.encode_decode(df)).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(df.limit(0)).count() == 0
