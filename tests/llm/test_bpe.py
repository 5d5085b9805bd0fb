"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from adlytics.llm import bpe
from adlytics.llm.queries import tokenizer
from corpus_cases import awkward, clashing, documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

MINE = bpe.Tokenizer(tokenizer())
THEIRS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encoded(text):
    return [i for w in text.encode().split() for i in MINE.word(w.decode())]


def same(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    assert encoded(text) == ids
    assert bpe.TextDecoder(MINE).decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(text):
    same(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "'s", "'RE", " ", " ", "Σας", "İ", "é", "the", "1", "!?", "🙂"]), max_size=12))
def test_special_strings_and_marks(parts):
    same("".join(parts))


@pytest.mark.parametrize("seed", range(20))
def test_words_longer_than_the_lookahead(seed):
    chosen = random.Random(seed)
    parts = ["th", "ing", "er", "an", "tion", "in", "the", "ed", "ation", "ment", "aaa", "s"]
    same("".join(chosen.choice(parts) for _ in range(chosen.choice([300, 1500]))))


def test_streamed_tokens_are_final():
    """Emission before the end of the word changes nothing, and what is held stays bounded."""
    word = ("abcdefghij" * 2000).encode()
    held = 0

    def fed():
        nonlocal held
        for byte in word:
            held += 1
            yield byte

    found, lag = [], 0
    for token in MINE.transduce(fed()):
        found.append(token)
        lag = max(lag, held - sum(MINE.lengths[t] for t in found[-1:]))
        if held < len(word):
            assert held - sum(map(MINE.lengths.get, found)) <= 4 * MINE.lookahead + 1
    symbols = [MINE.inner[b] for b in word[:-1]] + [MINE.last[word[-1]]]
    assert found == MINE.merged(symbols)


def test_decoding_bytes_to_text_in_small_chunks(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 1)
    text = "größe 漢字 🙂 fin"
    assert bpe.TextDecoder(MINE, spaced=False).decode(encoded(text)) == text + " "


def test_rows(spark):
    found = awkward() + rows((20, "a <|endoftext|> b"))
    docs = clashing(documents(spark, found), "ids", "decoded", "n_tokens")
    out = bpe.decode(bpe.encode(docs, tokenizer()), tokenizer()).collect()
    assert len(out) == len(found)
    for row in out:
        ids = THEIRS.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == ids
        assert row["decoded"] == THEIRS.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == "extra n_tokens"
    both = bpe.encode(docs, tokenizer(), decoded="decoded").collect()
    assert sorted(map(repr, both)) == sorted(map(repr, out))


def test_empty_table(spark):
    assert bpe.encode(documents(spark, []), tokenizer()).count() == 0


def test_digests(spark):
    found = awkward() + rows((20, "a <|endoftext|> b"), (21, "word " * 5_000))
    out = bpe.digests(clashing(documents(spark, found), "n_tokens", "ids_sha256"), tokenizer()).collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = []
    for row in found:
        ids = THEIRS.encode(row[1] or "", add_special_tokens=False).ids
        expected.append((row[0], len(ids), sha(" ".join(map(str, ids))), sha(THEIRS.decode(ids, skip_special_tokens=False))))
    shown = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out]
    assert sorted(shown, key=repr) == sorted(expected, key=repr)
