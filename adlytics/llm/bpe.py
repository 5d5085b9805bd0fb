"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Merges run by rank. A merge can only be prevented or enabled from the right by a merge of lower
rank that takes its right operand, or the last piece of it, at some depth. So influence travels to
the left along chains of rules of falling rank, and the longest such chain, in symbols, bounds how
far ahead a token can depend on its text. A token that has as many symbols behind it is stable.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from adlytics.llm.common import Words, pieces, released

#: Text that is encoded at a time, in bytes.
PIECE_BYTES = 8 << 20
#: The same where ids and texts are returned, which are held beside it several times as large.
ENCODED_BYTES = 2 << 20
#: Words that are split together.
SPLIT_WORDS = 1 << 17
#: Parts up to this many bytes are merged together, as they end before a token could be emitted.
SHORT_PART = 48
#: Parts of one length that are merged at a time.
MERGED_PARTS = 1 << 15
#: Ids that the decoder takes at a time.
CHUNK = 4096
_NO_RANK = 1 << 30


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Tokenizer:
    """Tables of a tokenizer file: byte symbols, merge list, end-of-word suffix, special strings."""

    def __init__(self, definition: str):
        told = json.loads(definition)
        model = told["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a byte-level BPE without prefixes is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        steps = [told["pre_tokenizer"], *told["pre_tokenizer"].get("pretokenizers", [])]
        (pattern,) = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        self.pattern = regex.compile(pattern)
        # Beyond ASCII, normal forms and character classes are those of the library's Unicode version.
        self.normalizer = tokenizers.Tokenizer.from_str(definition).normalizer
        self.split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
        characters = byte_characters()
        self.inner = [self.vocab[c] for c in characters]
        self.last = [self.vocab[c + self.suffix] for c in characters]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []  # by rank
        rules = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            if self.ranks.setdefault(a << 32 | b, len(self.made)) == len(self.made):
                rules.append((a, b, c))
                self.made.append(c)
        self.lengths = self._lengths(rules)
        self.lookahead = self._lookahead(rules)
        self._pairs = np.array(sorted(self.ranks), np.int64)
        self._pair_ranks = np.array([self.ranks[k] for k in self._pairs.tolist()], np.int64)
        self._made = np.array(self.made, np.int32)
        self._inner, self._last = np.array(self.inner, np.int32), np.array(self.last, np.int32)

    def _lengths(self, rules: list[tuple[int, int, int]]) -> dict[int, int]:
        lengths = dict.fromkeys([*self.inner, *self.last], 1)
        for a, b, c in rules:
            lengths[c] = lengths[a] + lengths[b]
        return lengths

    def _lookahead(self, rules: list[tuple[int, int, int]]) -> int:
        """Symbols behind a token after which no continuation changes it."""
        ends: dict[int, set[int]] = {}  # a token, its last piece, the last piece of that, ...
        reach: dict[int, int] = {}  # by left operand: the longest chain from the rules so far
        most = 0
        for a, b, c in rules:
            tail = ends.setdefault(b, {b})
            ends.setdefault(c, {c}).update(tail)
            chain = self.lengths[b] + max(reach.get(s, 0) for s in tail)
            reach[a] = max(reach.get(a, 0), chain)
            most = max(most, chain)
        return most + 1  # the last symbol of a word is known as such only when the word ends

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges: the lowest rank first, the leftmost of equals."""
        rank_of, made, left = self.ranks.get, self.made, len(symbols) - 1
        ranks = [rank_of(a << 32 | b, _NO_RANK) for a, b in zip(symbols, symbols[1:])]
        while left > 0:
            least = min(ranks)
            if least == _NO_RANK:
                break
            at = ranks.index(least)
            new = symbols[at] = made[least]
            left -= 1
            del symbols[at + 1], ranks[at]
            if at < left:
                ranks[at] = rank_of(new << 32 | symbols[at + 1], _NO_RANK)
            if at:
                ranks[at - 1] = rank_of(symbols[at - 1] << 32 | new, _NO_RANK)
        return symbols

    def transduce(self, word: Iterable[int]) -> Iterator[int]:
        """Tokens of one word's bytes, each emitted once it is stable; memory is bounded."""
        window = 4 * self.lookahead
        held: list[int] = []
        if isinstance(word, bytes) and len(word) <= window:  # it ends before anything could be emitted
            held = [self.inner[b] for b in word]
            held[-1:] = [self.last[b] for b in word[-1:]]
            word = b""
            yield from self.merged(held)
        before = None
        for byte in word:
            if before is not None:
                held.append(self.inner[before])
            before = byte
            if len(held) >= window:
                passed = 0
                for token in self.merged(held[:]):
                    if passed + self.lengths[token] + self.lookahead > len(held):
                        break
                    passed += self.lengths[token]
                    yield token
                del held[:passed]
        if before is not None:
            held.append(self.last[before])
            yield from self.merged(held)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
        return np.where(self._pairs[at] == keys, self._pair_ranks[at], _NO_RANK)

    def _merged_alike(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`merged` for many parts of one length, a row each: a step merges once in each row. Tokens and their numbers."""
        tokens, sizes = np.zeros_like(symbols), np.zeros(len(symbols), np.int64)
        row = np.arange(len(symbols))
        ranks = self._ranks_of(symbols[:, :-1], symbols[:, 1:])
        while len(row):
            width = symbols.shape[1] - 1
            at = ranks.argmin(axis=1) if width else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), at] if width else np.full(len(row), _NO_RANK)
            going = least != _NO_RANK
            if not going.all():
                tokens[row[~going], : width + 1] = symbols[~going]
                sizes[row[~going]] = width + 1
                row, at, least, symbols, ranks = row[going], at[going], least[going], symbols[going], ranks[going]
            if not len(row):
                break
            each = np.arange(len(row))
            symbols = np.where(np.arange(width) <= at[:, None], symbols[:, :-1], symbols[:, 1:])
            symbols[each, at] = self._made[least]
            ranks = np.where(np.arange(width - 1) < at[:, None], ranks[:, :-1], ranks[:, 1:])
            after = np.flatnonzero(at < width - 1)
            ranks[after, at[after]] = self._ranks_of(symbols[after, at[after]], symbols[after, at[after] + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self._ranks_of(symbols[before, at[before] - 1], symbols[before, at[before]])
        return tokens, sizes

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of parts of the split, one part's after the other's, and how many each has.

        Short parts of one length are merged together, others streamed.
        """
        texts = texts.cast(pa.large_string())
        _, told, data = texts.buffers()
        begins = np.frombuffer(told, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lengths, begins = np.diff(begins), begins[:-1]
        sizes = np.zeros(len(texts), np.int64)
        merged = []
        by_length = np.argsort(lengths, kind="stable")
        cuts = np.searchsorted(lengths[by_length], np.arange(1, SHORT_PART + 2))
        for length in range(1, SHORT_PART + 1):
            members = by_length[cuts[length - 1] : cuts[length]]
            for start in range(0, len(members), MERGED_PARTS):
                some = members[start : start + MERGED_PARTS]
                part = raw[begins[some][:, None] + np.arange(length)]
                symbols = self._inner[part]
                symbols[:, -1] = self._last[part[:, -1]]
                tokens, sizes[some] = self._merged_alike(symbols)
                merged.append((some, tokens))
        for k in by_length[cuts[SHORT_PART] :].tolist():
            tokens = np.fromiter(self.transduce(raw[begins[k] : begins[k] + lengths[k]].tobytes()), np.int32)
            sizes[k] = len(tokens)
            merged.append((np.array([k]), tokens[None, :]))
        firsts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int32)
        for some, tokens in merged:
            filled = np.arange(tokens.shape[1]) < sizes[some][:, None]
            flat[(firsts[some][:, None] + np.arange(tokens.shape[1]))[filled]] = tokens[filled]
        return flat, sizes

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts without ASCII white space, one after the other's, and how many each has."""
        found = [self._some_words(texts[k : k + SPLIT_WORDS]) for k in range(0, len(texts), SPLIT_WORDS)]
        nothing = (np.zeros(0, np.int32), np.zeros(0, np.int64))
        flat, sizes = zip(*found, strict=True) if found else ([nothing[0]], [nothing[1]])
        return np.concatenate(flat), np.concatenate(sizes)

    def _some_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, of_word = self._split(texts)
        special = [k for k, part in enumerate(parts) if isinstance(part, int)]
        ids = np.array([parts[k] for k in special], np.int32)
        for k in special:
            parts[k] = ""
        coded = pa.array(parts, pa.large_string()).dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        flat, sizes = self.parts(coded.dictionary)
        codes[special] = len(sizes) + np.arange(len(special))
        flat, sizes = np.concatenate((flat, ids)), np.concatenate((sizes, np.ones(len(ids), np.int64)))
        firsts = np.cumsum(sizes) - sizes
        codes = codes[_ranges(*of_word)]
        each = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(of_word[1])))]
        return flat[_ranges(firsts[codes], each)], np.diff(ends)

    def _split(self, texts: list[str]) -> tuple[list, tuple[np.ndarray, np.ndarray]]:
        """Parts of all texts, and where those of each text begin and how many it has.

        Special tokens are their ids. Plain texts are split together, separated by white space, which
        belongs to no part.
        """
        parts: list = []
        begins, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        whole = "\n".join(texts)
        present = [s for s in self.special if s in whole]
        alone = {k for k, text in enumerate(texts) if any(s in text for s in present)} if present else set()
        plain = [k for k, text in enumerate(texts) if text.isascii() and text.isprintable() and k not in alone]
        if plain:
            lowered = "\n".join([texts[k] for k in plain]).lower()
            self._deal(parts, begins, counts, plain, lowered.split("\n"), self.pattern.findall(lowered))
        rest = [k for k, text in enumerate(texts) if not (text.isascii() and text.isprintable()) and k not in alone]
        others = [k for k in rest if texts[k].split() == [texts[k]]]
        if others:
            lowered = self.normalizer.normalize_str("\n".join([texts[k] for k in others]))
            found = [part for part, _ in self.split.pre_tokenize_str(lowered)]
            self._deal(parts, begins, counts, others, lowered.split(" "), found)
        for k in sorted(alone.union(rest).difference(others)):
            begins[k] = len(parts)
            self._around_specials(texts[k], parts)
            counts[k] = len(parts) - begins[k]
        return parts, (begins, counts)

    @staticmethod
    def _deal(parts: list, begins: np.ndarray, counts: np.ndarray, members: list[int], texts: list[str], found: list[str]) -> None:
        """Add what was found in all texts in a row, and to whom it belongs; parts cover their texts."""
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        reached = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        last = np.searchsorted(reached, ends)
        if len(members) != len(texts) or reached[-1] != ends[-1] or (reached[last] != ends).any():
            raise ValueError("the split leaves out characters of a word")
        counts[members] = np.diff(last, prepend=-1)
        begins[members] = len(parts) + last + 1 - counts[members]
        parts += found

    def word(self, text: str) -> list[int]:
        """Token ids of a text without ASCII white space."""
        return self.words([text])[0].tolist()

    def _around_specials(self, text: str, found: list) -> None:
        start = 0
        for special in self._specials(text):
            self._plain(text[start : special.start()], found)
            found.append(self.special[special.group()])
            start = special.end()
        self._plain(text[start:], found)

    def _specials(self, text: str) -> Iterable[regex.Match]:
        if not any(s in text for s in self.special):
            return ()
        longest_first = sorted(self.special, key=len, reverse=True)
        return regex.finditer("|".join(map(regex.escape, longest_first)), text)

    def _plain(self, text: str, found: list) -> None:
        if text.isascii():
            found += self.pattern.findall(text.lower())
        else:
            found += [part for part, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]


class TextDecoder:
    """Ids to text, a few at a time: bytes that don't complete a character wait for the next ids.

    As the file names no decoder, token strings are joined by one space (`spaced`); otherwise the
    bytes that tokens stand for are put together and the end-of-word suffix becomes a space.
    """

    def __init__(self, tokenizer: Tokenizer, spaced: bool = True):
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.pieces: dict[int, bytes] = {}
        for i, s in tokenizer.strings.items():
            if spaced:
                self.pieces[i] = b" " + s.encode()
            elif s in tokenizer.special:
                self.pieces[i] = s.encode()
            else:
                ends = bool(tokenizer.suffix) and s.endswith(tokenizer.suffix)
                body = s[: len(s) - len(tokenizer.suffix)] if ends else s
                self.pieces[i] = bytes(byte_of[c] for c in body) + b" " * ends
        self.spaced = spaced

    def stream(self, chunks: Iterable[list[int]]) -> Iterator[str]:
        """Text as soon as its bytes are complete, chunk by chunk."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        lead = int(self.spaced)  # the space in front of the first string
        for chunk in chunks:
            if chunk:
                yield machine.decode(b"".join([self.pieces[i] for i in chunk])[lead:])
                lead = 0
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        ids = iter(ids)
        return "".join(self.stream(iter(lambda: list(islice(ids, CHUNK)), [])))


_LOADED: dict[int, Tokenizer] = {}


def _loaded(definition: str) -> Tokenizer:
    """The tables, built once in a worker."""
    key = hash(definition)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(definition)
    return _LOADED[key]


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of every range in turn."""
    ends = np.cumsum(counts)
    return np.repeat(begins - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _encoded(tokenizer: Tokenizer, texts: pa.Array) -> pa.ListArray:
    words = Words(texts, lower=False)
    flat, sizes = tokenizer.words(words.distinct)
    lengths = sizes[words.codes]
    at = _ranges((np.cumsum(sizes) - sizes)[words.codes], lengths)
    offsets = np.concatenate(([0], np.cumsum(lengths)))[words.starts].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[at]))


def _decoded(decoder: TextDecoder, ids: pa.ListArray) -> pa.Array:
    return pa.array([decoder.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in ids], pa.string())


def encode(docs: DataFrame, definition: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of the whole text to every row, and the text they decode to if it is named.

    definition is the content of a tokenizer file. Null and empty texts have no ids. Strings of
    special tokens become these tokens. Columns of the added names are replaced; nothing depends on
    other columns or rows.
    """
    added = [StructField(ids, ArrayType(IntegerType(), False))]
    added += [StructField(decoded, StringType())] if decoded else []
    rows = docs.drop(*[f.name for f in added])
    names = [*rows.columns, *[f.name for f in added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(definition)
        decoder = TextDecoder(tokenizer) if decoded else None
        for piece in pieces(batches, text, ENCODED_BYTES):
            columns = [_encoded(tokenizer, piece.column(text))]
            if decoder:
                columns.append(_decoded(decoder, columns[0]))
            yield pa.RecordBatch.from_arrays([*piece.columns, *columns], names=names)

    return rows.mapInArrow(released(run), StructType([*rows.schema.fields, *added]))


def digests(docs: DataFrame, definition: str, text: str = "text") -> DataFrame:
    """Replace the text by n_tokens and the SHA-256 of its ids (ids_sha256) and of what they decode to (decoded_sha256).

    Ids are digested as decimal numbers joined by one space. Both are digested where they are made,
    a chunk at a time. Null and empty texts have no ids. Columns of the added names are replaced.
    """
    added = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    rows = docs.drop(*[f.name for f in added])
    kept = [f for f in rows.schema.fields if f.name != text]
    names = [f.name for f in [*kept, *added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(definition)
        decoder = TextDecoder(tokenizer)
        decimals = {i: b" %d" % i for i in tokenizer.strings}
        for piece in pieces(batches, text, PIECE_BYTES):
            found = _encoded(tokenizer, piece.column(text))
            offsets, ids = found.offsets.to_numpy(), found.values.to_numpy()
            of_ids, of_text = [], []
            for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                told, shown = hashlib.sha256(), hashlib.sha256()
                for at in range(start, end, CHUNK):
                    chunk = ids[at : min(end, at + CHUNK)].tolist()
                    told.update(b"".join([decimals[i] for i in chunk])[at == start :])
                for characters in decoder.stream(ids[at : min(end, at + CHUNK)].tolist() for at in range(start, end, CHUNK)):
                    shown.update(characters.encode())
                of_ids.append(told.hexdigest())
                of_text.append(shown.hexdigest())
            columns = [piece.column(f.name) for f in kept]
            sizes = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*columns, sizes, pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=names)

    return rows.mapInArrow(released(run), StructType([*kept, *added]))


def decode(docs: DataFrame, definition: str, ids: str = "ids", text: str = "decoded", spaced: bool = True) -> DataFrame:
    """Add the text of the ids to every row; null ids give an empty text."""
    rows = docs.drop(text)
    names = [*rows.columns, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = TextDecoder(_loaded(definition), spaced)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*piece.columns, _decoded(decoder, piece.column(ids))], names=names)

    return rows.mapInArrow(released(run), StructType([*rows.schema.fields, StructField(text, StringType())]))
