"""Frequent phrases and collocations, counted through HAT-tries.

1. A task reads its texts piece by piece. Every position of a piece is one path: the word there and
   up to three that follow. The task's HAT-trie counts the paths; the count of a shorter phrase is
   the sum over the paths below it, so nothing else is counted but single words.
2. When the trie holds MOST_PATHS paths, its largest subtrees are spilled: their paths leave as a
   run sorted by the hash of the first two words, cut at the borders of the prefix partitions.
3. A prefix partition merges the runs of all tasks. It holds every path that begins with its pairs
   of words, so the counts of its phrases are complete. A phrase is at most as frequent as what it
   begins with, so paths whose first two words are too rare go first, then those of rare triples.
4. Scores, containment and ranks are joins and aggregates over the frequent phrases.

Prefix partitions are as many as the bytes of text ask for, so they hold about as much at any size.
Hashes only place and sort the runs; words are told apart as what they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlytics.llm.common import pieces, text_of
from adlytics.llm.hat_trie import HatTrie, joined
from adlytics.operators.skew import heavy_keys, spread_join
from adlytics.workspace import Workspace

#: Words of the longest phrase; a path is packed in two integers.
LONGEST = 4
#: Paths that a task holds, and distinct words and their characters, before it spills.
MOST_PATHS = 3 << 19
MOST_WORDS = 1 << 18
MOST_CHARACTERS = 1 << 24
#: Share of the paths that are spilled when a trie is full.
SPILLED = 0.8
#: Bytes of text behind one prefix partition.
PARTITION_BYTES = 32 << 20
#: Bytes of text that are cut into words together.
_PIECE = 2 << 20
#: Parts in which the first phrases of a language are found.
_RANK_PARTS = 64

# Characters between pieces, and between the words of a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_ENDS = b" \t"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(WORD_ENDS)] = 1
_KIND[list(PIECE_ENDS)] = 2


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of every word: its code into the distinct words, its piece and its text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    at = np.flatnonzero(begins)
    bounds = np.concatenate(([0], np.cumsum(np.flatnonzero(ends) + 1 - at)))
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[inside].tobytes()))
    coded = words.dictionary_encode()
    text = np.searchsorted(offsets, at, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), at) + text
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary, piece, text


def _word_hash(lang: str, word: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{lang}\n{word}")


_RUNS = "lang string, bucket int, single boolean, n_words int, run binary"


class _Counter:
    """The trie of a task, its words and their counts."""

    def __init__(self, bits: int):
        self.bits = bits
        self.trie = HatTrie()
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, dict[str, int]] = {}  # by language and word
        self.words: list[str] = [""]
        self.lang_of = np.zeros(1, np.int32)
        self.hashes = np.zeros(1, np.uint64)
        self.singles = np.zeros(1, np.int64)
        self.characters = 0

    def add(self, langs: pa.Array, texts: pa.Array) -> None:
        codes, distinct, piece, text = _split(texts)
        if not len(codes):
            return
        lang = pc.fill_null(langs, "und").dictionary_encode()
        names = lang.dictionary.to_pylist()
        both = np.asarray(lang.indices).astype(np.int64)[text] * len(distinct) + codes
        seen = np.zeros(len(names) * len(distinct), bool)
        seen[both] = True
        number = np.zeros(len(seen), np.uint64)
        for k, name in enumerate(names):
            present = np.flatnonzero(seen[k * len(distinct) : (k + 1) * len(distinct)])
            if len(present):
                number[present + k * len(distinct)] = self._numbers(name, distinct.take(pa.array(present)).to_pylist())
        word = number[both]
        self.singles += np.bincount(word.astype(np.int64), minlength=len(self.singles))
        path = np.zeros((LONGEST, len(word)), np.uint64)
        path[0] = word
        for k in range(1, min(LONGEST, len(word))):
            same = piece[k:] == piece[:-k]
            path[k, :-k][same] = word[k:][same]
        path = path[:, path[1] > 0]
        self.trie.add(path[0] << np.uint64(32) | path[1], path[2] << np.uint64(32) | path[3])

    def _numbers(self, lang: str, words: list[str]) -> list[int]:
        table = self.numbers.setdefault(lang, {})
        found = list(map(table.get, words))
        missing = [k for k, number in enumerate(found) if number is None]
        if missing:
            new = [words[k] for k in missing]
            numbers = range(len(self.words), len(self.words) + len(new))
            table.update(zip(new, numbers))
            for k, number in zip(missing, numbers):
                found[k] = number
            self.words += new
            self.characters += sum(map(len, new))
            place = list(self.numbers).index(lang)
            self.lang_of = np.concatenate((self.lang_of, np.full(len(new), place, np.int32)))
            self.hashes = np.concatenate((self.hashes, np.array([_word_hash(lang, w) for w in new], np.uint64)))
            self.singles = np.concatenate((self.singles, np.zeros(len(new), np.int64)))
        return found

    def spill(self, share: float) -> Iterator[pa.RecordBatch]:
        """A sorted run of the largest subtrees."""
        head, tail, count = self.trie.spill(share)
        refs = np.stack([head >> np.uint64(32), head & np.uint64(0xFFFFFFFF), tail >> np.uint64(32), tail & np.uint64(0xFFFFFFFF)]).astype(np.uint32)
        yield from self._run(refs, joined(self.hashes[refs[0]], self.hashes[refs[1]]), count, single=False)

    def finish(self) -> Iterator[pa.RecordBatch]:
        """All that is left, and the single words."""
        yield from self.spill(1.0)
        refs = np.flatnonzero(self.singles)[None, :]
        yield from self._run(refs, joined(self.hashes[refs[0]], np.uint64(0)), self.singles[refs[0]], single=True)
        self.trie.clear()
        self.forget()

    def _run(self, refs: np.ndarray, prefix: np.ndarray, count: np.ndarray, single: bool) -> Iterator[pa.RecordBatch]:
        langs = self.lang_of[refs[0]]
        place = np.zeros(len(self.words), np.uint32)
        for k, lang in enumerate(self.numbers):
            own = np.flatnonzero(langs == k)
            own = own[np.argsort(prefix[own])]
            bucket = (prefix[own] >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(own), np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for start, stop in zip(cuts.tolist(), np.append(cuts[1:], len(own)).tolist()):
                mine = refs[:, own[start:stop]]
                place[mine] = 1
                words = np.flatnonzero(place)
                place[words] = np.arange(len(words))
                local = place[mine]
                place[words] = 0
                columns = [
                    pa.array([lang]),
                    pa.array([bucket[start]], pa.int32()),
                    pa.array([single]),
                    pa.array([len(words)], pa.int32()),
                    pa.array([_packed([self.words[k] for k in words.tolist()], local, count[own[start:stop]])], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "single", "n_words", "run"])


def _packed(words: list[str], refs: np.ndarray, count: np.ndarray) -> bytes:
    """A run: its words, the places of each path's words among them, and the counts."""
    # No word holds a line end, as that ends a piece.
    text = "\n".join(words).encode()
    kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
    parts = (np.array([len(text), refs.shape[1]], np.int64).tobytes(), text, refs.astype(kind).tobytes(), count.astype(np.int64).tobytes())
    return zstandard.compress(b"".join(parts), 1)


def _unpacked(run: bytes, n_words: int, width: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    raw = zstandard.decompress(run)
    text, paths = np.frombuffer(raw, np.int64, 2).tolist()
    kind = np.dtype(np.uint16 if n_words <= 1 << 16 else np.uint32)
    refs = np.frombuffer(raw, kind, width * paths, 16 + text).reshape(width, paths)
    at = 16 + text + width * paths * kind.itemsize
    return raw[16 : 16 + text].decode().split("\n"), refs, np.frombuffer(raw[at:], np.int64)


def _counted(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(bits)
        for batch in batches:
            for piece in pieces(iter([batch]), "text", _PIECE):
                counter.add(piece.column("lang"), piece.column("text"))
                if len(counter.words) > MOST_WORDS or counter.characters > MOST_CHARACTERS:
                    yield from counter.finish()
                elif counter.trie.size > MOST_PATHS:
                    yield from counter.spill(SPILLED)
        yield from counter.finish()

    return count


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and where each group of them begins."""
    order = np.lexsort(keys[::-1])
    differs = np.ones(len(order), bool)
    if len(order) > 1:
        differs[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(differs)


class _Merge:
    """The runs of one language and prefix partition, merged when all have come."""

    def __init__(self, lang: str, least: int):
        self.lang, self.least = lang, least
        self.places: dict[str, int] = {"": 0}  # the empty word ends a path
        self.hashes: list[int] = [0]
        self.paths: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.singles: dict[str, int] = {}
        self.total = 0

    def add(self, row: dict) -> None:
        words, refs, counts = _unpacked(row["run"], row["n_words"], 1 if row["single"] else LONGEST)
        if row["single"]:
            for ref, n in zip(refs[0].tolist(), counts.tolist()):
                self.singles[words[ref]] = self.singles.get(words[ref], 0) + n
                self.total += n
            return
        place = []
        for word in words:
            at = self.places.get(word)
            if at is None:
                at = self.places[word] = len(self.hashes)
                self.hashes.append(_word_hash(self.lang, word))
            place.append(at)
        self.paths.append(np.array(place, np.uint32)[refs])
        self.counts.append(counts.astype(np.int64))

    def phrases(self) -> Iterator[tuple[list[str], int]]:
        """Frequent words and phrases of at least two words, and the number of all words as that of no words."""
        if self.total:
            yield [], self.total
        yield from (([w], n) for w, n in self.singles.items() if n >= self.least)
        if not self.paths:
            return
        paths, counts = np.concatenate(self.paths, axis=1), np.concatenate(self.counts)
        self.paths, self.counts = [], []
        hashes, words = np.array(self.hashes, np.uint64), list(self.places)
        # Runs are sorted by this key, so a stable sort merges them. Pairs that share a key
        prefix = joined(hashes[paths[0]], hashes[paths[1]])
        order = np.argsort(prefix, kind="stable")
        start = np.flatnonzero(np.diff(prefix[order], prepend=prefix[order][0] + np.uint64(1)))
        # are frequent only if the key is, so rare keys go at once.
        summed = np.add.reduceat(counts[order], start)
        keep = np.repeat(summed >= self.least, np.diff(np.append(start, len(order))))
        paths, counts = paths[:, order[keep]], counts[order[keep]]
        for size in range(2, LONGEST + 1):
            if not len(counts):
                return
            order, start = _groups([paths[k] for k in range(size)])
            summed = np.add.reduceat(counts[order], start)
            frequent = summed >= self.least
            for at, n in zip(order[start[frequent]].tolist(), summed[frequent].tolist()):
                yield [words[k] for k in paths[:size, at].tolist()], n
            keep = order[np.repeat(frequent, np.diff(np.append(start, len(order))))]
            paths, counts = paths[:, keep], counts[keep]
            if size < LONGEST:
                longer = paths[size] > 0
                paths, counts = paths[:, longer], counts[longer]


def _merged(least: int):
    """Rows come sorted by language and prefix partition."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if at != (row["lang"], row["bucket"]):
                    if held is not None:
                        yield from _frequent(held)
                    at, held = (row["lang"], row["bucket"]), _Merge(row["lang"], least)
                held.add(row)
        if held is not None:
            yield from _frequent(held)

    return merge


def _frequent(held: _Merge) -> Iterator[pa.RecordBatch]:
    words, counts = [], []
    for phrase, n in held.phrases():
        words.append(phrase)
        counts.append(n)
    columns = [pa.array([held.lang] * len(counts), pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "f"])


def frequent_phrases(space: Workspace, docs: DataFrame, least: int, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """Rows (lang, words, f): phrases of 1 to LONGEST words with at least `least` occurrences in a language.

    A row without words gives the number of all words of a language, in parts. Overlapping
    occurrences count each. A null language is `und`, a null text empty. A-Z are lower-cased, pieces
    end at PIECE_ENDS and words at WORD_ENDS.
    """
    rows = docs.select(F.col(lang_column).alias("lang"), text_of(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / PARTITION_BYTES)))))
    runs = rows.mapInArrow(_counted(bits), _RUNS)
    placed = runs.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return space.save(placed.mapInArrow(_merged(least), "lang string, words array<string>, f long"), "phrases")


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(
    space: Workspace,
    docs: DataFrame,
    least: int = 30,
    top: int = 2_000,
    covered: int = 80,
    lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first `top` phrases of every language.

    Candidates are phrases of 2 to LONGEST words with at least `least` occurrences (a). A cut after k
    words gives l and r, the occurrences of both parts, and the score floor(2000000 * a / (l + r));
    the cut of least score counts, the first of equal ones. A candidate goes if a longer one that
    holds its words in a row has at least `covered` % of its occurrences. Ranks follow score, then a,
    both falling, then the phrase in byte order. n is the number of words of the language. Languages
    without candidates, empty and null texts and empty tables give no rows; other columns play no part.
    """
    found = frequent_phrases(space, docs, least, lang_column, text_column)
    totals = found.filter(F.size("words") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    counts = found.filter(F.size("words") > 0).select("lang", _phrase(F.col("words")).alias("part"), "f")
    candidates = found.filter(F.size("words") > 1)
    named = candidates.select("lang", "words", _phrase(F.col("words")).alias("phrase"), F.col("f").alias("a"))

    cuts = named.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    first = _phrase(F.slice("words", F.lit(1), F.col("k"))).alias("first")
    rest = _phrase(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("rest")
    cuts = space.save(cuts.select("lang", "phrase", "a", "k", first, rest), "cuts")
    sides = cuts
    for side, count in (("first", "l"), ("rest", "r")):
        heavy = heavy_keys(cuts, ["lang", side])
        of_side = counts.select("lang", F.col("part").alias(side), F.col("f").alias(count))
        sides = spread_join(sides, of_side, ["lang", side], heavy=heavy)
    score = F.expr("(cast(2000000 as decimal(20, 0)) * cast(a as decimal(18, 0))) div cast(l + r as decimal(20, 0))")
    lowest = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda at: _phrase(F.slice("words", at, m))),
        )
    )
    longer = named.filter(F.size("words") > 2).select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
    above = longer.groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    kept = lowest.join(above, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (100 * F.col("above") < covered * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # The first of each part hold the first of all, so no task ranks a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_RANK_PARTS))
    early = kept.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = early.filter(F.col("place") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
