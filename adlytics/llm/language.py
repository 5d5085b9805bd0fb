"""Language ID: words by their log frequency per language, character n-grams for unseen words.

A known word scores its smoothed log frequency in each language. An unseen word falls back to
its character n-grams (with word boundaries), from the longest length down to single characters:
the first length of which any n-gram is known decides, with the mean of their log frequencies.
A text scores the sum over its words plus the log share of each language in the training rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from adlytics.llm.common import Words, bounded_sample, pieces, released
from adlytics.workspace import Workspace

LONGEST = 5
UNDETERMINED = "und"
#: Below this share of the score, a text gives no evidence for any of its languages.
MIN_SCORE = 0.3
#: No single word outweighs another by more than this in any language.
WORD_RANGE = 8.0
#: Unseen words whose n-grams are looked up together.
UNSEEN_WORDS = 20_000
SMOOTHING = 0.5
_BOUND = "\x02"


def letters(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalpha())


def grams(word: str, length: int) -> list[str]:
    if length == 1:
        return list(word)
    held = _BOUND + word + _BOUND
    return [held[i : i + length] for i in range(len(held) - length + 1)]


@dataclass
class LanguageModel:
    """Languages in order, their log shares, and by length (0: whole words) the items with their log frequencies.

    Tasks get items as sorted 64-bit hashes only: no strings, 8 bytes an item beside its frequencies.
    """

    languages: list[str]
    shares: np.ndarray
    items: list[list[str]]
    logs: list[np.ndarray]

    def __post_init__(self):
        self._tables = []
        for items, logs in zip(self.items, self.logs):
            hashes = _hashes(items)
            order = np.argsort(hashes)
            self._tables.append((hashes[order], np.asarray(logs)[order]))

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "shares": self.shares, "_tables": self._tables}

    def _known(self, length: int, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which items are known, and the row of each in the table of their length."""
        hashes, _ = self._tables[length]
        wanted = _hashes(items)
        if not len(hashes):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return hashes[at] == wanted, at

    def words(self, words: list[str]) -> np.ndarray:
        """Log frequencies of words, a row each; an empty word and one without a known n-gram have zeros."""
        found = np.zeros((len(words), len(self.languages)))
        known, at = self._known(0, words)
        found[known] = self._tables[0][1][at[known]]
        left = [k for k in np.flatnonzero(~known).tolist() if words[k]]
        for length in range(LONGEST, 0, -1):
            backed: set[int] = set()
            for start in range(0, len(left), UNSEEN_WORDS):
                some = np.array(left[start : start + UNSEEN_WORDS])
                each = [grams(words[k], length) for k in some.tolist()]
                of_word = np.repeat(np.arange(len(some)), list(map(len, each)))
                known, at = self._known(length, [g for one in each for g in one])
                of_word, rows = of_word[known], self._tables[length][1][at[known]]
                numbers = np.bincount(of_word, minlength=len(some))
                hit = np.flatnonzero(numbers)
                for i in range(len(self.languages)):
                    sums = np.bincount(of_word, rows[:, i], len(some))
                    found[some[hit], i] = sums[hit] / numbers[hit]
                backed.update(some[hit].tolist())
            left = [k for k in left if k not in backed]
        return found


def _hashes(items: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, items), np.uint64, len(items))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces([batch], "text"):
            found: dict[tuple[str, int], Counter] = {}
            words = Words(piece.column("text"), lower=False)
            plain = [letters(w) for w in words.distinct]
            langs = piece.column("lang").to_pylist()
            for lang in set(langs):
                mine = np.repeat(np.array([x == lang for x in langs]), words.counts)
                times = np.bincount(words.codes[mine], minlength=len(plain))
                for code in np.flatnonzero(times).tolist():
                    word, n = plain[code], int(times[code])
                    if word:
                        found.setdefault((lang, 0), Counter())[word] += n
                        for length in range(1, LONGEST + 1):
                            counts = found.setdefault((lang, length), Counter())
                            for gram in grams(word, length):
                                counts[gram] += n
            rows = [(lang, length, item, n) for (lang, length), c in found.items() for item, n in c.items()]
            lang, length, item, n = map(list, zip(*rows)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(length, pa.int32()), pa.array(item, pa.string()), pa.array(n, pa.int64())],
                names=["lang", "length", "item", "n"],
            )


def fit(
    docs: DataFrame,
    learn: Column,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    most_docs: int = 5_000,
    most_items: int = 40_000,
    least: int = 3,
) -> LanguageModel:
    """Learn from the rows where `learn` holds and the language is given.

    Bounds: at most about `most_docs` rows of each language, chosen by a hash of the key, and of
    each language its `most_items` most frequent words and as many n-grams of each length. They are
    seen `least` times or more in all, or in the language as many times less as it has fewer rows
    than `most_docs`, but once. The shares are those of all training rows. Without
    training rows the model has no language.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(learn & F.col("lang").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    rows = bounded_sample(rows, "key", "lang", most_docs)
    languages = sorted(sizes)
    if not languages:
        nothing = [[] for _ in range(LONGEST + 1)]
        return LanguageModel([], np.zeros(0), nothing, [np.zeros((0, 0))] * len(nothing))
    counts = rows.select("text", "lang").mapInArrow(released(_count), "lang string, length int, item string, n long")
    each = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)]
    by_item = counts.groupBy("length", "item").agg(F.sum("n").alias("n"), *each)
    sampled = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    tops = []
    with Workspace(docs.sparkSession) as space:
        by_item = space.save(by_item, "items")
        for i, x in enumerate(languages):
            own = max(1, math.ceil(least * min(1.0, sampled.get(x, 0) / most_docs)))
            often = by_item.filter((F.col(f"n{i}") >= own) | ((F.col("n") >= least) & (F.col(f"n{i}") > 0)))
            tops += [often.filter(F.col("length") == n).orderBy(F.desc(f"n{i}"), "item").limit(most_items) for n in range(LONGEST + 1)]
        kept = reduce(DataFrame.unionByName, tops).distinct().toArrow()
    length = np.asarray(kept.column("length"))
    seen = np.array([np.asarray(kept.column(f"n{i}")) for i in range(len(languages))], dtype=float).T.reshape(len(length), -1)
    items = kept.column("item").to_pylist()
    held, tables = [], []
    for wanted in range(LONGEST + 1):
        at = np.flatnonzero(length == wanted)
        logs = np.log((seen[at] + SMOOTHING) / (seen[at].sum(axis=0) + SMOOTHING * max(1, len(at))))
        if logs.size:
            logs = np.maximum(logs, logs.max(axis=1, keepdims=True) - WORD_RANGE)
        held.append([items[i] for i in at.tolist()])
        tables.append(logs)
    shares = np.array([sizes[x] for x in languages], float)
    return LanguageModel(languages, np.log(shares / shares.sum()), held, tables)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred (string) and score (0 to 1) to every row.

    lang_pred is `und` and the score 0 for a null text, a text without a letter, and when nothing
    was learned. The score is the share of the best language; ties go to the first by name. Whole
    texts are read; repeated rows score alike; columns of these two names are replaced.
    """
    rows = docs.drop("lang_pred", "score")
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    names = [*rows.columns, "lang_pred", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            words = Words(piece.column(text), lower=False)
            plain = [letters(w) for w in words.distinct]
            lettered = words.sums(np.array([bool(w) for w in plain], bool)[words.codes] if plain else np.zeros(0)) > 0
            best, share = [UNDETERMINED] * piece.num_rows, np.zeros(piece.num_rows)
            if model.languages:
                each = model.words(plain)
                total = np.stack([words.sums(each[words.codes, i]) for i in range(len(model.languages))], axis=1) + model.shares
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                odds /= odds.sum(axis=1, keepdims=True)
                top = odds.argmax(axis=1)
                best = [model.languages[t] if ok else UNDETERMINED for t, ok in zip(top.tolist(), lettered.tolist())]
                share = np.where(lettered, odds[np.arange(len(top)), top], 0.0)
            columns = [*piece.columns, pa.array(best, pa.string()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(released(score), schema)


def accepted(min_score: float = MIN_SCORE) -> Column:
    """Rows whose language is found: some letter, and more than no evidence."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= F.lit(min_score))
