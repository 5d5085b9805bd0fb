"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel counts the subsequences of three characters that two strings share, weighted by DECAY
for each position they span, so characters in between (gaps, insertions) only lower the weight.
Spans end at SPAN characters. The machine uses exp(SHARPEN * (k - 1)) of the normalised kernel k,
which is a kernel again and tells an insult from words that merely share an ending. Strings are the words of sentences; single letters in a row are one
word, so spelled-out insults are seen whole. A sentence scores as its worst word and a text as its
worst sentence.

Training sentences come from labelled documents. Landmarks are words that toxic documents have
more often than others, and common words of the others. The label of a document says nothing of
its single sentences, so the sentence that the current model finds worst stands for its document,
first by word counts and then by the machine itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from adlytics.llm.common import Words, bounded_sample, pieces

LENGTH = 3
SPAN = 7
DECAY = 0.75
#: Characters fall into so many symbols: a-z each for itself, all others by code point.
SYMBOLS = 64
LONGEST_WORD = 32
LANDMARKS = 96
COMMON_LANDMARKS = 32
#: Similar landmarks say the same.
TOO_SIMILAR = 0.8
#: Labelled documents of each class that are used at most.
MOST_DOCS = 4_000
MOST_UNITS = 4_000
ROUNDS = 2
SURPLUS = 2.0
REGULARISE = 1e-4
SHARPEN = 6.0
#: Cached scores of words in a worker: several batches of 160,000 distinct words, of which most recur, so
#: few are rated again. About 75 MB.
CACHED_WORDS = 500_000
_OFFSETS = [(0, *c) for c in combinations(range(1, SPAN), LENGTH - 1)]


def symbols(word: str) -> list[int]:
    return [ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % (SYMBOLS - 26) for c in word]


def units(words: list[str]) -> list[str]:
    """The strings of a sentence: its words, and runs of three or more single letters as one."""
    found, run = [], []
    for word in [*words, ""]:
        if len(word) == 1 and word.isalpha():
            run.append(word)
            continue
        if len(run) >= 3:
            found.append("".join(run))
        run = []
        if word:
            found.append(word)
    return found


def windows(word: str) -> list[str]:
    """The word, or overlapping parts of a very long one."""
    if len(word) <= LONGEST_WORD:
        return [word]
    step = LONGEST_WORD // 2
    return [word[i : i + LONGEST_WORD] for i in range(0, len(word) - step, step)]


def variants(word: str) -> list[str]:
    """Parts of the word as it is, and of its letters alone when marks or digits stand between them."""
    plain = "".join(c for c in word if c.isalpha())
    return [p for w in ((word, plain) if plain != word else (word,)) if len(w) >= LENGTH for p in windows(w)]


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, subsequence, weight) of unit-length feature vectors; strings have at most LONGEST_WORD characters."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(lengths) - lengths
    flat = np.array([s for w in strings for s in symbols(w)] + [0] * SPAN, np.int64)
    owner = np.repeat(np.arange(len(strings)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(owner))  # characters to the end
    keys, weights = [], []
    at = np.arange(len(owner))
    for offsets in _OFFSETS:
        fits = at[left > offsets[-1]]
        key = owner[fits]
        for o in offsets:
            key = key * SYMBOLS + flat[fits + o]
        keys.append(key)
        weights.append(np.full(len(fits), DECAY ** (offsets[-1] + 1)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    key, place = np.unique(key, return_inverse=True)
    weight = np.bincount(place, weight, minlength=len(key))
    size = SYMBOLS**LENGTH
    owner = key // size
    norm = np.sqrt(np.bincount(owner, weight * weight, minlength=len(strings)))
    return owner, key % size, weight / np.maximum(norm[owner], 1e-12)


class Landmarks:
    """Strings to compare with: their subsequences, and the weight of each in every landmark."""

    def __init__(self, strings: list[str]):
        owner, key, weight = features(strings)
        self.keys, row = np.unique(key, return_inverse=True)
        self.dense = np.zeros((len(self.keys) + 1, len(strings)), np.float32)  # the last row: in no landmark
        self.dense[row, owner] = weight

    def kernel(self, strings: list[str]) -> np.ndarray:
        """(strings, landmarks) normalised kernel."""
        out = np.zeros((len(strings), self.dense.shape[1]), np.float32)
        for start in range(0, len(strings) if len(self.keys) else 0, 2_000):
            owner, key, weight = features(strings[start : start + 2_000])
            row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            shared = np.flatnonzero(self.keys[row] == key)
            order = shared[np.argsort(owner[shared], kind="stable")]
            if not len(order):
                continue
            mine = owner[order]
            first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            products = self.dense[row[order]] * weight[order, None].astype(np.float32)
            out[start + mine[first]] = np.add.reduceat(products, first, axis=0)
        return out

    def sharpened(self, strings: list[str]) -> np.ndarray:
        return np.exp(SHARPEN * (self.kernel(strings) - 1))


@dataclass
class ToxicityModel:
    """Landmarks, their weights, bias, and the scale from margin to score."""

    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, strings: list[str]) -> np.ndarray:
        return self.landmarks.sharpened(strings) @ self.weights + self.bias

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -40, 40)))


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, in lower case: sentences end at line ends and at words ending in . ! or ?"""
    found: list[list[str]] = []
    for line in text.lower().split("\n"):
        held: list[str] = []
        for word in line.split():
            held.append(word)
            if word[-1] in ".!?":
                found.append(held)
                held = []
        if held:
            found.append(held)
    return found


def bare(word: str) -> str:
    """Without marks around it."""
    return word.strip(".,;:!?\"'()[]{}*%$#&|<>-_~")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(piece.column("text").to_pylist(), piece.column("label").to_pylist()):
            seen[label].update({v for s in sentences(text or "") for u in units(s) for v in variants(bare(u))})
        items = sorted(seen[0].keys() | seen[1].keys())
        columns = [pa.array(items, pa.string()), *(pa.array([c[w] for w in items], pa.int64()) for c in seen)]
        yield pa.RecordBatch.from_arrays(columns, names=["unit", "clean", "toxic"])


def _worst(rate: Callable[[list[str]], np.ndarray]):
    """Per document the unit that its worst sentence holds, with its rate."""

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found, best, labels = [], [], []
            for text, label in zip(piece.column("text").to_pylist(), piece.column("label").to_pylist()):
                own = sorted({v for s in sentences(text or "") for u in units(s) for v in variants(bare(u))})
                if own:
                    rates = rate(own)
                    at = int(np.argmax(rates))
                    found.append(own[at])
                    best.append(float(rates[at]))
                    labels.append(label)
            columns = [pa.array(found, pa.string()), pa.array(best, pa.float64()), pa.array(labels, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "rate", "label"])

    return worst


_WORST = "unit string, rate double, label int"


def _machine(inputs: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine with a bias, by Newton steps on the support vectors."""
    x = np.hstack([inputs, np.ones((len(inputs), 1))])
    ridge = REGULARISE * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(50):
        inside = target * (x @ w) < 1
        xs, ts, cs = x[inside], target[inside], weight[inside]
        new = np.linalg.solve(ridge + (xs * cs[:, None]).T @ xs, (xs * cs[:, None]).T @ ts)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def _landmarks(toxic: list[str], common: list[str]) -> list[str]:
    """Greedily, in order, words that are not too similar to those chosen before."""
    chosen: list[str] = []
    for words, most in ((toxic, LANDMARKS - COMMON_LANDMARKS), (common, LANDMARKS)):
        rated = Landmarks(words).kernel(words) if words else np.zeros((0, 0))
        kept: list[int] = []
        for i, word in enumerate(words):
            if len(chosen) >= most:
                break
            if word not in chosen and all(rated[i, j] < TOO_SIMILAR for j in kept):
                kept.append(i)
                chosen.append(word)
    return chosen


def _scale(rates: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on margins, both classes weighing alike."""
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    x = np.stack([rates, np.ones(len(rates))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - toxic)) + 1e-4 * w * [1, 0]
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(curve, gradient)
        w = w - np.clip(step, -2, 2)
    return float(max(w[0], 0.1)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> ToxicityModel:
    """Learn from labelled documents: labels has rows (key, label) with labels 0 and 1.

    At most about MOST_DOCS documents of each label are used, chosen by a hash of the key; so few
    keys are broadcast. Without documents of both labels every score is low.
    """
    chosen = F.broadcast(bounded_sample(labels.filter("label in (0, 1)"), key, "label", MOST_DOCS).select(key, "label"))
    rows = docs.select(key, F.col(text).alias("text")).join(chosen, key).select("text", F.col("label").cast("int").alias("label"))
    rows = rows.persist()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        rows.unpersist()
        return ToxicityModel(Landmarks([]), np.zeros(0), -1.0, 4.0)
    counted = rows.mapInArrow(_counts, "unit string, clean long, toxic long").groupBy("unit")
    counted = counted.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    # Log likelihood ratio of the unit's own share of toxic documents against the share in all; it
    # has to outweigh the number of units that are looked at.
    usual = sizes[1] / (sizes[0] + sizes[1])
    own = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    evidence = F.col("toxic") * F.log(own / usual)
    evidence += F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - own) / (1 - usual))).otherwise(F.lit(0.0))
    least = float(np.log(max(1, counted.count()))) + SURPLUS
    toxic = counted.filter(own > usual).withColumn("evidence", evidence).filter(F.col("evidence") > least)
    toxic = toxic.orderBy(F.desc("evidence"), "unit").limit(MOST_UNITS).collect()
    common = [r["unit"] for r in counted.orderBy(F.desc("clean"), "unit").limit(4 * LANDMARKS).collect()]
    counted.unpersist()
    known = {r["unit"]: float(r["evidence"]) for r in toxic}
    certain = Counter({r["unit"]: r["toxic"] for r in toxic})
    marks = _landmarks([r["unit"] for r in toxic][: 8 * LANDMARKS], [w for w in common if w not in known])
    landmarks = Landmarks(marks)
    values, vectors = np.linalg.eigh(landmarks.sharpened(marks).astype(float))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
    model = None
    by_counts = lambda own: np.array([known.get(w, 0.0) for w in own])
    rate: Callable[[list[str]], np.ndarray] = by_counts
    negatives: Counter = Counter(common)
    for _ in range(ROUNDS + 1):
        # One row per document of the bounded sample.
        worst = rows.mapInArrow(_worst(rate), _WORST).groupBy("unit", "label").count().collect()
        found = {r["unit"]: r["count"] for r in worst if r["label"] == 1 and model is not None}
        positives = Counter(found | {w: max(n, found.get(w, 0)) for w, n in certain.items()})
        negatives.update({r["unit"]: r["count"] for r in worst if r["label"] == 0})
        items = [*positives, *(w for w in negatives if w not in positives)]
        target = np.array([1.0] * len(positives) + [-1.0] * (len(items) - len(positives)))
        weight = np.sqrt([float(positives[w] if w in positives else negatives[w]) for w in items])
        # A word that stands for documents of both labels belongs to the one that has it more often.
        for i, w in enumerate(items[: len(positives)]):
            if negatives.get(w, 0) * sizes[1] > positives[w] * sizes[0]:
                target[i] = -1.0
        weight /= np.where(target > 0, weight[target > 0].sum(), weight[target < 0].sum())
        w, bias = _machine(landmarks.sharpened(items) @ whiten, target, weight)
        model = ToxicityModel(landmarks, whiten @ w, bias)
        rate = model.margins
    judged = rows.mapInArrow(_worst(rate), _WORST).select("rate", "label").collect()
    rows.unpersist()
    rates, toxic_docs = np.array([r["rate"] for r in judged]), np.array([r["label"] == 1 for r in judged])
    model.slope, model.offset = _scale(rates, toxic_docs)
    return model


_CACHE: dict[str, float] = {}
_CACHED_FOR: list[bytes] = []


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from the threshold on) to every row.

    A text without a word of LENGTH letters, null and empty ones included, gets the least score.
    Whole texts are read; rows are scored one by one, so repeated rows score alike; columns of the
    added names are replaced.
    """
    rows = docs.drop("score", "predicted")
    names = [*rows.columns, "score"]
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.weights.tobytes() + model.landmarks.dense.tobytes()
        if _CACHED_FOR != [own]:  # a worker may serve another model next
            _CACHE.clear()
            _CACHED_FOR[:] = [own]
        for piece in pieces(batches, text):
            words = Words(piece.column(text), lower=False)
            plain = [bare(w.lower()) for w in words.distinct]
            rated = _rate(model, plain)
            worst = np.full(piece.num_rows, -4.0)
            filled = np.flatnonzero(words.counts)
            if len(filled):
                worst[filled] = np.maximum.reduceat(rated[words.codes], words.starts[:-1][filled])
            single = np.array([len(w) == 1 and w.isalpha() for w in plain], bool)
            for at in _spelled(words, single):
                joined = [x for x in units([plain[c] for c in words.codes[words.starts[at] : words.starts[at + 1]].tolist()]) if len(x) >= LENGTH]
                if joined:
                    worst[at] = max(worst[at], _rate(model, joined).max())
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(model.score(worst))], names=names)

    found = rows.mapInArrow(run, schema)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _spelled(words: Words, single: np.ndarray) -> list[int]:
    """Texts with three single letters in a row."""
    if len(words.codes) < 3:
        return []
    one = single[words.codes]
    runs = np.flatnonzero(one[:-2] & one[1:-1] & one[2:])
    owner = np.searchsorted(words.starts, runs, "right") - 1
    return np.unique(owner[runs + 2 < words.starts[owner + 1]]).tolist()


def _rate(model: ToxicityModel, plain: list[str]) -> np.ndarray:
    """Margin of each word, the largest of its parts; words below LENGTH letters rate least."""
    new = sorted({w for w in plain if w not in _CACHE})
    if len(_CACHE) + len(new) > CACHED_WORDS:
        _CACHE.clear()
        new = sorted(set(plain))
    long_enough = [(w, part) for w in new for part in variants(w)]
    _CACHE.update(dict.fromkeys(new, -4.0))
    for start in range(0, len(long_enough), 20_000):
        some = long_enough[start : start + 20_000]
        for (w, _), m in zip(some, model.margins([part for _, part in some]).tolist()):
            _CACHE[w] = max(_CACHE[w], m)
    return np.fromiter(map(_CACHE.__getitem__, plain), float, len(plain))
