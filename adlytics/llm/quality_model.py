"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each class of labelled documents is a normal density over the statistics. Its covariance is shrunk
towards its diagonal and a share of the pooled variance. A score is the posterior of class 1, from
the difference of the two log densities; each uses the Cholesky factor of its class, found once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from adlytics.llm.common import Words, pieces

STATISTICS = (
    "log words", "mean word length", "symbol words", "upper-case words", "exclaimed words", "digit words",
    "words without letters", "symbol characters", "distinct words", "most frequent word", "words like the one before",
    "repeated pairs", "repeated lines", "lines per word",
)
_SYMBOLS = frozenset("#*$%&|<>^~_=+{}[]\\@")
#: Share of a covariance that is replaced by its diagonal, and share of the pooled variance added.
SHRINK = 0.2
POOL = 0.02
#: Added to counts that shares of repeats are taken of, so that one repeat in a short text says little.
FEW = 10.0
#: Bound of the log odds.
MOST_ODDS = 40.0


def _root(share: np.ndarray) -> np.ndarray:
    """Arc sine of the root: the spread of a share becomes about the same everywhere."""
    return np.arcsin(np.sqrt(np.clip(share, 0.0, 1.0)))


def _repeats(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct keys, and count of the most frequent one."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else np.zeros(0, int)
    runs = np.diff(np.append(first, len(keys)))
    distinct = np.bincount(owner[first], minlength=texts)
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, owner[first], runs)
    return distinct, most


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, statistics), all transformed; a text without words has zeros."""
    words = Words(texts, lower=False)
    n = words.counts.astype(float)
    some = np.maximum(n, 1.0)
    distinct = words.distinct
    of = lambda f, kind=float: words.sums(np.fromiter(map(f, distinct), kind, len(distinct))[words.codes])
    symbols = [sum(c in _SYMBOLS for c in w) for w in distinct]
    letters = [sum(map(str.isalpha, w)) for w in distinct]
    chars = np.maximum(of(len), 1.0)
    weigh = lambda v: words.sums(np.array(v, float)[words.codes])
    owner = np.repeat(np.arange(len(n)), words.counts)
    kinds, most = _repeats(words.codes, owner, len(n))
    next_same = (words.codes[1:] == words.codes[:-1]) & (owner[1:] == owner[:-1])
    stutter = np.bincount(owner[1:][next_same], minlength=len(n))
    within = owner[1:] == owner[:-1]
    pairs = words.codes[:-1][within] * len(distinct) + words.codes[1:][within]
    pair_kinds, _ = _repeats(pairs, owner[1:][within], len(n))
    n_pairs = np.maximum(n - 1, 0)
    lines = [[x for x in (t or "").split("\n") if x and not x.isspace()] for t in texts.to_pylist()]
    n_lines = np.array([len(x) for x in lines], float)
    new_lines = np.array([len(set(x)) for x in lines], float)
    rows = [
        np.log1p(n),
        np.log1p(chars / some) * (n > 0),
        _root(weigh([s > 0 for s in symbols]) / some),
        _root(weigh([w.isupper() and k > 1 for w, k in zip(distinct, letters)]) / some),
        _root(weigh(["!" in w for w in distinct]) / some),
        _root(weigh([any(map(str.isdigit, w)) for w in distinct]) / some),
        _root(weigh([k == 0 for k in letters]) / some),
        _root(weigh(symbols) / chars),
        _root(1 - kinds / some) * (n > 0),
        _root(most / some),
        _root(stutter / (n + FEW)),
        _root((n_pairs - pair_kinds) / (n_pairs + FEW)),
        _root((n_lines - new_lines) / (n_lines + FEW)),
        _root(n_lines / some) * (n > 0),
    ]
    return np.stack(rows, axis=1)


def add_statistics(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """Add the statistics of the whole text to every row; null counts as empty."""
    rows = docs.drop(name)
    names = [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            found = statistics(piece.column(text))
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))], names=names
            )

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, ArrayType(DoubleType()))]))


@dataclass
class Discriminant:
    """Per class: log share, mean, inverse Cholesky factor and log of its determinant."""

    shares: list[float]
    means: list[np.ndarray]
    inverse: list[np.ndarray]
    log_det: list[float]

    def log_odds(self, stats: np.ndarray) -> np.ndarray:
        """Log odds of class 1 by the difference of log densities."""
        dense = []
        for share, mean, inverse, log_det in zip(self.shares, self.means, self.inverse, self.log_det):
            away = (stats - mean) @ inverse.T
            dense.append(share + log_det - 0.5 * np.einsum("ij,ij->i", away, away))
        return np.clip(dense[1] - dense[0], -MOST_ODDS, MOST_ODDS)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(stats)))


def fit(rows: DataFrame, label: str = "label", stats: str = "stats") -> Discriminant:
    """Fit to rows with a label 0 or 1; all of them count, by sums that Spark adds up.

    A class without rows has the mean and spread of the other one; without any rows all scores
    are 0.5.
    """
    d = len(STATISTICS)
    at = [F.get(stats, F.lit(i)) for i in range(d)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(at)]
    products = [F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    found = rows.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()
    told: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for row in found:
        n = row["n"]
        mean = np.array([row[f"s{i}"] for i in range(d)]) / n
        square = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                square[i, j] = square[j, i] = row[f"p{i}_{j}"] / n
        told[row[label]] = n, mean, square - np.outer(mean, mean)
    if not told:
        told = {0: (1, np.zeros(d), np.eye(d))}
    (other,) = list(told.values())[:1]
    both = [told.get(k, (1, *other[1:])) for k in (0, 1)]
    if len(told) == 1 and not found:
        both = [other, other]
    whole = sum(n for n, _, _ in both)
    pooled = sum(n * np.diag(c) for n, _, c in both) / whole
    shares, means, inverse, log_det = [], [], [], []
    for n, mean, covariance in both:
        own = np.diag(np.diag(covariance))
        shrunk = (1 - SHRINK) * covariance + SHRINK * own + np.diag(POOL * pooled + 1e-4)
        factor = np.linalg.cholesky(shrunk)
        shares.append(float(np.log(n / whole)))
        means.append(mean)
        inverse.append(np.linalg.inv(factor))
        log_det.append(-float(np.log(np.diag(factor)).sum()))
    return Discriminant(shares, means, inverse, log_det)


def score(rows: DataFrame, model: Discriminant, threshold: float = 0.3, stats: str = "stats") -> DataFrame:
    """Replace the statistics by score (0 to 1) and predicted (1 from the threshold on)."""
    kept = [c for c in rows.columns if c not in (stats, "score", "predicted")]
    fields = [rows.schema[c] for c in kept]
    schema = StructType([*fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stat = batch.column(stats).flatten().to_numpy().reshape(-1, len(STATISTICS))
            columns = [*(batch.column(c) for c in kept), pa.array(model.score(stat))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score"])

    found = rows.select(*kept, stats).mapInArrow(run, schema)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
