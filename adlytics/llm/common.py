"""What several corpus operators share: word rules, folds, vectorised word splitting."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space separates words; everything else belongs to one.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\f\r"


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def bounded_sample(rows: DataFrame, key: str, strata: str, most: int) -> DataFrame:
    """About `most` rows of each stratum at the most, chosen by a hash of the key.

    The choice depends on the key alone, so it is the same under any partitioning. Strata are
    class labels: few by nature.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(strata).count().collect()}
    keep = F.lit(False)
    for value, size in sizes.items():
        limit = int(min(1.0, most / size) * (1 << 30))
        keep = keep | ((F.col(strata) == F.lit(value)) & (F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30)) < limit))
    return rows.filter(keep)


class Words:
    """The words of a batch of texts: codes into distinct words, and where each text begins."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        filled = pc.not_equal(flat, "")
        mask = np.asarray(filled)
        ends = np.concatenate(([0], np.cumsum(mask)))
        self.starts = ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        coded = flat.filter(filled).dictionary_encode()
        self.codes = np.asarray(coded.indices).astype(np.int64)
        distinct = coded.dictionary
        if lower:
            lowered = pc.ascii_lower(distinct).dictionary_encode()
            self.codes = np.asarray(lowered.indices).astype(np.int64)[self.codes]
            distinct = lowered.dictionary
        self.distinct: list[str] = distinct.to_pylist()
        self.counts = np.diff(self.starts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each distinct word."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in self.distinct), np.uint64, len(self.distinct))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value given per word."""
        total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return total[self.starts[1:]] - total[self.starts[:-1]]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one hold about `most` bytes; a longer text comes alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        start, held = 0, 0
        for at, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library keep it otherwise, as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, which gives back what it held when a task ends: workers idle on beside later stages."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return ends
