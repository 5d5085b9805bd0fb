"""Quality rules: counts of each text, and the log-likelihood ratio of its hashed n-grams.

Words and word pairs are hashed into buckets. Two multinomials over the buckets are counted, one
from trusted documents and one from the whole corpus. A document's verdict is the mean, over its
n-grams, of the log ratio of the two probabilities, held against one threshold for all. Every trusted
document is used: half of them are counted, the others are left out of the counts; the threshold is
set below what they score, so that it fits the amount of data that was counted. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlytics.llm.common import SPACE, WORD, text_of
from adlytics.workspace import Workspace

SYMBOLS = "[#*$%&|<>]"
BUCKETS = 1 << 16
MIN_WORDS = 50
#: Per cent of the words that may lie in repeated windows.
MOST_REPEATED = 50
WINDOW = 3
#: The threshold lies below this share of trusted documents that were left out of the counts, by
#: this part of their distance from the median.
LOW_SHARE = 0.005
MARGIN = 0.25


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where the optimizer moves the whole expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(hashes: Column, length: int) -> Column:
    """Hash of each window of so many words; empty for texts with fewer."""

    def of(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - length)
        each = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(length)]))
        return F.when(F.size(h) >= length, each).otherwise(F.array().cast("array<bigint>"))

    return _let(hashes, of)


def _neighbours(placed: Column) -> Column:
    """Places whose hash is also that of the row before or after, of sorted (hash, place)."""
    same = lambda s, j, k: F.coalesce(F.get(s, j + k)["h"] == F.get(s, j)["h"], F.lit(False))
    marked = lambda s: F.transform(s, lambda x, j: F.when((j > 0) & same(s, j, -1) | same(s, j, 1), x["i"]))
    return _let(placed, lambda s: F.sort_array(F.filter(marked(s), lambda i: i.isNotNull())))


def _repeated_words(windows: Column) -> Column:
    """Words that lie in a window found twice or more, given the windows in order.

    Windows are sorted with their places; equal neighbours are repeats. Going along the places,
    each window adds the words that the one before it did not cover.
    """

    def covered(places: Column) -> Column:
        new = lambda at, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), at - F.get(places, k - 1)))
        return F.aggregate(F.transform(places, new), F.lit(0), lambda a, b: a + b)

    def of(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(_neighbours(placed), covered))

    return _let(windows, of).cast("long")


def hashed(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """Rows (row, _text, _chars, _hashes): the columns to keep as one, the text, code points in words, a 64-bit hash of each word."""
    words = F.filter(F.split("_text", SPACE), lambda w: w != "")
    rows = docs.select(F.struct(*keep).alias("row"), text_of(text_column).alias("_text")).withColumn("_words", words)
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    return rows.select("row", "_text", F.length(F.array_join("_words", "")).cast("long").alias("_chars"), hashes.alias("_hashes"))


def _buckets(hashes: Column) -> Column:
    """Bucket of every word and word pair."""
    return _let(hashes, lambda h: F.transform(F.concat(h, _windows(h, 2)), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents whose every label says quality 1."""
    voted = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return voted.filter("quality = 1").select("doc_id")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of these ids, which may be as many as the documents: nothing is broadcast unmeasured, and no text is sorted."""
    return docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")


def _bucket_counts(docs: DataFrame, text_column: str, into: str) -> DataFrame:
    rows = hashed(docs, ["doc_id"], text_column)
    return rows.select(F.explode(_buckets(F.col("_hashes"))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(into))


def log_ratios(docs: DataFrame, trusted: DataFrame, text_column: str = "text") -> str:
    """Per bucket, the log of its probability in documents of trusted ids over that in all, as one list."""
    return _log_ratios(docs, _of(docs.select("doc_id", text_column), trusted), text_column)


def _log_ratios(docs: DataFrame, own: DataFrame, text_column: str) -> str:
    """``log_ratios`` of the trusted documents themselves.

    One is added to every count. The list has as many numbers as there are buckets, at any size of
    the corpus.
    """
    all_buckets = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = all_buckets.join(_bucket_counts(docs, text_column, "raw"), "bucket", "left")
    counts = counts.join(_bucket_counts(own, text_column, "trusted"), "bucket", "left")
    whole = Window.partitionBy()
    share = lambda c: (F.coalesce(c, F.lit(0)) + 1) / F.sum(F.coalesce(c, F.lit(0)) + 1).over(whole)
    rated = counts.select(F.struct("bucket", F.log(share(F.col("trusted")) / share(F.col("raw"))).alias("ratio")).alias("r"))
    listed = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["ratio"].cast("string"))
    return rated.agg(F.array_join(listed, ",").alias("ratios")).first()[0]


def fit(docs: DataFrame, trusted: DataFrame, text_column: str = "text", space: Workspace | None = None) -> tuple[str, float]:
    """Ratios and threshold from all documents and the ids of trusted ones, each of which counts.

    With a workspace the trusted documents are saved there, so they are looked up once. Without a
    trusted document that is left out of the counts and long enough, nothing but the counts fails a
    document.
    """
    own = _of(docs.select("doc_id", text_column), trusted)
    own = own if space is None else space.save(own, "trusted")
    half = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2))
    ratios = _log_ratios(docs, own.filter(half == 0), text_column)
    scored = judge(own.filter(half == 1), ratios, float("-inf"), text_column).filter("n_words >= %d" % MIN_WORDS)
    low, median = scored.agg(F.percentile("log_ratio", F.lit(LOW_SHARE)), F.percentile("log_ratio", F.lit(0.5))).first()
    return ratios, float("-inf") if low is None else low - MARGIN * (median - low)


def judge(docs: DataFrame, ratios: str, threshold: float, text_column: str = "text") -> DataFrame:
    """Add the counts, base_failed, log_ratio and kept to every row.

    Null texts count as empty. base_failed: fewer than MIN_WORDS words, or more than MOST_REPEATED
    per cent of them in repeated windows. log_ratio is the mean over words and word pairs, 0 without
    words. kept: not base_failed, and log_ratio at or above the threshold. Rows are judged one by
    one, so repeated rows are judged alike; columns of the added names are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio", "base_failed", "kept"]
    rows = hashed(docs, [c for c in docs.columns if c not in added], text_column)
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    rows = rows.withColumns(
        {
            "n_words": F.size("_hashes").cast("long"),
            "word_chars": F.col("_chars"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "_lines": lines,
            "_windows": _windows(F.col("_hashes"), WINDOW),
            "_buckets": _buckets(F.col("_hashes")),
        }
    )
    model = F.split(F.lit(ratios), ",").cast("array<double>")  # folded to a constant when the query is planned
    rows = rows.withColumns(
        {
            "n_dup_lines": _let(F.col("_lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": _repeated_words(F.col("_windows")),
            "_sum": F.aggregate("_buckets", F.lit(0.0), lambda total, b: total + F.get(model, b)),
        }
    )
    rows = rows.withColumns(
        {
            "log_ratio": F.when(F.size("_buckets") > 0, F.col("_sum") / F.size("_buckets")).otherwise(F.lit(0.0)),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED),
        }
    )
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= F.lit(threshold)))
    return rows.select("row.*", *added)
