"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source, rows are dealt to ranges of that key and sorted
in their range; sums of sizes per range, added up along the ranges, give the number of words before
every row. A source's budget is then cut there: whole epochs first, then the rows in front of the
cut. The key is a uniform hash, so its ranges are known without sampling and no source, however
large, is ever sorted in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlytics.llm.common import WORD, text_of
from adlytics.workspace import Workspace

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Rows in one range of a source on average, and ranges that are added up together.
RANGE_ROWS = 200
RANGE_GROUP = 1000
#: The table of sources is broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_SOURCES = 10_000
_KEY_DIGITS = 15


def words_in(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def random_key(id_column: str, seed: int) -> Column:
    """60 bits of the md5 of seed and id, the id as text and null as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, _KEY_DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Add number, target to rows (source, rows, source_size), one per source.

    Sources share the sum of all sizes by their weights, taken in turn along the names (null last).
    A source stops at most_epochs times its size; what it leaves is shared anew by weight. So each
    gets its limit or the common level times its weight, whichever is less. Along the limits per
    weight, the level that the sources from one on would get from what is left first rises and then
    falls, and the highest is the common one.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("number", F.row_number().over(names))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    limited = numbered.withColumns(
        {"weight": weight.cast("double"), "most": F.col("source_size").cast("double") * most_epochs}
    )
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    sharers = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = limited.withColumn("level", left / sharers)
    target = F.least("most", F.col("weight") * F.max("level").over(whole))
    return levelled.select("source", "rows", "source_size", "number", target.alias("target"))


def _starts(sums: DataFrame) -> DataFrame:
    """Words before each range of a source, of rows (_sid, _range, _sum): within groups of ranges, then along the groups."""
    grouped = sums.withColumn("_group", F.floor(F.col("_range") / RANGE_GROUP))
    ahead = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("_sid", "_group").agg(F.sum("_sum").alias("_sum"))
    groups = groups.select("_sid", "_group", ahead(Window.partitionBy("_sid").orderBy("_group")).alias("_before"))
    inner = grouped.withColumn("_inner", ahead(Window.partitionBy("_sid", "_group").orderBy("_range")))
    return inner.join(groups, ["_sid", "_group"]).select("_sid", "_range", (F.col("_before") + F.col("_inner")).alias("_start"))


def mix(
    space: Workspace,
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: int = 42,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add size, source_size, target, copies and taken to every row, of which `keep` names the columns that stay.

    size counts words (null text: 0). copies says how often the mix holds the row, taken is
    copies * size: the target's whole epochs, plus one for rows in front of the cut. The row across
    the cut is taken when that comes nearer to the target. The same rows give the same mix
    whatever their order or partitioning; rows alike in id and size are interchangeable. Null
    is a source of its own, rows without words are never taken, an empty table gives no rows.
    Columns of the names added are replaced.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    # The row travels as one column, so that no name of it can clash with those used here.
    sized = docs.select(
        F.struct(*kept).alias("row"),
        F.col(id_column).alias("_id"),
        words_in(text_column).alias("_size"),
        random_key(id_column, seed).alias("_key"),
        F.col(source_column).alias("_source"),
    )
    sizes = sized.groupBy(F.col("_source").alias("source")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("source_size")
    )
    budget = space.save(targets(sizes, weights, most_epochs), "targets")
    few = budget.count() <= BROADCAST_SOURCES
    budget = budget.select(
        F.col("source").alias("_of"), F.col("number").alias("_sid"), F.col("rows").alias("_rows"), "source_size", "target"
    )
    joined = sized.join(F.broadcast(budget) if few else budget, F.col("_source").eqNullSafe(F.col("_of")))
    ranges = F.ceil(F.col("_rows") / RANGE_ROWS)
    at = F.floor(F.col("_key") / F.lit(float(16**_KEY_DIGITS)) * ranges)
    dealt = joined.withColumn("_range", F.least(at, ranges - 1).cast("long"))
    starts = _starts(dealt.groupBy("_sid", "_range").agg(F.sum("_size").alias("_sum")))
    sorted_ = Window.partitionBy("_sid", "_range").orderBy("_key", F.col("_id").asc_nulls_last(), "_size")
    within = F.coalesce(F.sum("_size").over(sorted_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_within", within).join(starts, ["_sid", "_range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    front = F.col("_start") + F.col("_within")
    extra = F.col("_size") <= 2 * (rest - front)
    copies = F.when(F.col("_size") > 0, epochs + extra.cast("long")).otherwise(F.lit(0)).cast("long")
    return placed.select(
        "row.*",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("_size")).alias("taken"),
    )
