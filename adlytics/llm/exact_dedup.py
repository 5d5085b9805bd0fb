"""Exact duplicates by block naming: equal texts get equal integer names, different ones never do.

A text is cut into blocks of a fixed length. The distinct blocks are sorted and numbered, and
the number is the name of the block. Then adjacent names are paired, distinct pairs are sorted
and numbered in turn, and so on until one name is left for each text. Texts of one number of
blocks are equal if and only if their last names are.

The blocks travel once, to be sorted. A block finds its name by a 64-bit hash; where two
different blocks share a hash, they are told apart by comparing the blocks themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics.llm.common import SPACE, text_of
from adlytics.workspace import Workspace

BLOCK = 4096  # code points


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def _numbered(space: Workspace, distinct: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct rows with an integer each: sorted within their partition, then counted through.

    Written at once, so that the numbers stay what they are when executors are lost.
    """
    rows = distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())
    return space.save(rows, name)


def _block_names(space: Workspace, blocks: DataFrame) -> DataFrame:
    """Rows (doc, n_blocks, pos, name) of rows (doc, n_blocks, pos, hash, block); repeated rows stay."""
    names = _numbered(space, blocks.select("hash", "block").distinct(), ["hash", "block"], "block-names")
    shared = names.groupBy("hash").agg(F.count(F.lit(1)).alias("blocks"), F.min("name").alias("name"))
    one = shared.filter("blocks = 1").select("hash", "name")
    several = shared.filter("blocks > 1").select("hash")
    placed = blocks.select("doc", "n_blocks", "pos", "hash").join(one, "hash").drop("hash")
    if several.isEmpty():
        return placed
    apart = names.join(several, "hash", "left_semi")
    compared = blocks.join(several, "hash", "left_semi").join(apart, ["hash", "block"])
    return placed.unionByName(compared.select("doc", "n_blocks", "pos", "name"))


def _paired(space: Workspace, names: DataFrame, level: int) -> DataFrame:
    """One level up: rows (doc, n_blocks, rows, pos, name) with half as many positions."""
    even = F.col("pos") % 2 == 0
    pairs = names.groupBy("doc", "n_blocks", "rows", F.floor(F.col("pos") / 2).alias("pos")).agg(
        F.max(F.when(even, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
    )
    pairs = space.save(pairs, f"pairs-{level}")
    named = _numbered(space, pairs.select("left", "right").distinct(), ["left", "right"], f"pair-names-{level}")
    return space.save(pairs.join(named, ["left", "right"]).drop("left", "right"), f"names-{level}")


def duplicates(space: Workspace, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 and rows.

    Null texts count as empty. Of equal texts the one with the smallest id is kept; a null id
    comes after all others. Rows that repeat an id and a text are one document, so they give one
    row, with their number in `rows`; an id with several texts gives a row for each. Other columns play no part. An empty
    table gives no rows.
    """
    normal = docs.select(F.col(id_column).alias("id"), normalised(text_of(text_column)).alias("text")).select(
        F.struct("id", F.unhex(F.sha2("text", 256)).alias("sha")).alias("doc"), "text"
    )
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut)
    blocks = (
        normal.select("doc", cut.alias("cut"))
        .select("doc", F.size("cut").alias("n_blocks"), F.posexplode("cut").alias("pos", "block"))
        .withColumn("hash", F.xxhash64("block"))
    )
    names = _block_names(space, blocks).groupBy("doc", "n_blocks", "pos", "name").agg(F.count(F.lit(1)).alias("rows"))
    names = space.save(names, "names")
    most = names.agg(F.max("n_blocks")).first()[0] or 1
    done = names.filter("n_blocks = 1").select("doc", "n_blocks", "name", "rows")
    open_ = names.filter("n_blocks > 1")
    length, level = 1, 0
    while length < most:
        level, length = level + 1, length * 2
        open_ = _paired(space, open_, level)
        done = done.unionByName(open_.filter(F.col("n_blocks") <= length).select("doc", "n_blocks", "name", "rows"))
        open_ = open_.filter(F.col("n_blocks") > length)
    done = space.save(done, "identities")
    groups = done.groupBy("n_blocks", "name").agg(F.min("doc.id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return done.join(groups, ["n_blocks", "name"]).select(
        F.col("doc.id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("doc.id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("doc.sha")).alias("text_sha256"),
        "rows",
    )
