"""From raw documents to tokens: language, exact copies, near copies, mixture, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. Each result is written as parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics.llm import bpe, exact_dedup, language, mixing, near_dedup
from adlytics.llm.common import fold, text_of
from adlytics.llm.queries import tokenizer, workspace

#: Word shingles and similarity (in hundredths) of near duplicates.
SHINGLE = 5
SIMILARITY = 80


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns c0, c1, ... and what each was called: no name can clash with an operator's."""
    names = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Back to the documents' own columns."""
    return rows.select(*[F.col(number).alias(name) for name, number in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts and texts without a letter go.

    Repeated rows and rows of one id stay or go each by its own text; all columns stay as they are.
    """
    model = language.fit(docs, fold(F.col("doc_id"), 5) != 0)
    rows, names = _numbered(docs)
    return _named(language.predict(rows, model, names["text"]).filter(language.accepted()), names)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id; rows repeating an id and text count once.

    A null text counts as empty, a null id comes after all others. All columns stay as they are.
    """
    space = workspace(spark)
    found = space.save(exact_dedup.duplicates(space, docs), "decisions")
    rows, names = _numbered(docs)
    sha = F.sha2(exact_dedup.normalised(text_of(names["text"])), 256)
    kept = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "rows")
    same = F.col(names["doc_id"]).eqNullSafe(F.col("_id")) & (sha == F.col("_sha"))
    repeated = kept.filter("rows > 1")
    if repeated.isEmpty():
        return _named(rows.join(kept, same, "left_semi"), names)
    single = rows.join(kept.filter("rows = 1"), same, "left_semi")
    several = rows.join(repeated, same, "left_semi").withColumn("_sha", sha).dropDuplicates([names["doc_id"], "_sha"])
    return _named(single.unionByName(several.drop("_sha")), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Different texts under one id are documents of their own: each stays or goes by itself, and of
    near copies under one id the first text in byte order stays. Documents with a null id or without
    words stay. All columns stay as they are.
    """
    space = workspace(spark)
    rows, names = _numbered(docs)
    key, text = names["doc_id"], names["text"]
    if rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").isEmpty():
        rows = rows.withColumn("_row", F.col(key).cast("long"))
    else:  # numbers that follow the ids, one for each row
        ordered = rows.orderBy(F.col(key).cast("long"), text)
        number = F.when(F.col(key).isNotNull(), F.monotonically_increasing_id())
        rows = space.save(ordered.withColumn("_row", number), "numbered")
    found = near_dedup.near_duplicates(space, rows, "_row", text, shingle=SHINGLE, similarity=SIMILARITY)
    return _named(rows.join(found.filter(~F.col("kept")).select("_row"), "_row", "left_anti"), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture holds them.

    A null source is a source of its own; documents without words go. All columns stay as they are.
    """
    rows, names = _numbered(docs)
    mixed = mixing.mix(workspace(spark), rows, names["doc_id"], names["source"], names["text"]).filter("copies > 0")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return _named(mixed.withColumn("_copy", each), names)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they decode to."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer(), decoded="decoded")
    return encoded.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: SQL can't express language ID and encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
