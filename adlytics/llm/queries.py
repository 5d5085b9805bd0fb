"""Registered queries of the corpus operators, over the whole tables of a data folder."""

from __future__ import annotations

import atexit
from collections.abc import Callable
from contextlib import suppress

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics import configure
from adlytics.llm import bpe, exact_dedup, jaccard_join, language, language_model, mixing, near_dedup, phrases, quality_model, quality_rules, spelling, toxicity, warc
from adlytics.llm.common import fold
from adlytics.workspace import Workspace


def workspace(spark: SparkSession) -> Workspace:
    """Tables of one query; results read them, so they go when the driver ends."""
    space = Workspace(configure(spark))

    def close() -> None:
        with suppress(Exception):  # the session may have ended before
            space.close()

    atexit.register(close)
    return space


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def votes(labels: DataFrame, column: str) -> DataFrame:
    """One label per id; the larger one where an id has several."""
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    space = workspace(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    rows = space.save(quality_model.add_statistics(docs).drop("text"), "statistics")
    labelled = rows.filter(~held_out).join(votes(table(spark, folder, "labels"), "quality"), "doc_id")
    found = quality_model.score(rows, quality_model.fit(labelled))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_language_model(spark: SparkSession, folder: str) -> DataFrame:
    part = fold(F.col("doc_id"), 7)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return language_model.score_documents(workspace(spark), docs, held_out=part == 2, tune=part == 3)


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """A row per row of documents; rows that repeat an id and text count each."""
    found = exact_dedup.duplicates(workspace(spark), table(spark, folder, "documents"))
    more = found.filter("rows > 1").groupBy("text_sha256").agg(F.sum(F.col("rows") - 1).alias("more"))
    each = found.join(more, "text_sha256", "left").withColumn("group_size", F.col("group_size") + F.coalesce("more", F.lit(0)))
    each = each.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(*[c for c in found.columns if c != "rows"])


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(configure(spark), folder, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = language.fit(docs, ~held_out)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archive the pages and tell of every record what the archives say: responses by their payload."""
    space = workspace(spark)
    warc.register(spark)
    path = space.path("archives")
    warc.records(table(spark, folder, "pages"), space).write.format("warc").mode("append").save(path)
    responses = spark.read.format("warc").load(path).filter(F.col("record_type") == "response")
    revisits = spark.read.format("warc").option("payload", "false").load(path).filter(F.col("record_type") == "revisit")
    read = responses.select(
        warc.page_of("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.sha1_base32(F.col("payload")).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    return read.unionByName(
        revisits.select(
            warc.page_of("record_id").alias("page_id"),
            F.col("payload_length").alias("payload_bytes"),
            F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
            "record_type",
            warc.page_of("refers_to").alias("refers_to"),
        )
    )


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    space = workspace(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    trusted = quality_rules.trusted_ids(table(spark, folder, "labels"))
    ratios, threshold = quality_rules.fit(docs, trusted, space=space)
    return quality_rules.judge(docs, ratios, threshold).drop("text")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(workspace(spark), table(spark, folder, "documents"), keep=["doc_id"])
    return mixed.drop("copies")


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(workspace(spark), table(spark, folder, "documents"), shingle=2, similarity=80)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(configure(spark), folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    labels = votes(table(spark, folder, "labels"), "toxic").filter(~held_out)
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Content of a file of the public tokenizers, read by the driver and sent along with the tasks."""
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(configure(spark), folder, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizer())


def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(workspace(spark), table(spark, folder, "documents"), shingle=3, similarity=90)


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(configure(spark), folder, "documents").select("doc_id", "text")
    return spelling.variants(workspace(spark), spelling.word_counts(docs, slip_every=199))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(workspace(spark), table(spark, folder, "documents").select("lang", "text"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_quality, op2_language_model, op3_exact_dedup, op4_language_id, op5_warc, op6_quality_rules, op7_mixing, op8_near_dedup)
    return {f.__name__: f for f in (*first, op9_toxicity, op10_bpe, op11_jaccard_join, op12_spelling, op13_collocations)}
