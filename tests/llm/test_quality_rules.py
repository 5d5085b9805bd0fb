"""Counts and verdicts of the quality rules against Python."""

import re
from collections import Counter

import pytest
from adlytics.llm import quality_rules
from corpus_cases import awkward, clashing, documents, rows, sentence
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n, r = len(words), len(marked)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def flat():
    return ",".join(["0.0"] * quality_rules.BUCKETS)


def test_awkward_rows(spark):
    more = ["a b c a b c a", "x x x x x", "a b c\na b c\n\n \na b c", "#*$ %&| <>", "a b", "one\n one\none", sentence(3, 60) + " " + sentence(3, 60)]
    found = awkward() + rows(*[(50 + i, t) for i, t in enumerate(more)], (90, sentence(4, 40) + "\n" + sentence(4, 30) + "🙂"))
    docs = clashing(documents(spark, found), "_text", "_hashes", "row", "n_words", "kept", "_sum", "bucket")
    out = quality_rules.judge(docs, flat(), -1.0)
    assert {"_text", "_hashes", "row", "_sum"} <= set(out.columns)
    for row in out.collect():
        assert tuple(row[c] for c in COUNTS) == brute(row["text"])
        assert row["kept"] == (not row["base_failed"])
        assert row["log_ratio"] == 0.0


def test_whole_table(spark):
    out = quality_rules.judge(spark.read.parquet(f"{FOLDER}/documents.parquet"), flat(), -1.0)
    assert all(tuple(row[c] for c in COUNTS) == brute(row["text"]) for row in out.collect())


def test_log_ratio(spark):
    """The mean over words and pairs of the log ratio of smoothed shares, with Spark's own hash."""
    import math

    found = rows(*[(i, sentence(i % 7, 20) + (" junk*** more***" if i % 2 else "")) for i in range(30)])
    docs = documents(spark, found)
    trusted = spark.createDataFrame([(i,) for i in range(0, 30, 2)], "doc_id long")
    out = {r["doc_id"]: r["log_ratio"] for r in quality_rules.judge(docs, quality_rules.log_ratios(docs, trusted), -1.0).collect()}
    hashed = {
        r["doc_id"]: r["b"]
        for r in docs.select(
            "doc_id",
            F.expr(f"""transform(split(text, ' '), w -> xxhash64(w))""").alias("h"),
        )
        .select("doc_id", F.expr(f"transform(concat(h, transform(sequence(0, size(h) - 2), i -> xxhash64(h[i], h[i + 1]))), x -> pmod(x, {quality_rules.BUCKETS}))").alias("b"))
        .collect()
    }
    raw, own = Counter(), Counter()
    for i, b in hashed.items():
        raw.update(b)
        own.update(b if i % 2 == 0 else ())
    n, m = sum(raw.values()) + quality_rules.BUCKETS, sum(own.values()) + quality_rules.BUCKETS
    for i, b in hashed.items():
        ratio = sum(math.log((own[x] + 1) / m * n / (raw[x] + 1)) for x in b) / len(b)
        assert out[i] == pytest.approx(ratio, rel=1e-9)


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    fitted = quality_rules.fit(docs, quality_rules.trusted_ids(labels.filter("doc_id % 2 = 0")))
    other = quality_rules.judge(docs, *fitted).filter("not base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id")
    kept = {r["quality"]: r["share"] for r in other.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.98
    assert kept[0] < 0.6  # few documents are counted here; with more the share falls


def test_empty_tables(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(docs, *quality_rules.fit(docs, quality_rules.trusted_ids(labels))).count() == 0


def test_all_trusted_documents_count(spark):
    """More trusted ids than a bounded sample would hold: every one is trusted, and both halves are used whole."""
    many = 120_000
    labels = spark.range(many).selectExpr("id AS doc_id", "1 AS quality")
    trusted = quality_rules.trusted_ids(labels.union(labels.filter("doc_id < 10").selectExpr("doc_id", "0")))
    assert trusted.count() == many - 10
    # Each text has a word of its own kind, so the counts of its bucket say how many documents were counted.
    docs = spark.range(many).selectExpr("id AS doc_id", "if(xxhash64(id, 11) % 2 = 0, 'even', 'odd') AS text")
    halves = {r["text"]: r["count"] for r in docs.filter("doc_id >= 10").groupBy("text").count().collect()}
    whole = {r["text"]: r["count"] for r in docs.groupBy("text").count().collect()}
    ratios = [float(x) for x in quality_rules.fit(docs, trusted)[0].split(",")]
    at = {w: r[0] for w in ("even", "odd") for r in [spark.sql(f"SELECT pmod(xxhash64('{w}'), {quality_rules.BUCKETS})").first()]}
    counted, size = halves["even"] + quality_rules.BUCKETS, many + quality_rules.BUCKETS
    import math

    assert ratios[at["even"]] == pytest.approx(math.log((halves["even"] + 1) / counted * size / (whole["even"] + 1)), rel=1e-9)
    assert ratios[at["odd"]] == pytest.approx(math.log(1 / counted * size / (whole["odd"] + 1)), rel=1e-9)
