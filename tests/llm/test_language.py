"""Language ID: the backoff against a direct computation, held-out accuracy, awkward rows."""

import numpy as np
import pytest
from adlytics.llm import language
from adlytics.llm.common import fold
from corpus_cases import awkward, clashing, documents, rows
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return language.fit(docs, fold(F.col("doc_id"), 5) != 0)


def tables(model):
    return [dict(zip(items, logs)) for items, logs in zip(model.items, model.logs)]


def brute(model, text):
    known_items = tables(model)
    words = [language.letters(w) for w in (text or "").encode().split() for w in [w.decode()]]
    words = [w for w in words if w]
    if not words:
        return "und", 0.0
    total = model.shares.copy()
    for w in words:
        if w in known_items[0]:
            total = total + known_items[0][w]
            continue
        for n in range(language.LONGEST, 0, -1):
            held = w if n == 1 else "\x02" + w + "\x02"
            known = [known_items[n][g] for g in (held[i : i + n] for i in range(len(held) - n + 1)) if g in known_items[n]]
            if known:
                total = total + np.mean(known, axis=0)
                break
    odds = np.exp(total - total.max())
    odds /= odds.sum()
    return model.languages[int(odds.argmax())], float(odds.max())


def test_awkward_rows(spark, model):
    found = awkward() + rows((30, "Der ging nicht"), (31, "zzzqqq"), (32, "the"), (33, "été"))
    docs = clashing(documents(spark, found), "score", "lang_pred", "key", "n")
    out = language.predict(docs, model)
    assert sorted(out.columns) == sorted(docs.columns)
    for row in out.collect():
        pred, score = brute(model, row["text"])
        assert row["lang_pred"] == pred
        assert row["score"] == pytest.approx(score, abs=1e-9)
        assert 0 <= row["score"] <= 1


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(fold(F.col("doc_id"), 5) == 0)
    right = language.predict(docs, model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99
    assert language.predict(docs, model).filter(~language.accepted()).count() == 0


def test_fold_is_crc32_of_the_id_as_text(spark):
    import zlib

    found = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in found)


def test_labels_are_no_inputs(spark, model):
    docs = documents(spark, rows(*[(i, "la casa de", lang, source) for i, (lang, source) in enumerate([("en", "a"), (None, None), ("fr", "b")])]))
    assert len({(r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}) == 1


def test_nothing_learned(spark):
    empty = language.fit(documents(spark, rows((1, "text", None))), F.lit(True))
    assert [r["lang_pred"] for r in language.predict(documents(spark, rows((1, "text"))), empty).collect()] == ["und"]
    assert language.predict(documents(spark, []), empty).count() == 0


def test_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, other = (language.fit(d, F.lit(True), most_docs=30) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one.languages == other.languages
    assert all(a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a) for a, b in zip(tables(one), tables(other)))


def test_shares_are_those_of_all_training_rows(spark):
    found = rows(*[(i, f"word{i % 9} again", "en" if i % 10 < 7 else "fr") for i in range(600)])
    model = language.fit(documents(spark, found), F.lit(True), most_docs=50)
    assert model.languages == ["en", "fr"]
    assert np.exp(model.shares) == pytest.approx([0.7, 0.3])


def test_a_rare_language_keeps_its_own_items(spark):
    common = [(i, " ".join(f"{a}{b}" for a in "abcdef" for b in "ghijk"), "en") for i in range(300)]
    found = rows(*common, *[(1_000 + i, "xyz wvu", "fr") for i in range(4)], (2_000, "qqq", "fr"))
    model = language.fit(documents(spark, found), F.lit(True), most_docs=400, most_items=20)
    assert {"xyz", "wvu", "qqq"} <= set(model.items[0])
    assert len(model.items[0]) == 23
