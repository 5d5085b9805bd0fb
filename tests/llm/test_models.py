"""Quality and toxicity models: their parts against direct computation, and held-out labels."""

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from adlytics.llm import quality_model, queries, toxicity
from corpus_cases import awkward, clashing, documents, rows
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


def test_discriminant_is_the_posterior_of_two_normals():
    random = np.random.default_rng(1)
    d = 3
    parts = []
    for mean, spread in ((0.0, 1.0), (2.0, 0.5)):
        a = random.normal(size=(d, d)) * spread
        parts.append((np.full(d, mean), a @ a.T + np.eye(d)))
    inverse = [np.linalg.inv(np.linalg.cholesky(c)) for _, c in parts]
    model = quality_model.Discriminant(
        [math.log(0.3), math.log(0.7)], [m for m, _ in parts], inverse, [float(np.log(np.diag(i)).sum()) for i in inverse]
    )
    x = random.normal(size=(20, d))

    def density(v, mean, cov):
        away = v - mean
        return math.exp(-0.5 * away @ np.linalg.solve(cov, away)) / math.sqrt(np.linalg.det(cov))

    for v, s in zip(x, model.score(x)):
        p0, p1 = 0.3 * density(v, *parts[0]), 0.7 * density(v, *parts[1])
        assert s == pytest.approx(p1 / (p0 + p1), rel=1e-6)


def test_statistics_of_awkward_texts():
    texts = [t for _, t, *_ in awkward()]
    whole = quality_model.statistics(pa.array(texts))
    assert np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(quality_model.statistics(pa.array([t], pa.string())), whole[i])
    assert not whole[2:4].any()


def test_quality_rows(spark):
    docs = clashing(documents(spark, awkward()), "stats", "score", "predicted", "label")
    stats = quality_model.add_statistics(docs)
    labelled = stats.withColumn("label", (F.col("doc_id") % 2).cast("int"))
    out = quality_model.score(stats, quality_model.fit(labelled)).collect()
    assert len(out) == len(awkward())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


@pytest.mark.parametrize("labels", [[], [1], [0]])
def test_quality_of_one_or_no_class(spark, labels):
    stats = quality_model.add_statistics(documents(spark, rows((1, "a b c"), (2, "d e"))))
    train = stats.crossJoin(spark.createDataFrame([(x,) for x in labels], "label int"))
    assert quality_model.score(stats, quality_model.fit(train)).count() == 2
    assert quality_model.score(stats.limit(0), quality_model.fit(train)).count() == 0


def held_out(spark, query, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    return query(spark, FOLDER).filter("held_out").join(labels, "doc_id").select("predicted", label).collect()


def test_quality_held_out(spark):
    found = held_out(spark, queries.op1_quality, "quality")
    assert sum(p == q for p, q in found) / len(found) > 0.95


def test_kernel_counts_weighted_subsequences():
    def features(word):
        out = {}
        for places in combinations(range(len(word)), toxicity.LENGTH):
            span = places[-1] - places[0] + 1
            if span <= toxicity.SPAN:
                key = tuple(toxicity.symbols("".join(word[i] for i in places)))
                out[key] = out.get(key, 0) + toxicity.DECAY**span
        return out

    words = ["idiot", "i-d-i-o-t", "idxiot", "stone", "banana", "ab", "été"]
    mine = toxicity.Landmarks(words).kernel(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            f, g = features(a), features(b)
            norm = math.sqrt(sum(v * v for v in f.values()) * sum(v * v for v in g.values()))
            assert mine[i, j] == pytest.approx(sum(v * g.get(k, 0) for k, v in f.items()) / norm if norm else 0, abs=1e-5)
    assert mine[0, 2] > 0.6 > mine[0, 3]


def training(spark):
    clean = ["walk along the river today", "the meadow was bright", "an idea of the state", "birds carry small letters"]
    insults = ["you idiot of the river", "what a moron today", "such scum was here", "a stupid meadow idiot", "pathetic loser moron scum"]
    texts = [(i, " ".join((clean[i % 4], clean[(i + 1) % 4]))) for i in range(60)] + [(100 + i, clean[i % 4] + ". " + insults[i % 5]) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in texts], "doc_id long, label int")
    return documents(spark, rows(*texts)), labels


def test_gapped_and_spelled_out_insults(spark):
    docs, labels = training(spark)
    model = toxicity.fit(docs, labels)
    bad = ["the id-iot here", "a mor*on walks", "s c u m", "i d i o t of it", "IDIOT!", "m.o.r.o.n", "stuupid birds", "x " * 5000 + "scum"]
    good = ["the river walks", "a small bright meadow", "carry the letters", "", None, "a b", "stop the motion"]
    out = toxicity.score(documents(spark, rows(*enumerate(bad + good))), model).collect()
    wrong = [(r["text"], r["score"]) for r in out if r["predicted"] != (r["doc_id"] < len(bad))]
    assert not wrong


def test_toxicity_rows(spark):
    docs, labels = training(spark)
    found = clashing(documents(spark, awkward()), "score", "predicted", "label", "unit")
    out = toxicity.score(found, toxicity.fit(docs, labels)).collect()
    assert len(out) == len(awkward())
    assert all(0 <= r["score"] <= 1 for r in out)
    nothing = toxicity.fit(docs, labels.filter("label = 0"))
    assert {r["predicted"] for r in toxicity.score(found, nothing).collect()} == {0}
    assert toxicity.score(documents(spark, []), nothing).count() == 0


def test_toxicity_held_out(spark):
    found = held_out(spark, queries.op9_toxicity, "toxic")
    clean = [p for p, t in found if not t]
    assert sum(clean) / len(clean) < 0.05
    assert sum(p == t for p, t in found) / len(found) > 0.85
