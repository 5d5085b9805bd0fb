"""Deleted interpolation against plain counting."""

import math
from collections import Counter

import numpy as np
import pytest
from adlytics.llm import language_model as lm
from adlytics.workspace import Workspace
from corpus_cases import awkward, clashing, documents, rows, sentence
from pyspark.sql import functions as F

END = "\x00end"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [END]


def brute(found, held, tune):
    def count(texts):
        words, pairs = Counter(), Counter()
        for t in texts:
            ts = tokens(t)
            words.update(ts)
            pairs.update(zip([None, *ts], ts))
        return words, pairs, len(texts)

    def shares(counts, before, w):
        words, pairs, texts = counts
        context = texts if before is None else words[before]
        return context, pairs[before, w] / max(1, context), words[w] / max(1, sum(words.values()))

    train = [t for i, t, *_ in found if not held(i)]
    final, less = count(train), count([t for i, t, *_ in found if not held(i) and not tune(i)])
    n, known = sum(final[0].values()), len(final[0])
    bucket = lambda c: 0 if not c else min(lm.BUCKETS - 1, int(math.log2(c)) + 1)
    cells = {}
    for i, t, *_ in found:
        if tune(i) and not held(i):
            ts = tokens(t)
            for before, w in zip([None, *ts], ts):
                c, p2, p1 = shares(less, before, w)
                step = lambda p: math.floor(lm.STEPS * math.log2(p)) if p > 0 else lm.NEVER
                cell = cells.setdefault((bucket(c), step(p2), step(p1)), [0, 0.0, 0.0])
                for k, v in enumerate((1, p2, p1)):
                    cell[k] += v
    weights = {}
    for b in [*range(lm.BUCKETS), None]:
        w, mine = np.full(3, 1 / 3), [(c, v) for c, v in cells.items() if b is None or c[0] == b]
        for _ in range(lm.EM_ROUNDS if mine else 0):
            new = np.zeros(3)
            for _, (m, s2, s1) in mine:
                joint = w * [s2 / m, s1 / m, 1 / (known + 1)]
                new += m * joint / joint.sum()
            w = new / new.sum()
        w = np.maximum(w, 1e-6)
        weights[b] = w / w.sum() if mine or b is None else None
    out = []
    for i, t, *_ in found:
        ts = tokens(t)
        score = base = 0.0
        for before, w in zip([None, *ts], ts):
            c, p2, p1 = shares(final, before, w)
            own = weights[bucket(c)] if weights[bucket(c)] is not None else weights[None]
            score += math.log10(own @ [p2, p1, 1 / (known + 1)])
            base += math.log10((final[0][w] + 1) / (n + known + 1))
        out.append((i, held(i), len(ts), sum(final[0][w] > 0 for w in ts), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def result(space, docs, held, tune):
    found = lm.score_documents(space, docs, held, tune).collect()
    return sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in found), key=repr)


def test_awkward_rows(spark):
    found = awkward()
    docs = clashing(documents(spark, found), "tune", "held_out", "batch", "words")
    got_args = F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False)), F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))
    with Workspace(spark) as space:
        got = result(space, docs, *got_args)
    assert got == brute(found, lambda i: i is not None and i % 4 == 2, lambda i: i is not None and i % 4 == 1)


@pytest.mark.parametrize("batch, shard", [(12 << 20, 3 << 20), (4000, 500)])
def test_many_batches_and_shards(spark, monkeypatch, batch, shard):
    monkeypatch.setattr(lm, "BATCH_BYTES", batch)
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    found = rows(*[(i, sentence(i % 90, 5 + i % 60)) for i in range(300)])
    with Workspace(spark) as space:
        got = result(space, documents(spark, found), F.col("doc_id") % 7 == 2, F.col("doc_id") % 7 == 3)
    assert got == brute(found, lambda i: i % 7 == 2, lambda i: i % 7 == 3)


@pytest.mark.parametrize("held, tune", [(True, False), (False, False), (False, True)])
def test_parts_without_rows(spark, held, tune):
    found = rows((1, "a b a"), (2, ""))
    with Workspace(spark) as space:
        assert result(space, documents(spark, found), F.lit(held), F.lit(tune)) == brute(found, lambda _: held, lambda _: tune)
        assert result(space, documents(spark, []), F.lit(held), F.lit(tune)) == []


def test_hashes_survive_packing():
    hashes = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    found, counts = lm._unpacked(lm._packed(hashes, np.arange(len(hashes))))
    assert (found == hashes).all() and (counts == np.arange(len(hashes))).all()
