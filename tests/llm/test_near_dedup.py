"""Near duplicates against all pairs and a union of links."""

import random

import numpy as np
import pyarrow as pa
import pytest
from adlytics.llm import near_dedup
from adlytics.llm.common import Words
from adlytics.workspace import Workspace
from corpus_cases import awkward, clashing, documents, rows, sentence


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(found, k, similarity=80):
    known = {(i, t): shingles(t, k) for i, t, *_ in found}
    nodes = [n for n in known if n[0] is not None]
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for x, a in enumerate(nodes):
        for b in nodes[:x]:
            s, t = known[a], known[b]
            if s and t and 100 * len(s & t) >= similarity * len(s | t):
                parent[root(a)] = root(b)
    least = {}
    for n in nodes:
        least[root(n)] = min(least.get(root(n), n[0]), n[0])
    out = []
    for i, t, *_ in found:
        component = None if i is None else least[root((i, t))]
        out.append((i, len(known[i, t]), component, component is None or component == i))
    return sorted(out, key=repr)


def result(space, docs, k):
    return sorted((tuple(r) for r in near_dedup.near_duplicates(space, docs, shingle=k).collect()), key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_awkward_rows(spark, k):
    docs = clashing(documents(spark, awkward()), "id", "digest", "signature", "component", "bucket")
    with Workspace(spark) as space:
        assert result(space, docs, k) == brute(awkward(), k)


def edited(text, share, seed):
    chosen = random.Random(seed)
    return " ".join(w if chosen.random() > share else f"new{chosen.randrange(10**6)}" for w in text.split())


def test_chains_and_a_crowd_of_near_copies(spark):
    """Similarities on both sides of the limit; few pivots, so that several rounds are needed."""
    found, n = [], 0
    for base in range(6):
        text = sentence(base, 80)
        for step in range(12):
            found.append((n, text))
            n += 1
            text = edited(text, 0.04, n)
    crowd = sentence(99, 120)
    for i in range(60):
        found.append((1000 + i, edited(crowd, random.Random(i).choice([0.01, 0.03, 0.05, 0.07]), i)))
    found = rows(*found)
    with Workspace(spark) as space:
        docs = documents(spark, found)
        original, near_dedup.PIVOTS = near_dedup.PIVOTS, 1
        try:
            assert result(space, docs, 2) == brute(found, 2)
        finally:
            near_dedup.PIVOTS = original


def test_isolated_pairs_above_the_limit(spark):
    """Each pair stands alone, so no other link makes up for one that is left out."""
    found, wanted, k = [], {}, 2
    for pair in range(3_000):
        words = sentence(pair, 60).split()
        words = [f"{w}_{pair}" for w in words]
        other = [f"{w}x" if i in (5, 12, 40)[: 1 + pair % 3] else w for i, w in enumerate(words)]
        a, b = shingles(" ".join(words), k), shingles(" ".join(other), k)
        found += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
        wanted[2 * pair] = 2 * pair
        wanted[2 * pair + 1] = 2 * pair if 100 * len(a & b) >= 80 * len(a | b) else 2 * pair + 1
    with Workspace(spark) as space:
        rows_ = near_dedup.near_duplicates(space, documents(spark, rows(*found)), shingle=k).collect()
    assert [r["doc_id"] for r in rows_ if r["component_id"] != wanted[r["doc_id"]]] == []


def test_short_texts(spark):
    found = rows(*[(i, t) for i, t in enumerate(["a", "A", "a b", "a b c", "b a", "a  b", "c", "a b a b", "b a b"] * 2)])
    with Workspace(spark) as space:
        assert result(space, documents(spark, found), 2) == brute(found, 2)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    with Workspace(spark) as space:
        found = {r["id"]: r["component"] for r in near_dedup.components(space, links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("k", [1, 2, 5, 9])
def test_fewer_words_than_a_shingle(k):
    texts = ["a b", "", "c", "a b c d e f"]
    for batch in (texts[:1], texts[1:2], texts[:3], texts):
        sets = near_dedup.shingle_sets(Words(pa.array(batch)), k)
        assert [len(s) for s in sets] == [len(shingles(t, k)) for t in batch]


def test_empty_table(spark):
    with Workspace(spark) as space:
        assert result(space, documents(spark, []), 5) == []


def test_minima_estimate_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(11400714819323198485)
    b = a[200:]
    found = near_dedup.minima([a, b], 512)
    assert abs((found[0] == found[1]).mean() - 0.8) < 0.07


def test_few_texts_are_hashed_together():
    """What a worker holds beside a batch follows the piece, not the batch."""
    texts = [f"{i} " + "some words " * 1_000 for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], names=["id", "text"])
    found = list(near_dedup._profiles(2, 4, 32)(iter([batch])))
    assert max(b.num_rows for b in found) * len(texts[0]) <= 2 << 20
    whole = pa.Table.from_batches(found)
    assert whole.column("id").to_pylist() == list(range(400)) and set(whole.column("n_shingles").to_pylist()) == {3}
