"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlytics.llm import jaccard_join, oracles, queries
from adlytics.workspace import Workspace
from checks import compare
from llm.corpus_cases import awkward, clashing, documents, rows, sentence

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if 0 < len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[i:] for i in range(k))))


def plain(docs, k, similarity):
    """Rows (id, n_shingles, component_id) by comparing all pairs."""
    nodes = sorted({(i, shingles(t, k)) for i, t in docs if i is not None}, key=lambda n: n[0])
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(nodes):
        for y in range(x):
            b = nodes[y][1]
            both = len(a & b)
            if a and b and 100 * both >= similarity * (len(a) + len(b) - both):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(nodes):
        least[root(x)] = min(least.get(root(x), i), i)
    of = {node: least[root(x)] for x, node in enumerate(nodes)}
    found = [(i, len(shingles(t, k)), None if i is None else of[i, shingles(t, k)]) for i, t in docs]
    return sorted(found, key=repr)


def result(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_whole_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain(docs, 3, 90)
    assert sum(r[0] != r[2] for r in expected) > 5
    found = queries.op11_jaccard_join(spark, folder)
    assert result(found) == expected
    answer = compare.connect(folder).execute(oracles.all_sql()["op11_jaccard_join"])
    assert [d[0] for d in answer.description] == found.columns and sorted(answer.fetchall(), key=repr) == expected


def changed(text, seed, words):
    """The text with so many words replaced."""
    chosen, found = random.Random(seed), text.split()
    for at in chosen.sample(range(len(found)), words):
        found[at] = f"new{seed}"
    return " ".join(found)


def near_copies():
    """Groups around several similarities, one of them large, a passage in most texts, and chains."""
    found, passage = [], sentence(900, 60)
    for group in range(12):
        base = sentence(group, 150 + 10 * group)
        found += [(1_000 * group + i, changed(base, 50 * group + i, i % 9)) for i in range(8)]
    large = sentence(500, 100)
    found += [(20_000 + i, changed(large, 7_000 + i, i % 5)) for i in range(120)]
    found += [(30_000 + i, passage + " " + sentence(2_000 + i, 3 + i % 40)) for i in range(150)]
    chain = sentence(600, 200).split()
    found += [(40_000 - i, " ".join(chain[: 200 - 4 * i])) for i in range(20)]
    return found


@pytest.mark.parametrize(("k", "similarity"), [(3, 90), (1, 70)])
def test_near_copies_with_few_pivots(spark, monkeypatch, k, similarity):
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    docs = near_copies()
    with Workspace(spark) as space:
        frame = documents(spark, rows(*docs))
        assert result(jaccard_join.similar_documents(space, frame, shingle=k, similarity=similarity)) == plain(docs, k, similarity)


def test_awkward_documents(spark):
    more = [(8, sentence(1, 30_000) + " end", None, None, 0), (-5, "Same WORDS again", None, None, 0), (50, "two words", None, None, 0), (51, "Two\twords", None, None, 0)]
    found = awkward() + more
    docs = clashing(documents(spark, found), "id", "class", "n", "digest", "component", "n_shingles")
    with Workspace(spark) as space:
        assert result(jaccard_join.similar_documents(space, docs, shingle=3, similarity=90)) == plain([(r[0], r[1]) for r in found], 3, 90)
        assert result(jaccard_join.similar_documents(space, documents(spark, []))) == []


def test_a_passage_that_many_share_makes_few_pairs(spark, monkeypatch):
    """Texts that share most of their words but don't link: parities leave out their pairs before they are made."""
    base = sentence(800, 120).split()
    docs = []
    for i in range(120):  # two texts of each kind link; two kinds differ in six words, and so in 36 of some 220 shingles
        text = list(base)
        for at in random.Random(i).sample(range(5, 115, 5), 3):
            text[at] = f"other{i}"
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text, "end"]))]
    made, save = [], Workspace.save

    def counted(self, table, name):
        saved = save(self, table, name)
        if name == "pairs":
            made.append(saved.count())
        return saved

    monkeypatch.setattr(Workspace, "save", counted)
    with Workspace(spark) as space:
        found = result(jaccard_join.similar_documents(space, documents(spark, rows(*docs)), shingle=3, similarity=90))
    assert found == plain(docs, 3, 90) and len({r[2] for r in found}) == 120
    assert sum(made) < 2 * len(docs)


def test_parities_bound_the_overlap(spark):
    chosen = random.Random(5)
    for n, own in [(5, 3), (100, 4), (100, 30), (2_000, 90)]:
        both = np.array([chosen.getrandbits(64) for _ in range(n)], np.uint64)
        a, b = (np.concatenate([both, np.array([chosen.getrandbits(64) for _ in range(k)], np.uint64)]) for k in (own, own + 2))
        row = [[jaccard_join._parity(x).tolist(), len(x)] for x in (a, b)]
        frame = spark.createDataFrame([(row[0][0], row[0][1], row[1][0], row[1][1])], "p array<long>, n long, q array<long>, m long")
        most = frame.select(jaccard_join._overlap_by_parity(F.col("n"), F.col("m"), "p", "q")).first()[0]
        assert n <= most and (n > 1_000 or most < n + 0.3 * own + 1)
