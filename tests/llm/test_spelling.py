"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from adlytics.llm import queries, spelling
from adlytics.workspace import Workspace
from llm.corpus_cases import awkward, clashing, documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_counts(rows, every=199, least=5, length=6):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and crc % every == 0:
                at = crc % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def one_apart(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def plain_variants(counts, ratio=5):
    """Every edit of every word is looked up."""
    letters = sorted({c for w in counts for c in w})
    found = {}
    for word in counts:
        if len(word) > 500:
            found[word] = sorted(w for w in counts if one_apart(w, word))
            continue
        near = {word[:i] + word[i + 1 :] for i in range(len(word))}
        near |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
        near |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
        found[word] = sorted(w for w in near if w in counts and w != word)
    form = {}
    for word, near in found.items():
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= ratio * counts[word] else None

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return sorted(
        (w, form[w], root(w), n, len(found[w]), counts[form[w]] if form[w] is not None else None) for w, n in counts.items()
    )


def result(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


def test_whole_query_against_all_edits(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain_variants(plain_counts(rows))
    assert sum(r[1] is not None for r in expected) >= 10
    assert result(queries.op12_spelling(spark, folder)) == expected


def words(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


HARD = {
    **{"aab": 5, "aaab": 30, "ab": 200, "b": 5, "abb": 7, "aabb": 9},  # runs of equal letters
    **{"steeple": 2, "steple": 10, "stepple": 10, "steepled": 60, "staple": 10},  # ties, chains
    **{"x" * 3_000: 5, "x" * 2_999: 30, "x" * 3_001: 200, "y" + "x" * 2_999: 5, "x" * 1_500 + "y" + "x" * 1_499: 9},
    **{"éàüÿ": 5, "éàü": 25, "éàuÿ": 25, "×÷×÷×÷×÷×": 6, "×÷×÷×÷×÷÷": 40},
    **{"abcdefghijklmnopqrst": 5, "abcdefghijklmnopqrs": 50, "zabcdefghijklmnopqrst": 50, "abcdefghijXlmnopqrst": 50},
    "solo": 9,
}


def test_hard_and_random_words(spark):
    chosen = random.Random(7)
    made = {"".join(chosen.choice("abé") for _ in range(chosen.randrange(1, 14))): chosen.randrange(1, 400) for _ in range(1_500)}
    with Workspace(spark) as space:
        assert result(spelling.variants(space, words(spark, made | HARD))) == plain_variants(made | HARD)


def test_awkward_documents(spark):
    found = awkward() + [(20, "stoneware " * 40 + "Stonewares " * 7 + "STONEWÀRE " * 6, None, None, 0)]
    docs = clashing(documents(spark, found), "word", "n", "run", "id", "form")
    every = plain_counts([(r[0], r[1]) for r in found], every=3, least=1)
    counted = spelling.word_counts(docs, min_count=1, slip_every=3)
    assert {r.word: r.n for r in counted.collect()} == every
    with Workspace(spark) as space:
        assert result(spelling.variants(space, counted)) == plain_variants(every)


def test_no_documents(spark):
    docs = documents(spark, [])
    with Workspace(spark) as space:
        assert result(spelling.variants(space, spelling.word_counts(docs))) == []


def test_root_nodes_are_not_joined(spark):
    """Nodes near the root, which many words share, have numbers of their own making."""
    rows = words(spark, {"abcdefg" + "h" * k: 5 for k in range(1, 30)}).withColumn("id", F.monotonically_increasing_id())
    cuts = rows.mapInArrow(spelling._cuts, spelling._CUTS)
    shallow = cuts.filter("head2 is null").select("head").distinct().count()
    assert shallow == 8 and cuts.filter("head2 is not null and head < 0").count() > 0


def test_one_side_is_numbered_before_the_other_and_lists_are_made_behind_the_shuffle(spark, tmp_path):
    saved = []

    class Named(Workspace):
        def save(self, table, name):
            saved.append(name)
            return super().save(table, name)

    space = Named(spark, str(tmp_path))
    words = spark.createDataFrame([(0, "something", 9), (1, "somethings", 1), (2, "somethinge", 1)], "id long, word string, n long")
    near = spelling.near_words(space, words)
    assert saved == ["cuts", "head-nodes", "headed-cuts", "tail-nodes"]
    lines = near._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "partial_collect_list" in line)
    assert "Exchange hashpartitioning(head" in lines[at + 1]
    assert {r["id"]: r["n_near"] for r in near.collect()} == {0: 2, 1: 2, 2: 2}
