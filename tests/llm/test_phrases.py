"""Collocations against plain counting, and the trie against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from adlytics.llm import oracles, phrases, queries
from adlytics.llm.hat_trie import HatTrie
from adlytics.workspace import Workspace
from checks import compare
from llm.corpus_cases import awkward, clashing, documents

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least=30, top=2_000, covered=80):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    frequent = {k: f for k, f in counts.items() if f >= least}
    candidates = {k: f for k, f in frequent.items() if len(k[1]) > 1}
    covering = Counter()
    for (lang, words), f in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = lang, words[i : i + size]
                covering[key] = max(covering[key], f)
    scored = {}
    for (lang, words), a in candidates.items():
        if covering[lang, words] and 100 * covering[lang, words] >= covered * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = frequent[lang, words[:k]], frequent[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        scored.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, found in scored.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


def result(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_whole_query_against_plain_counting(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text").collect()]
    found = queries.op13_collocations(spark, folder)
    assert compare._bag(found.columns, [tuple(r) for r in found.collect()]) == compare._bag(
        *(lambda a: ([d[0] for d in a.description], a.fetchall()))(compare.connect(folder).execute(oracles.all_sql()["op13_collocations"]))
    )
    assert result(found) == plain(rows)


def test_awkward_documents_that_spill(spark, monkeypatch):
    chosen = random.Random(3)
    made = [
        (100 + i, ". ".join(" ".join(chosen.choice("aBÉ  c\td") for _ in range(40)) for _ in range(8)), chosen.choice(["en", "fr", None, ""]), "s", 0)
        for i in range(60)
    ]
    rows = awkward() + made + [(1, "x x x x x x\x00 x x\x0bx ,x", "und", None, None)] * 3
    monkeypatch.setattr(phrases, "PARTITION_BYTES", 10_000)
    docs = clashing(documents(spark, rows), "words", "f", "phrase", "bucket", "n")
    with Workspace(spark) as space:
        found = result(phrases.collocations(space, docs, least=4, top=30, covered=60))
        assert found == plain([(r[2], r[1]) for r in rows], 4, 30, 60) and len(found) > 60
        assert result(phrases.collocations(space, documents(spark, []))) == []


@pytest.mark.parametrize("limits", [(50, 10_000), (5, 40), (10_000, 10_000)])
def test_task_and_merge(limits, monkeypatch):
    """Runs of several tasks that spill often, merged in any order."""
    import pyarrow as pa

    chosen = random.Random(5)
    monkeypatch.setattr(phrases, "MOST_PATHS", limits[0])
    monkeypatch.setattr(phrases, "MOST_WORDS", limits[1])
    monkeypatch.setattr(phrases, "_PIECE", 100)
    texts = [" ".join(chosen.choice(["the", "of", "a", "b", f"w{chosen.randrange(50)}"]) for _ in range(30)) for _ in range(40)]
    rows = []
    for part in (texts[:15], texts[15:]):
        batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(part)), pa.array(part)], names=["lang", "text"])
        for run in phrases._counted(3)(iter([batch])):
            rows += run.to_pylist()
    chosen.shuffle(rows)
    found = {}
    for bucket in {r["bucket"] for r in rows}:
        held = phrases._Merge("en", 2)
        for row in rows:
            if row["bucket"] == bucket:
                held.add(row)
        for words, n in held.phrases():
            found[tuple(words)] = found.get(tuple(words), 0) + n
    counts = Counter()
    for text in texts:
        words = text.split()
        counts[()] += len(words)
        for size in range(1, 5):
            for i in range(len(words) - size + 1):
                counts[tuple(words[i : i + size])] += 1
    assert found == {w: n for w, n in counts.items() if n >= 2}


def test_trie_against_a_dictionary():
    chosen = np.random.default_rng(1)
    trie, expected, taken = HatTrie(burst=64), Counter(), Counter()
    for _ in range(30):
        head = chosen.integers(1, 6, 400).astype(np.uint64) << np.uint64(32) | chosen.integers(1, 30, 400).astype(np.uint64)
        tail = chosen.integers(0, 9, 400).astype(np.uint64)
        expected.update(zip(head.tolist(), tail.tolist()))
        trie.add(head, tail)
        assert trie.size <= len(expected)
        if chosen.random() < 0.2:
            for h, t, n in zip(*(x.tolist() for x in trie.spill(0.5))):
                taken[h, t] += n
    assert len(trie.leaves) > 10
    for h, t, n in zip(*(x.tolist() for x in trie.spill())):
        taken[h, t] += n
    assert taken == expected and trie.size == 0
