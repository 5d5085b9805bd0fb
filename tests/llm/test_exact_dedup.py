"""Block naming against a dictionary of whole texts."""

import hashlib
import re

import pytest
from adlytics.llm import exact_dedup
from adlytics.workspace import Workspace
from corpus_cases import awkward, clashing, documents, rows, sentence
from pyspark.sql import functions as F


def brute(found):
    texts = {(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in found}
    out = set()
    for i, t in texts:
        group = [j for j, u in texts if u == t]
        known = [j for j in group if j is not None]
        keep = min(known) if known else None
        out.add((i, keep, len(group), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return out


def result(space, docs):
    return {tuple(r) for r in exact_dedup.duplicates(space, docs).drop("rows").collect()}


def test_awkward_rows(spark):
    with Workspace(spark) as space:
        docs = clashing(documents(spark, awkward()), "doc", "name", "pos", "hash", "kept", "id")
        assert result(space, docs) == brute(awkward())


def test_lengths_around_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 4)
    texts = ["a" * n for n in range(18)] + ["abcdabcd", "abcdabce", "abcd", "abcdabcdabcd", "éàüß🙂🙂🙂🙂x"]
    found = rows(*[(i, t) for i, t in enumerate(texts * 2)])
    with Workspace(spark) as space:
        assert result(space, documents(spark, found)) == brute(found)


def test_blocks_that_share_a_hash_are_compared(spark, monkeypatch):
    """With one hash for all blocks, names come from the blocks alone."""
    monkeypatch.setattr(exact_dedup, "BLOCK", 8)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    found = rows(*[(i, sentence(i % 4, 12)) for i in range(12)])
    with Workspace(spark) as space:
        assert result(space, documents(spark, found)) == brute(found)


def test_one_large_group_and_repeated_rows(spark):
    copy = sentence(5, 900)
    found = rows(*[(i, copy) for i in range(400)], (3, copy), (900, copy + "."))
    with Workspace(spark) as space:
        assert result(space, documents(spark, found)) == brute(found)
        counted = exact_dedup.duplicates(space, documents(spark, found)).filter("doc_id = 3").first()
        assert counted["rows"] == 2


@pytest.mark.parametrize("found", [[], rows((None, None))])
def test_empty_tables_and_null_ids(spark, found):
    with Workspace(spark) as space:
        assert result(space, documents(spark, found)) == (brute(found) if found else set())
