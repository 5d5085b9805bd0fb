"""Mixing against a loop over sorted keys."""

import hashlib

import pytest
from adlytics.llm import mixing
from adlytics.workspace import Workspace
from corpus_cases import awkward, clashing, documents, rows, sentence


def budgets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over


def brute(found, seed=42):
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, _, s, _ in found:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = budgets(sizes)
    out = []
    for source in sizes:
        mine = [(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:15], i is None, i or 0, size(t)) for i, t, _, s, _ in found if s == source]
        front, whole = 0, sizes[source]
        epochs = int(target[source] // whole) if whole else 0
        rest = target[source] - epochs * whole
        for _, null, i, n in sorted(mine):
            copies = epochs + (n <= 2 * (rest - front)) if n else 0
            out.append((None if null else i, n, whole, round(target[source], 6), copies, copies * n))
            front += n
    return sorted(out, key=repr)


def result(space, docs):
    mixed = mixing.mix(space, docs, keep=["doc_id"])
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4], r[5]) for r in mixed.collect()), key=repr)


def test_awkward_rows(spark):
    docs = clashing(documents(spark, awkward()), "row", "_size", "_key", "size", "number", "most", "_id")
    with Workspace(spark) as space:
        assert result(space, docs) == brute(awkward())
        assert {"row", "_size", "number"} <= set(mixing.mix(space, docs).columns)


@pytest.mark.parametrize("range_rows, group", [(3, 2), (200, 1000)])
def test_hot_source_over_many_ranges(spark, monkeypatch, range_rows, group):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(mixing, "RANGE_GROUP", group)
    found = rows(*[(i, sentence(i, 1 + i % 17), "en", "hot" if i % 3 else f"s{i % 9}") for i in range(300)])
    with Workspace(spark) as space:
        assert result(space, documents(spark, found)) == brute(found)


def test_sources_that_reach_their_limit(spark):
    found = rows(*[(i, sentence(i, 10), "en", "a" if i < 2 else "b" if i < 10 else "c") for i in range(200)])
    with Workspace(spark) as space:
        got = result(space, documents(spark, found))
    assert got == brute(found)
    assert {r[4] for r in got if r[0] < 2} == {3}


def test_joined_by_shuffle_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    with Workspace(spark) as space:
        assert result(space, documents(spark, awkward())) == brute(awkward())


@pytest.mark.parametrize("found", [[], rows((1, ""), (2, None))])
def test_nothing_to_mix(spark, found):
    with Workspace(spark) as space:
        assert [r[5] for r in result(space, documents(spark, found))] == [0] * len(found)
