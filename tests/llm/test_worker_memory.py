"""What a worker holds of a task goes back to the system when the task ends."""

from pathlib import Path

import numpy as np
import pyarrow as pa
from adlytics.llm import common

BATCH = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["id"])


def held() -> float:
    """MB of this process that belong to no file."""
    lines = Path("/proc/self/smaps_rollup").read_text().split("\n")
    return sum(int(line.split()[1]) for line in lines if line.startswith("Pss_Anon")) / 1024


def scattered(pins):
    """Many arrays, of which every thousandth outlives the task: what is free between them stays in the C library."""

    def run(batches):
        for batch in batches:
            arrays = [np.ones(60_000, np.uint8) for _ in range(4_000)]
            pins.extend(arrays[::1000])
            yield batch

    return run


def test_freed_memory_is_given_back_at_the_end_of_a_task():
    pins = []
    common.give_back()
    before = held()
    assert list(common.released(scattered(pins))(iter([BATCH]))) == [BATCH]
    assert held() < before + 40


def test_memory_is_given_back_when_a_task_is_closed_early(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    some = common.released(lambda batches: batches)(iter([BATCH, BATCH]))
    next(some)
    assert not calls
    some.close()
    assert calls


def test_results_are_those_of_the_function():
    doubled = common.released(lambda batches: (x for b in batches for x in (b, b)))
    assert list(doubled(iter([BATCH]))) == [BATCH, BATCH]
    assert list(doubled(iter([]))) == []
