from __future__ import annotations

import random

import pytest

from tidepanel.llm import components as C


def brute(edges):
    least = {x: x for e in edges for x in e}
    while True:
        new = least | {x: min(least[x], *(least[b if x == a else a] for a, b in edges if x in (a, b))) for x in least}
        if new == least:
            return least
        least = new


@pytest.fixture
def stored(monkeypatch):
    names, write = [], C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, name: (names.append(name), write(df, name))[1])
    return names


def test_stars_are_done_without_a_round(spark, stored):
    """A group of copies is a star as it comes: the edges and the least neighbours are stored, and nothing else."""
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 100) for i in range(1, 5)]
    got = [tuple(r) for r in C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert dict(got) == brute(edges) and len(got) == len(dict(got))
    assert stored == ["cc", "cc-low"]


def test_graphs_of_all_kinds(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(30)]
    hub = [(199, i) for i in range(100, 130)]
    scattered = [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges = [e for e in chain + hub + scattered + [(1000, 999), (999, 1000)] if e[0] != e[1]]
    rows = edges + [(7, 7), (500, 500), (None, 8), (600, None)]
    got = [tuple(r) for r in C.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()]
    assert dict(got) == brute(edges) and len(got) == len(dict(got))


def test_no_edges(spark):
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
