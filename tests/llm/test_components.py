import random

import pytest

from tessera.llm.components import components, merged


@pytest.mark.parametrize("finish", [0, 5, 1000])
def test_components_of_paths_stars_and_cycles(spark, finish):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    rng.shuffle(edges)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), finish).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 40)} | {200: 200, 201: 200, 202: 200}
    assert got == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("finish", [0, 1000])
def test_merged_equals_components_of_all_edges(spark, finish):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    for at in (0, 1, 80, 160):
        want = {(r["node"], r["component"]) for r in components(frame(edges)).collect()}
        got = [(r["node"], r["component"]) for r in merged(components(frame(edges[:at])), frame(edges[at:]), finish).collect()]
        assert len(got) == len(set(got)) and set(got) == want
