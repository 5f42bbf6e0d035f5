"""Components in one task and by rounds, and the line that is kept."""

import numpy as np
import pytest

from quarry.llm import common
from quarry.llm.line_dedup import dedup_lines


def smallest_reachable(edges):
    comp = {x: x for e in edges for x in e}
    while True:
        before = dict(comp)
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            return comp


def graphs():
    rng = np.random.default_rng(3)
    yield []
    yield [(5, 5)]
    yield [(i + 1, i) for i in range(60)]
    yield [(1000 - i, 0 if i % 2 else -(2**60)) for i in range(50)]
    yield [(i, (i * 7 + 3) % 41 - 20) for i in range(41)]
    yield rng.integers(-300, 300, (240, 2)).tolist()


def test_one_task_finds_the_smallest_reachable():
    for edges in graphs():
        u, v = np.array(edges, np.int64).reshape(-1, 2).T
        ids, comp = common.least_reachable(u, v)
        assert dict(zip(ids.tolist(), comp.tolist(), strict=True)) == smallest_reachable(edges)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(common, "ONE_TASK_EDGES", most)
    edges = [tuple(e) for e in list(graphs())[-1]]
    with common.scratch():
        table = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
        assert dict(common.components(table).collect()) == smallest_reachable(edges)


def test_few_edges_write_one_table(spark, monkeypatch):
    written = []
    settle = common.settle
    monkeypatch.setattr(common, "settle", lambda *a, **b: (written.append(a[1]), settle(*a, **b))[1])
    with common.scratch():
        common.components(spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")).collect()
    assert written == ["edges"]


@pytest.mark.parametrize("far", [0, 2**32 - 50, 2**62, -(2**62), -(2**32)])
def test_the_first_line_is_kept_whatever_the_ids(spark, far):
    rows = [(far + 7, "b line of some words\na line of other words"), (far + 3, "x y z\nA line of other  words"), (far + 3, "A line of other  words"), (0, "b line of some words"), (None, "x y z")]
    found = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[far + 7, 1] == (far + 3, 0)
    assert found[far + 3, 1] == (far + 3, 0)
    assert found[far + 7, 0] == found[0, 0] == min((far + 7, 0), (0, 0))
