"""The suffix array and what it covers, against brute force."""

import numpy as np
import pytest

from quarry.llm.html_text import extract_text, repeated, suffix_array

from .test_models import prose


@pytest.mark.parametrize("seed", range(6))
def test_order_and_common_prefixes(seed):
    r = np.random.default_rng(seed)
    text = np.append(r.integers(0, 1 + seed, 60 * (seed > 0) + 5), 99)
    suffixes = [tuple(text[i:]) for i in range(len(text))]
    order, common = suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: suffixes[i])
    for k in range(1, len(text)):
        a, b = suffixes[order[k - 1]], suffixes[order[k]]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(8))
def test_cover_is_what_substrings_repeat(seed):
    r = np.random.default_rng(seed)
    run, least = 3 + seed % 2, 2 + seed % 3
    streams = [r.integers(0, 4, r.integers(0, 30)) for _ in range(7)]
    pages = [0, 1, 2, 2, 3, 4, 5]
    where: dict[tuple, set] = {}
    for s, p in zip(streams, pages):
        for i in range(len(s) - run + 1):
            where.setdefault(tuple(s[i : i + run]), set()).add(p)
    want = []
    for s in streams:
        hit = np.zeros(len(s), bool)
        for i in range(len(s) - run + 1):
            if len(where[tuple(s[i : i + run])]) >= least:
                hit[i : i + run] = True
        want.append(hit.tolist())
    assert [x.tolist() for x in repeated(streams, pages, run, least)] == want


def test_long_pages_and_repeats_across_them(spark):
    long = prose(1, 60_000)
    rows = [(1, "http://h.example/1", f"<p>{long}</p><p>{prose(2, 40)}</p>"), (2, "http://h.example/2", f"<p>{long}</p><p>{prose(3, 40)}</p>"), (2, "http://h.example/2", None)]
    got = [r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("n_chars", "page_id").collect()]
    assert sorted(got) == sorted(["", prose(2, 40), prose(3, 40)])
