"""The marks of sets leave out pairs that cannot link, and only those."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import linking
from quarry.llm.shingles import CharShingles, marks


def test_marks_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(5)
    for n in (0, 1, 30, 400):
        x = np.unique(rng.integers(0, 2**63, n, np.uint64))
        for k in (0, 1, 9, 200):
            y = np.unique(np.concatenate((x[k:], rng.integers(0, 2**63, k, np.uint64))))
            assert sum(int(v).bit_count() for v in (marks(x) ^ marks(y)).view(np.uint64)) <= len(np.setxor1d(x, y))


def test_edits_far_apart_are_no_pairs(spark, monkeypatch):
    """Lines that keep about half of a common line share tokens with each other and link with none; two of them do."""
    rng = np.random.default_rng(9)
    base = "the quick brown fox jumps over the lazy dog near the river bank at noon"
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 18))
    texts = [base] + [base[:38] + word() for _ in range(60)]
    texts.append(texts[7] + "q")
    sets = CharShingles(8)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    entries = spark.createDataFrame([(1, i, i, len(sets.of(t))) for i, t in enumerate(texts)] + [(2, i, i, len(sets.of(t))) for i, t in enumerate(texts) if i], "token long, id long, rank long, n long")
    seen = []
    compare = linking.Texts.compare
    monkeypatch.setattr(linking.Texts, "compare", lambda self, pairs: (seen.append(pairs.count()), compare(self, pairs))[1])
    with linking_scratch():
        links = linking.link(entries, linking.Texts(lambda ids: table, sets, 80, passing=False), "rank")
        got = {tuple(sorted(r)) for r in links.select("a", "b").where(F.col("a") != F.col("b")).collect()}
    assert got == {(7, len(texts) - 1)}
    assert sum(seen[1:]) <= 2  # without marks: 26


def linking_scratch():
    from quarry.llm.common import scratch

    return scratch()
