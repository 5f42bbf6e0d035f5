"""Texts that differ alike from their centre are linked by stars, not by all their pairs."""

from quarry.llm import common, linking
from quarry.llm.shingles import CharShingles


def test_texts_that_left_their_centre_alike_make_no_pairs_of_all(spark, monkeypatch):
    """30 lines keep half of a common line and go on alike, but for their last letters: they link with each other, not with it."""
    base = "the quick brown fox jumps over the lazy dog near the river bank at noon and sleeps"
    texts = [base] + [base[:44] + "under seven old stars of the cold north" + c for c in "abcdefghijklmnopqrstuvwxyz0123"]
    sets = CharShingles(8)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    entries = spark.createDataFrame([(1, i, i, len(sets.of(t))) for i, t in enumerate(texts)], "token long, id long, rank long, n long")
    seen = []
    compare = linking.Texts.compare
    monkeypatch.setattr(linking.Texts, "compare", lambda self, pairs: (seen.append(pairs.count()), compare(self, pairs))[1])
    with common.scratch():
        links = linking.link(entries, linking.Texts(lambda ids: table, sets, 80, passing=False), "rank")
        comp = dict(common.components(links).collect())
    assert {comp.get(i, i) for i in range(1, len(texts))} == {1}
    assert comp.get(0, 0) == 0
    assert sum(seen[1:]) <= len(texts)  # all pairs: 435
