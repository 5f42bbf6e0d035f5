"""Every stage with columns of clashing names, null and repeated ids, empty and long texts, and no rows."""

import corpus_pipeline
import pytest

from .test_models import sentence

NAMES = ["__gone", "__left", "__key", "__lang", "__hits", "__tokens", "__text", "__starts", "n_tokens", "token_ids", "lossless", "id", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(1, "windows of a benchmark item that nobody else has written down"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows():
    same, long = sentence("en", 1, 40), "\n".join(sentence("de", 500 + i, 30) for i in range(400))
    found = [(1, same), (2, same), (None, same), (None, same), (3, sentence("fr", 3, 40)), (3, sentence("fr", 3, 40)), (4, None), (5, ""), (6, " \n "), (7, long), (8, "windows of a benchmark item that nobody else has written down")]
    return [(i, t, "en", "s", 0, *[f"{n}-{k}" for n in NAMES]) for k, (i, t) in enumerate(found)]


#: What each stage leaves of rows(), by place.
LEFT = {
    "language_id": {0, 1, 2, 3, 4, 5, 9, 10},
    "line_dedup": {0, 2, 3, 4, 5, 6, 7, 8, 9, 10},
    "ngram_jaccard": {0, 2, 3, 4, 5, 6, 7, 8, 9, 10},
    "decontaminate": {0, 1, 2, 3, 4, 5, 6, 7, 8, 9},
    "sentencepiece": set(range(11)),
}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage(spark, folder, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = stage(spark, docs, folder)
    got = out.collect()
    assert {int(r["__gone"].split("-")[1]) for r in got} == LEFT[name] and len(got) == len(LEFT[name])
    made = {"n_tokens", "token_ids", "lossless"} if name == "sentencepiece" else set()
    assert set(out.columns) == set(docs.columns)
    for r in got:
        k = r["__gone"].split("-")[1]
        assert all(r[n] == f"{n}-{k}" for n in NAMES if n not in made)
        if made:
            assert r["lossless"] is (None if r["text"] is None else True) and (r["n_tokens"] is None) == (r["text"] is None)
    none = stage(spark, docs.limit(0), folder)
    assert none.count() == 0 and none.columns == out.columns
