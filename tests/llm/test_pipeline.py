"""The pipeline: each stage on a small corpus, against what brute force keeps."""

import random

import corpus_pipeline
from quarry.llm.decontaminate import words_of

from .test_models import LANGS, sentence
from .test_text_operators import edited, shingles


def corpus():
    r = random.Random(2)
    docs = [(i, sentence(list(LANGS)[i % 4], i, 60), list(LANGS)[i % 4], "s", 0) for i in range(40)]
    base = "\n".join(sentence("en", 900 + k, 25) for k in range(6))
    docs += [(100, base, "en", "s", 0), (101, base, "en", "s", 0), (102, edited(base.replace("\n", " "), 4, 6), "en", "s", 0)]
    bench = " ".join(f"secret{r.randint(0, 9999)}" for _ in range(14))
    docs += [(200, sentence("de", 77, 30) + " " + bench, "de", "s", 0), (300, "12345 !!!", "en", "s", 0), (301, None, "en", "s", 0)]
    return docs, [(1, bench)]


def test_stages_and_run(spark, tmp_path):
    docs, bench = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "sentencepiece"]
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {d[0]: d[1] for d in docs}
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in df.collect()}
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        df = spark.read.parquet(f"{tmp_path}/out{k}")
        left = {r["doc_id"]: r["text"] for r in df.collect()}
        if k < 4:
            assert df.dtypes == spark.read.parquet(f"{tmp_path}/documents.parquet").dtypes
        assert set(left) <= set(before)
        if name == "language_id":
            assert set(before) - set(left) == {300, 301}
        if name == "line_dedup":
            assert set(before) - set(left) == {101} and left[100] == texts[100]
        if name == "ngram_jaccard":
            sets = {i: shingles(t, 5) for i, t in before.items()}
            close = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            assert set(left) == {i for i in sets if not any(j < i and close(i, j) for j in sets)}
        if name == "decontaminate":
            assert set(before) - set(left) == {200} and set(words_of(bench[0][1])) <= set(words_of(before[200]))
    rows = df.collect()
    assert all(r["lossless"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left
