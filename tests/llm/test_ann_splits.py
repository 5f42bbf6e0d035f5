"""The search does not depend on how queries and buckets are split, and meets its recall where nothing clusters."""

import numpy as np

from quarry.llm import ann


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_shares_and_blocks_do_not_change_the_answers(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.standard_normal((600, 12))
    x[40:100] = x[40]  # a common vector, also among the queries
    rows = [(i, [float(v) for v in row], 1, "q") for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, share int, q string")
    whole = rows_of(ann.nearest(df, df.where("vec_id % 20 = 0"), k=5))
    monkeypatch.setattr(ann, "QUERIES", 7)
    assert rows_of(ann.nearest(df, df.where("vec_id % 20 = 0"), k=5, block=64)) == whole
    assert [w[2] for w in whole if w[0] == 40] == [41, 42, 43, 44, 45] and [w[2] for w in whole if w[0] == 60] == [40, 41, 42, 43, 44]


def test_recall_without_clusters(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((1500, 32))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for q, _, i, _ in rows_of(ann.nearest(df, df.where("vec_id % 20 = 0"))):
        got.setdefault(q, set()).add(i)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    hits = sum(len(got[q] & set(np.argsort(-score[q])[:20].tolist())) for q in range(0, 1500, 20))
    assert hits >= 0.9 * 20 * 75
