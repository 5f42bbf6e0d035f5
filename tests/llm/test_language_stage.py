"""The pipeline's language stage rejects what is unlike every learned language and keeps short clean texts."""

import random

import corpus_pipeline

from .test_models import LANGS, sentence


def test_unlearned_scripts_and_noise_go(spark):
    r = random.Random(5)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(3, 9)))
    cyrillic, latin = "".join(map(chr, range(0x430, 0x450))), "bcdfghjklmnpqrstvwxz"
    docs = [(i, sentence(list(LANGS)[i % 4], i, 60), list(LANGS)[i % 4]) for i in range(80)]
    docs += [(1000 + i, " ".join(word(cyrillic if i % 2 else latin) for _ in range(40)), None) for i in range(40)]
    docs += [(2000 + i, sentence(list(LANGS)[i % 4], 500 + i, 3), None) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    kept = {d["doc_id"] for d in corpus_pipeline.language_id(spark, df, "").collect()}
    assert kept == {d[0] for d in docs if not 1000 <= d[0] < 2000}
