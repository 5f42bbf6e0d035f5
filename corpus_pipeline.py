"""The corpus pipeline: STAGES run in order over documents, each reading what the one before kept.

1. language ID: documents without letters, or unlike every learned language, go;
2. line dedup: of near-duplicate lines one stays; documents left without a word go;
3. n-gram Jaccard join: of documents linked at 0.8 of five-word shingles the smallest doc_id stays;
4. benchmark decontamination: documents that hold a window of a benchmark item go;
5. SentencePiece encoding: the ids of what is left, which decode to its text.

Stages 1 to 4 return the columns of documents; stage 5 adds n_tokens, token_ids and lossless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, free_name, may_broadcast, scratch, settle
from quarry.llm.decontaminate import with_hits
from quarry.llm.jaccard_join import jaccard_groups
from quarry.llm.language_id import train, with_language
from quarry.llm.line_dedup import drop_duplicate_lines
from quarry.llm.sentencepiece_bpe import with_tokens

#: Cosine with the nearest language prototype under which any document is rejected. One word of a
#: language lies above it, so short clean documents stay.
MIN_COSINE = 0.01
#: Cosines of unrelated vectors spread by 1/sqrt(dims). A document of FULL distinct trigrams needs
#: SPREADS times that; with fewer the bound falls with the square of their number, to MIN_COSINE.
SPREADS, FULL = 4, 30


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a learned language is found for; learned from the rows of docs with a lang.

    Null texts and texts without a letter go, as no language is found for them; with nothing to
    learn from, all rows stay. Rows are judged one by one, so repeated rows, null or repeated
    ids and ties (the first language in order) share their fate; a null id only teaches nothing
    extra. Texts are read whole. No rows: no rows. All columns of docs pass, whatever their names.
    """
    names, prototypes = train(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    if not names:
        return docs
    found = free_name("__lang", docs)
    out = with_language(docs, names, prototypes, into=found)
    share = F.least(F.col(f"{found}.n_grams") / FULL, F.lit(1.0))
    bound = F.greatest(F.lit(MIN_COSINE), share * share * F.lit(SPREADS / prototypes.shape[1] ** 0.5))
    return out.where(F.col(f"{found}.score") >= bound).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that near-duplicate a line of smaller (doc_id, line); n_chars follows the text.

    Documents left without a word go; those that had none before (null, empty, blank) stay.
    Rows with a null doc_id stay as they are. Rows that repeat a doc_id and its text lose the
    same lines, so copies under one id stay. Lines are read whole. No rows: no rows. Other
    columns pass, whatever their names.
    """
    out = drop_duplicate_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of smallest doc_id; documents without words all stay.

    Rows with a null doc_id stay, duplicates or not; rows that repeat a doc_id are one document
    (of its smallest text) and stay or go together. Texts are read whole. No rows: no rows.
    Other columns pass, whatever their names.
    """
    with scratch():
        groups = jaccard_groups(docs, shingle=5, percent=80)
        gone = settle(groups.where("component_id <> doc_id").select("doc_id"), "gone", keep=True)
        discard(groups)
    key = free_name("__gone", docs)
    gone = gone.select(F.col("doc_id").alias(key))
    side = F.broadcast(gone) if may_broadcast(gone) else gone
    return docs.join(side, docs["doc_id"].cast("long") == F.col(key), "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Rows are judged one by one by their whole text, so repeated rows and null or repeated ids
    share their fate; null and empty texts hold nothing and stay. No rows, or no items: docs as
    they are. All columns pass, whatever their names.
    """
    hits = free_name("__hits", docs)
    out = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=hits)
    return out.where(F.size(f"{hits}.items") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens, token_ids and lossless, which take the place of columns of those names.

    A null text has null for all three, the empty text no ids. Rows with a null id take one key,
    repeated rows equal ids. Texts are encoded whole. No rows: no rows.
    """
    made = free_name("__tokens", docs)
    out = with_tokens(docs, into=made)
    tokens = {"n_tokens": F.size(f"{made}.token_ids").cast("long"), "token_ids": F.col(f"{made}.token_ids"), "lossless": F.col(f"{made}.lossless")}
    return out.select(*[c for c in docs.columns if c.lower() not in tokens], *[F.when(F.col(f"{made}.lossless").isNotNull(), x).alias(c) for c, x in tokens.items()])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontaminate", decontaminate),
    ("sentencepiece", encode),
]

#: No SQL: hyperdimensional vectors, MinHash and merge-dropout are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's rows are written as Parquet and read again, and go when the next stage's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"pipeline-{k}-{name}", keep=True)
            if before is not None:
                discard(before)
            before = docs
    return docs
