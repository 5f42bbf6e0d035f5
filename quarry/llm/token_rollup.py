"""Operator 6: token counts kept as additive rollups under signed, idempotent batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
TOTALS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def bpe_counter(spark: SparkSession, ranks_path: str | None = None):
    """text Column -> number of byte-level BPE tokens (null for null), from a file of ranks the driver reads."""
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    model = spark.sparkContext.broadcast((public_tokenizers.PATTERN, ranks))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pattern, ranks = model.value
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pa.array([None if t is None else len(enc.encode_ordinary(t)) for t in texts.to_pylist()], pa.int64())

    return count


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space (null for null)."""
    return F.when(text.isNotNull(), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"))


def facts(docs: DataFrame, tokenizer: str, n_tokens: Column) -> DataFrame:
    """One row of counts per document under a tokenizer version; a null text counts 0 tokens and characters."""
    return docs.select(
        "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.coalesce(n_tokens, F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")
    )


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Counts as inserts (1) or deletes (-1)."""
    return rows.select(*KEYS, *[(F.col(c) * sign).alias(c) for c in TOTALS])


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The delta that replaces old counts by new ones: their deletes and inserts together."""
    return signed(old, -1).unionByName(signed(new, 1))


def rolled(deltas: DataFrame) -> DataFrame:
    """Additive totals by key; keys whose totals are all zero go. Null keys group together."""
    return deltas.groupBy(*KEYS).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in TOTALS]).where(" or ".join(f"{c} <> 0" for c in TOTALS))


@dataclass
class RollupStore:
    """Committed batches in a folder: one small rollup each, at <folder>/batch=<id>.

    A batch is aggregated into a staging folder and renamed to its own name, which takes
    effect once: a batch id that is there already is not applied again, whether a retry, a
    speculative writer or a replay brings it. Staging of a writer that died counts for nothing.
    """

    spark: SparkSession
    folder: str

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self) -> list[str]:
        fs, p = self._fs(self.folder)
        return sorted(s.getPath().getName().removeprefix("batch=") for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")) if fs.exists(p) else []

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Apply a batch of signed counts; False if it was committed before (then deltas isn't even computed)."""
        import uuid

        if not batch_id or "/" in batch_id or "=" in batch_id:
            raise ValueError(f"batch id {batch_id!r}")
        to = f"{self.folder}/batch={batch_id}"
        fs, target = self._fs(to)
        if fs.exists(target):
            return False
        staged = f"{self.folder}/_staging-{uuid.uuid4().hex}"
        rolled(deltas).write.parquet(staged)
        _, source = self._fs(staged)
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
            return False
        _, nested = self._fs(f"{to}/{staged.rsplit('/', 1)[1]}")
        if fs.exists(nested):  # some stores move into a folder that came up meanwhile: the other writer's batch counts
            fs.delete(nested, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars over all committed batches."""
        paths = [f"{self.folder}/batch={b}" for b in self.committed()]
        return rolled(self.spark.read.schema(SCHEMA).parquet(*paths)) if paths else self.spark.createDataFrame([], SCHEMA)
