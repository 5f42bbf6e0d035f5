"""Operator 7: language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Training documents used per language at most (expected; picked by a hash of the id).
TRAIN_PER_LANG = 2000
DIMS = 512
#: n-gram vectors a worker keeps (DIMS bytes each) before it starts its cache anew.
CACHE = 150_000
_SCALE = 1_000_000


class Encoder:
    """Bundles letter trigrams into vectors of -1/+1 components.

    A letter has a random vector seeded by its code point; a trigram binds (multiplies) the
    vectors of its letters permuted (rolled) by 2, 1 and 0 places; a document bundles (adds)
    its trigrams. Text is lower-cased; each run of other characters counts as one space.
    """

    def __init__(self, dims: int = DIMS, seed: int = 7):
        self.dims, self.seed = dims, seed
        self.letters: dict[int, np.ndarray] = {}
        self.reset()

    def reset(self) -> None:
        self.keys = np.empty(0, np.int64)
        self.rows = np.empty((0, self.dims), np.int8)

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            v = self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims, np.int8) * np.int8(2) - np.int8(1)
        return v

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigram keys of a text and their counts; none if it has no letter."""
        if not text:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low = text.lower()
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(codes) < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        kinds = _LETTER(codes)
        codes = np.where(kinds, codes, 32)
        codes = np.concatenate(([32], codes, [32]))
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        if not kinds.any() or len(codes) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Rows of self.rows for sorted keys; unknown trigrams are bound and kept."""
        at = np.searchsorted(self.keys, keys)
        known = (self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if len(self.keys) > CACHE:
                self.reset()
                return self.lookup(keys)
            new = keys[~known]
            m = (1 << 21) - 1
            made = np.stack([np.roll(self.letter(k >> 42), 2) * np.roll(self.letter((k >> 21) & m), 1) * self.letter(k & m) for k in new.tolist()])
            order = np.argsort(np.concatenate((self.keys, new)), kind="stable")
            self.keys = np.concatenate((self.keys, new))[order]
            self.rows = np.concatenate((self.rows, made))[order]
            at = np.searchsorted(self.keys, keys)
        return at

    def encode(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text; None if it has no letter."""
        return self.bundle(*self.grams(text))

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
        """The unit vector of distinct trigrams and their counts; None if there are none."""
        if not len(keys):
            return None
        at = self.lookup(keys)
        total = np.zeros(self.dims, np.float32)
        for i in range(0, len(at), 8192):
            total += counts[i : i + 8192].astype(np.float32) @ self.rows[at[i : i + 8192]].astype(np.float32)
        norm = float(np.sqrt(np.dot(total, total)))
        return total / norm if norm else total


_table = np.array([chr(c).isalpha() for c in range(0x3000)])


def _LETTER(codes: np.ndarray) -> np.ndarray:
    small = codes < len(_table)
    out = _table[np.where(small, codes, 0)]
    if not small.all():
        far = codes[~small]
        letters = {c: chr(c).isalpha() for c in np.unique(far).tolist()}
        out[~small] = [letters[c] for c in far.tolist()]
    return out


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, dims: int = DIMS, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Language names (sorted) and their unit prototype vectors, from docs(id, text, lang)."""
    bound_batches(docs)
    docs = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.empty((0, dims), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    chosen = docs.where(F.expr("(shiftrightunsigned(xxhash64(id), 11) / 9007199254740992D)") <= share[F.col("lang")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sums = Encoder(dims, seed), {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                v = enc.encode(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(v.astype(np.float64) * _SCALE).astype(np.int64)
        for lang, s in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(dims), "v": s})

    rows = chosen.select("text", "lang").mapInPandas(run, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).toPandas()
    names = sorted(rows["lang"].unique())
    out = np.zeros((len(names), dims))
    out[rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(int), rows["dim"].to_numpy(int)] = rows["v"].to_numpy(float)
    return names, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def with_language(docs: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str = "text", into: str = "__lang", seed: int = 7) -> DataFrame:
    """docs with a struct column into: lang_pred, score, the cosine with the nearest prototype (0 to 1), and n_grams, the distinct trigrams.

    `und` with score 0 for a null text, a text without letters, or when nothing was learned.
    Equal cosines go to the first name in order. Whole texts of any length are read.
    """
    bound_batches(docs)
    model = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    @F.pandas_udf("lang_pred string, score double, n_grams long")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, protos = model.value
        enc = Encoder(protos.shape[1], seed)
        for texts in batches:
            out = []
            for text in texts:
                keys, counts = enc.grams(text) if names else ((), ())
                v = enc.bundle(keys, counts)
                if v is None:
                    out.append(("und", 0.0, 0))
                    continue
                cos = protos @ v
                best = int(np.argmax(cos))
                out.append((names[best], float(min(1.0, max(0.0, cos[best]))), len(keys)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "n_grams"])

    return docs.withColumn(into, predict(F.col(text_col)))


def identify_languages(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    Prototypes are bundled from documents whose crc32(doc_id as text) mod 3 is not 1 (held_out
    false) and whose lang is set, per_lang of each language in expectation; predictions read
    the text alone. A null doc_id gives held_out null and trains nothing.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    names, protos = train(docs.where(~held).select(F.col("doc_id").alias("id"), "text", "lang"), per_lang)
    out = with_language(docs.select("doc_id", held.alias("held_out"), "text"), names, protos)
    return out.select("doc_id", "held_out", "__lang.lang_pred", "__lang.score")
