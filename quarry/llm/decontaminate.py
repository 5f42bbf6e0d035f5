"""Operator 10: words of documents that lie inside windows of benchmark items."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, free_name, scratch, settle

#: Benchmark windows that are broadcast; those of a larger benchmark are joined by a shuffle.
MAX_WINDOWS = 500_000

_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of a-z (A-Z lowered), 0-9 and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORD).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Runs of size consecutive words; fewer words, but not none, are one window."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _frequencies(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences in all documents of the benchmark's words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(filter(shared.value.__contains__, words_of(text)))
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def _prefix_index(items: list[tuple[str, str]], size: int, frequency: dict[bytes, int]) -> dict:
    """rarest word -> [(its place in the window, window, item ids)]: the prefix of a set that must be contained whole is its rarest word."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        for w in windows_of(words_of(text), size):
            owners[w].add(item)
    index: dict[bytes, list] = defaultdict(list)
    for w, ids in owners.items():
        if all(x in frequency for x in w):
            at = min(range(len(w)), key=lambda i: (frequency[w[i]], w[i], i))
            index[w[at]].append((at, list(w), sorted(ids)))
    return dict(index)


def find_hits(text: str | None, index: dict) -> tuple[int, list[int], list[int], list[str]]:
    """Words of a text, the merged runs of words inside windows, and the items found."""
    words = words_of(text)
    spans, found = [], set()
    for i in [i for i, w in enumerate(words) if w in index]:
        for at, window, ids in index[words[i]]:
            start, end = i - at, i - at + len(window)
            if start >= 0 and end <= len(words) and words[start:end] == window:
                spans.append((start, end))
                found.update(ids)
    return len(words), *merge_spans(spans), sorted(found)


def merge_spans(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _finder(index):
    """A function of texts to HITS with a broadcast index."""

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find_hits(t, index.value) for t in texts], columns=["n_words", "starts", "ends", "items"])

    return hits


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, max_windows: int = MAX_WINDOWS, into: str = "__hits") -> DataFrame:
    """docs with a struct column into (in place of one of that name): n_words, starts and ends of hit runs (in words, merged), items found (sorted strings).

    Prefix-filtered set join: words are ordered by rarity over all documents; a window,
    which must be contained whole, is joined on its necessary prefix, the rarest word;
    the word's place bounds the position and the document's length; then the window's
    words are compared exactly. Up to max_windows windows are broadcast as an index; of
    more only hashes of their join tokens are, and windows meet the documents in a shuffle
    join. Either way documents are read twice, whatever the size of the benchmark.

    Null and empty texts have no words. Items with a null id or without words have no
    window. Rows are independent: ties, repeats and clashing columns of docs are kept as
    they are. Either table may be empty.
    """
    bound_batches(docs)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).where("item is not null and text is not null")
    length = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if length > 2 * max_windows:  # a word and its gap take two characters at least
        return _with_joined_hits(docs, items, text_col, window, into)
    known = [(r["item"], r["text"]) for r in items.collect()]
    frequency = _frequencies(docs, text_col, {w for _, t in known for w in words_of(t)})
    index = docs.sparkSession.sparkContext.broadcast(_prefix_index(known, window, frequency))
    return docs.withColumn(into, _finder(index)(F.col(text_col)))


#: Hashes of join tokens that are broadcast (8 bytes each) to drop other tokens of documents before the join.
TOKENS = 2_000_000
#: Distinct words a task counts before it passes them on.
COUNTED = 500_000


def _hashed(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


def _windows(items: DataFrame, size: int) -> DataFrame:
    """(w, item): the distinct windows of items, their words parted by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"], strict=True):
                made = list({b" ".join(w) for w in windows_of(words_of(text.as_py()), size)})
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array([item] * len(made), pa.string())], ["w", "item"])

    return items.select("item", "text").mapInArrow(run, "w binary, item string").select(F.col("w").cast("string").alias("w"), "item").distinct()


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over texts of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch["text"]:
                seen.update(words_of(text.as_py()))
                if len(seen) > COUNTED:
                    yield flush()
                    seen.clear()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def _with_joined_hits(docs: DataFrame, items: DataFrame, text_col: str, window: int, into: str) -> DataFrame:
    """with_hits for a benchmark of any size: a window is joined on its rarest word with the one beside it.

    What a document holds is found once for each distinct text.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    with scratch():
        owned = settle(_windows(items, window), "windows")
        words = owned.select("w").distinct().select("w", F.size(F.split("w", " ")).alias("size"), F.posexplode(F.split("w", " ")).alias("at", "word"))
        counts = _word_counts(texts)
        ranked = words.join(counts.join(words.select("word").distinct(), "word", "left_semi"), "word")
        rarest = ranked.groupBy("w", "size").agg(F.min(F.struct("n", "word", "at")).alias("x"), F.count("*").alias("k")).where("k = size")
        at = F.least(F.col("x.at"), F.greatest(F.col("size") - 2, F.lit(0)))
        token = F.array_join(F.slice(F.split("w", " "), at + 1, F.lit(2)), " ")
        index = settle(rarest.select("w", "size", at.alias("at"), token.alias("token")), "index")
        tokens = index.select("token").distinct()
        few = tokens.limit(TOKENS + 1).count() <= TOKENS
        known = np.sort(np.array([_hashed(r["token"].encode("utf-8", "surrogatepass")) for r in tokens.toLocalIterator()], np.int64)) if few else None
        single = bool(index.where("size = 1").limit(1).count())
        wanted = spark.sparkContext.broadcast(known)
        kinds = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

        def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                    found = words_of(text.as_py())
                    spots = [(i, b" ".join(found[i : i + 2])) for i in range(len(found) - 1)] + (list(enumerate(found)) if single else [])
                    if wanted.value is not None and spots:
                        hashes = np.fromiter((_hashed(t) for _, t in spots), np.int64, len(spots))
                        spots = [spots[i] for i in np.flatnonzero(np.isin(hashes, wanted.value)).tolist()]
                    if spots:
                        low = [max(0, i - window + 1) for i, _ in spots]
                        near = [b" ".join(found[a : i + window]) for (i, _), a in zip(spots, low, strict=True)]
                        columns = [[key] * len(spots), [t for _, t in spots], [i for i, _ in spots], [i - a for (i, _), a in zip(spots, low, strict=True)], near]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "token", "i", "before", "near"])

        keyed = texts.select(F.md5(F.col("text").cast("binary")).alias("key"), "text")
        spots = keyed.mapInArrow(tokens_of, "key string, token binary, i int, before int, near binary")
        spots = spots.withColumns({c: F.col(c).cast("string") for c in ("token", "near")})
        # position: the window has to begin inside the document; then its words are compared
        held = spots.join(index, "token").where("before >= at")
        same = F.array_join(F.slice(F.split("near", " "), F.col("before") - F.col("at") + 1, F.col("size")), " ") == F.col("w")
        spans = held.where(same).select("key", (F.col("i") - F.col("at")).cast("long").alias("start"), (F.col("i") - F.col("at") + F.col("size")).cast("long").alias("end"), "w").distinct()
        spans = settle(spans, "spans")
        found = spans.join(owned, "w").select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
        places = spans.select("key", "start", "end").distinct().groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
        hits = settle(places.join(found, "key"), "hits", keep=True)
    key, starts, ends, found = (free_name(n, docs) for n in ("__text", "__starts", "__ends", "__items"))
    hits = hits.select(F.col("key").alias(key), F.col("starts").alias(starts), F.col("ends").alias(ends), F.col("items").alias(found))

    @F.pandas_udf(HITS)
    def merged(texts: pd.Series, starts: pd.Series, ends: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = [(len(words_of(t)), *(merge_spans(list(zip(s, e, strict=True))) if s is not None else ([], [])), list(i) if i is not None else []) for t, s, e, i in zip(texts, starts, ends, items, strict=True)]
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    joined = docs.join(hits, F.md5(F.col(text_col).cast("binary")) == F.col(key), "left")
    made = merged(F.col(text_col), F.col(starts), F.col(ends), F.col(found))
    return joined.withColumn(into, made).select(*[F.col(into) if c == into else F.col(c) for c in [*[c for c in docs.columns if c != into], into]])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (see with_hits)."""
    h = with_hits(docs.select("doc_id", "text"), benchmark, "text", window, max_windows)
    n_hit = F.aggregate(F.zip_with("__hits.starts", "__hits.ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return h.select(
        "doc_id",
        F.col("__hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__hits.items", ","), 256).alias("items_sha256"),
        (F.size("__hits.items") > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    """Lowercase hex SHA-256 of sorted, comma-joined ids, as the query returns it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
