"""Prefixes of shingle sets in the order of rarity, for exact similarity joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep_ids, settle
from .shingles import mix

Hashes = Callable[[str | None], np.ndarray]

#: Shingles listed as frequent, at most (16 bytes each are broadcast). The list only orders shingles.
FREQUENT = 1_000_000


def needed(n: int, percent: int) -> int:
    """Shingles of a set of n that are enough to meet any partner: n - ceil(t n) + 1."""
    return n - (-(-percent * n // 100)) + 1


#: 64-bit words of the sketch of a prefix.
SKETCH = 4


def sketch(prefix: np.ndarray) -> tuple[np.ndarray, int]:
    """A bitmap of a prefix's shingles, as SKETCH longs, and how many of them share a bit with another.

    Two prefixes share at most as many shingles as bits, and those that the bitmap of either lost.
    """
    bits = np.zeros(SKETCH * 64, bool)
    bits[(prefix.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (SKETCH * 64)] = True
    return np.packbits(bits).view(np.int64), len(prefix) - int(bits.sum())


def _prefix_batch(ids: pa.Array, ns: pa.Array, out: list[np.ndarray]) -> pa.RecordBatch:
    made = [sketch(x) for x in out]
    words = np.array([m[0] for m in made], np.int64).reshape(-1, SKETCH)
    columns = [ids, ns, lists(out), *[pa.array(words[:, i]) for i in range(SKETCH)], pa.array([m[1] for m in made], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["id", "n", "prefix", *[f"s{i}" for i in range(SKETCH)], "lost"])


def lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow column of lists of longs."""
    ends = np.cumsum([0, *(len(x) for x in parts)])
    values = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def text_sets(items: DataFrame, hashes: Hashes, percent: int, margin: int) -> DataFrame:
    """Per item (id, text): n, a 128-bit digest of its set, and its first shingles in hash order, margin percent or the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [hashes(t) for t in part["text"].to_pylist()]
                d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                early = [s[: max(needed(len(s), percent), -(-len(s) * margin // 100))].view(np.int64) for s in sets]
                columns = [part["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(d1), pa.array(d2), lists(early)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "d1", "d2", "early"])

    return items.select("id", "text").mapInArrow(run, "id long, n long, d1 long, d2 long, early array<long>")


def frequent_shingles(sets: DataFrame, at: int):
    """Early shingles of at least `at` sets with their counts, the FREQUENT most frequent, as a broadcast pair of sorted arrays."""
    counted = sets.select(F.explode("early").alias("token")).groupBy("token").count().where(F.col("count") >= at)
    top = settle(counted, "frequent").orderBy(F.desc("count"), "token").limit(FREQUENT).toPandas().sort_values("token")
    return sets.sparkSession.sparkContext.broadcast((top["token"].to_numpy(np.int64), top["count"].to_numpy(np.int64)))


def _ordered(s: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Shingles in the order (rare before frequent, frequent by count, then by hash), and how many are rare."""
    if not len(keys) or not len(s):
        return s, len(s)
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    often = np.where(keys[at] == s, counts[at], 0)
    return s[np.lexsort((s.view(np.uint64), often))], int((often == 0).sum())


def prefixes(sets: DataFrame, items: DataFrame, hashes: Hashes, percent: int, frequent) -> DataFrame:
    """Per set (id, n, early): id, n, prefix and its sketch; from the early shingles where they hold enough rare ones, else from the item's text."""

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = frequent.value
        for batch in batches:
            ns, column = batch["n"].to_numpy(), batch["early"]
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            out = []
            for i, n in enumerate(ns):
                s, rare = _ordered(values[ends[i] : ends[i + 1]], keys, counts)
                need = needed(int(n), percent)
                out.append(s[:need] if rare >= need or len(s) == n else s[:0])
            yield _prefix_batch(batch["id"], batch["n"], out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = frequent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [_ordered(hashes(t).view(np.int64), keys, counts)[0] for t in part["text"].to_pylist()]
                out = [s[: needed(len(s), percent)] for s in found]
                yield _prefix_batch(part["id"], pa.array([len(s) for s in found], pa.int64()), out)

    schema = "id long, n long, prefix array<long>, " + ", ".join(f"s{i} long" for i in range(SKETCH)) + ", lost int"
    first = settle(sets.mapInArrow(early, schema), "prefixes")
    late = settle(first.where("size(prefix) = 0").select("id"), "ids")
    rest = settle(keep_ids(items, late, "id").mapInArrow(whole, schema), "prefixes")
    discard(late)
    return first.where("size(prefix) > 0").union(rest)


def entries_of(prefixes: DataFrame) -> DataFrame:
    """One row per shingle of a prefix: token, id, n, pos and the sketch."""
    return prefixes.select("id", F.col("n").cast("int").alias("n"), *[f"s{i}" for i in range(SKETCH)], "lost", F.posexplode("prefix").alias("pos", "token"))


def bounds(percent: int) -> tuple[str, str, str, str]:
    """For sets with Jaccard at least percent: conditions on the sizes, on the places of a shared
    token and on the sketches of two entries a and b, and on an entry to be early: a set shares at
    least 2t/(1+t) of itself with a partner of its size or more, so one shared shingle lies among
    its first n - ceil(2t/(1+t) n) + 1. Each is necessary, so together they lose no pair."""
    t = percent / 100
    share = f"{t / (1 + t) - 1e-12!r}D"
    size = f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)"
    # what two sets can share at most, from the places of a token in both
    place = f"least(a.pos, b.pos) + least(a.n - a.pos, b.n - b.pos) >= ceil({share} * (a.n + b.n))"
    # beyond the prefixes a pair shares at most the longer rest, so the prefixes must share what is missing
    bits = " + ".join(f"bit_count(a.s{i} & b.s{i})" for i in range(SKETCH))
    sketched = f"{bits} + least(a.lost, b.lost) + floor(greatest(a.n, b.n) * {percent} / 100) >= ceil({share} * (a.n + b.n))"
    early = f"pos < n - ceil({share} * 2 * n) + 1"
    return size, place, sketched, early
