"""Operator 5: near-duplicate lines by MinHash, one line kept of each component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, discard, free_name, keep_ids, may_broadcast, scratch, settle
from .linking import Texts, link, shared_entries
from .shingles import CharShingles, mix

#: Characters of a shingle, bands, hash values of a band, and the Jaccard measure (percent) from which lines are near duplicates.
SHINGLE, BANDS, ROWS, PERCENT = 8, 6, 3, 80


def normal(line: str) -> str:
    """Lower case, white space runs as one space, trimmed: what lines are compared by."""
    return " ".join(line.lower().split())


def signatures(lines: list[str], k: int, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """Band keys (len(lines) x bands, 64 bits) of non-empty normal lines, from bands*rows minima over their shingles."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 2**31, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
    b = rng.integers(0, 2**32, bands * rows, np.uint64).astype(np.uint32)
    sizes = np.array([len(x) for x in lines])
    c = np.frombuffer("".join(x + "\0" * (k - 1) for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    width, h, p = 1, c, np.uint32(0x01000193)
    bit, out = 1, None
    skip = 0
    while bit <= k:  # the hash of k characters from hashes of 1, 2, 4 ... characters
        if k & bit:
            part = h[skip:]
            if out is None:
                out = part
            else:
                n = min(len(out), len(part))
                out = out[:n] * np.uint32(pow(int(p), width, 2**32)) + part[:n]
            skip += bit
        n = len(h) - width
        h = h[:n] * np.uint32(pow(int(p), width, 2**32)) + h[width:] if n > 0 else h[:0]
        width, bit = width * 2, bit * 2
    starts = np.concatenate(([0], np.cumsum(sizes + k - 1)[:-1]))
    # the shingles of a line begin in [start, end); what lies between belongs to the padding
    spans = np.empty(2 * len(lines), np.int64)
    spans[::2], spans[1::2] = starts, starts + np.maximum(1, sizes - k + 1)
    h = np.concatenate((out, np.zeros(k, np.uint32)))
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    keys, x = np.empty((len(lines), bands), np.uint64), np.empty_like(h)
    for band in range(bands):
        key = np.full(len(lines), band + 1, np.uint64)
        for j in range(band * rows, band * rows + rows):
            np.multiply(h, a[j], out=x)
            np.add(x, b[j], out=x)
            key = mix(key * np.uint64(31) + np.minimum.reduceat(x, spans)[::2].astype(np.uint64))
        keys[:, band] = key
    return keys


def signed_lines(docs: DataFrame, shingle: int, bands: int, rows: int, chars: int = 1 << 18) -> DataFrame:
    """Each non-blank line: doc_id, line_no (from 0), a 128-bit digest of its normal form, its band keys b0, b1, ..."""
    names = [f"b{i}" for i in range(bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            digests = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in texts]
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            keys = signatures(texts, shingle, bands, rows).view(np.int64)
            columns = [pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1]), *[pa.array(keys[:, i]) for i in range(bands)]]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "line_no", "d1", "d2", *names])

        texts, ids, places, size = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                for place, line in enumerate(text.as_py().split("\n")):
                    line = normal(line)
                    if line:
                        texts.append(line)
                        ids.append(doc)
                        places.append(place)
                        size += len(line)
                        if size >= chars:
                            yield flush()
                            texts, ids, places, size = [], [], [], 0
        if texts:
            yield flush()

    rows_ = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return rows_.mapInArrow(run, "doc_id long, line_no int, d1 long, d2 long, " + ", ".join(f"{n} long" for n in names))


def _texts(docs: DataFrame, needed: DataFrame, sets: CharShingles) -> DataFrame:
    """(id, text, n): the normal lines of classes needed (id, doc_id, line_no, d1, d2; a written table) and the sizes of their sets, a written table."""
    side = F.broadcast if may_broadcast(needed) else lambda x: x
    lines = docs.join(side(needed.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    texts = lines.join(side(needed), ["doc_id", "line_no"])

    def normal_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [normal(x) for x in batch["line"].to_pylist()]
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in made), np.int64).reshape(-1, 2)
            # rows that repeat a doc_id with another text have other digests
            own = np.flatnonzero((d[:, 0] == batch["d1"].to_numpy()) & (d[:, 1] == batch["d2"].to_numpy()))
            made = [made[i] for i in own.tolist()]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(own)), pa.array(made, pa.string()), pa.array(sets.sizes(made), pa.int64())], ["id", "text", "n"])

    return settle(texts.select("id", "d1", "d2", "line").mapInArrow(normal_lines, "id long, text string, n long").dropDuplicates(["id"]), "lines")


def _places(lines: DataFrame) -> tuple[str, str, str]:
    """SQL of a value that orders lines by (doc_id, line_no), and of both read back from such a value named x.

    A long where the ids have 32 bits or less, as its minimum needs no sort; else a struct.
    """
    least, most = lines.agg(F.min("doc_id"), F.max("doc_id")).first()
    if least is not None and -(2**32) <= least and most < 2**32:
        return f"doc_id * {2**31}L + line_no", "shiftright(x, 31)", f"cast(x & {2**31 - 1}L as int)"
    return "struct(doc_id, line_no)", "x.doc_id", "x.line_no"


def line_classes(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines, duplicates): all non-blank lines (doc_id, line_no, d1, d2), and those classes
    (d1, d2, keep_doc_id, keep_line_no) of which more than one line exists. Written tables; keep: they outlive the innermost scratch."""
    bound_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = settle(signed_lines(docs, shingle, bands, rows), "lines", keep)
    keys = [f"b{i}" for i in range(bands)]
    place, doc_id, line_no = _places(lines)
    first = lines.groupBy("d1", "d2").agg(F.min(F.expr(place)).alias("x"), F.count("*").alias("copies"), *[F.min(k).alias(k) for k in keys])
    classes = settle(first.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", F.expr(doc_id).alias("doc_id"), F.expr(line_no).alias("line_no"), "copies", *keys), "classes")
    # the centre of a star is the line with most copies: edits are made of it
    entries = shared_entries(classes.select("id", (-F.col("copies")).alias("rank"), F.explode(F.array(*keys)).alias("token")))
    banded = settle(entries.select("id").distinct(), "ids")
    needed = settle(keep_ids(classes.select("id", "doc_id", "line_no", "d1", "d2"), banded, "id"), "needed")
    texts = _texts(docs, needed, CharShingles(shingle))
    sized = settle(entries.join(texts.select("id", "n"), "id"), "entries")
    discard(entries, banded, needed)
    size = f"100 * (least(a.n, b.n) + 1) >= {percent} * greatest(a.n, b.n)"
    fetch = lambda ids: texts.join(F.broadcast(ids), "id", "left_semi") if may_broadcast(ids) else texts
    links = link(sized, Texts(fetch, CharShingles(shingle), percent, passing=False), "rank", admit=size, star_admit=size)
    comp = settle(components(links), "comp")
    discard(sized, texts)
    linked = classes.select("id", "d1", "d2", "doc_id", "line_no").join(comp, "id")
    least = linked.groupBy("comp").agg(F.min(F.struct("doc_id", "line_no")).alias("keep"))
    near = linked.join(least, "comp").select("id", "d1", "d2", "keep")
    exact = classes.where("copies > 1").join(near.select("id"), "id", "left_anti").select("id", "d1", "d2", F.struct("doc_id", "line_no").alias("keep"))
    found = near.union(exact).select("d1", "d2", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"))
    found = settle(found, "found", keep)
    discard(classes)
    return lines.select("doc_id", "line_no", "d1", "d2"), found


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """One row per non-blank line: doc_id, line_no (from 0), keep_doc_id, keep_line_no, kept.

    Lines are compared in lower case with white space as one space. Character-shingle MinHash
    signatures are banded for recall; pairs that share a band are checked by exact Jaccard;
    components come from distributed union-find. Of each component the line with the
    smallest (doc_id, line_no) is kept: that of keep_doc_id and keep_line_no.

    Blank lines and null texts have no rows and are never duplicates; rows with a null doc_id
    are left out; other columns are ignored. Rows that repeat a doc_id with the same text
    repeat their lines. Lines of any length are read whole. No documents: no rows.
    """
    with scratch():
        lines, found = line_classes(docs, keep=True, **options)
    out = lines.join(found, ["d1", "d2"], "left")
    keep = [F.coalesce(f"keep_{c}", c).alias(f"keep_{c}") for c in ("doc_id", "line_no")]
    return out.select("doc_id", "line_no", *keep).withColumn("kept", F.expr("doc_id = keep_doc_id and line_no = keep_line_no"))


def drop_duplicate_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without the lines that dedup_lines does not keep; documents left without a word go.

    Documents that had no word before stay as they are, as do rows with a null doc_id. Of rows
    that repeat a doc_id and a text, each keeps its kept lines. All columns keep their values
    but text, whatever their names.
    """
    with scratch():
        lines, found = line_classes(docs, **options)
        gone = lines.join(found, ["d1", "d2"]).where("doc_id <> keep_doc_id or line_no <> keep_line_no").select("doc_id", "line_no").distinct()
        lost = settle(gone, "lost", keep=True)
    dropped, left, key = (free_name(n, docs) for n in ("__gone", "__left", "__key"))
    few = may_broadcast(lost)  # then so is its grouping, which is smaller
    gone = lost.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("line_no").alias(dropped))
    out = docs.join(F.broadcast(gone) if few else gone, F.col(key) == docs["doc_id"].cast("long"), "left")
    rest = F.array_join(F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: ~F.array_contains(F.col(dropped), p.i)), lambda p: p.x), "\n")
    out = out.withColumn(left, F.when(F.col(dropped).isNull(), F.col("text")).otherwise(rest))
    out = out.where(F.col(dropped).isNull() | F.col(left).rlike("\\S"))
    return out.select(*[F.col(left).alias("text") if c == "text" else F.col(c) for c in docs.columns])
