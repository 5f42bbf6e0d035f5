"""Operator 1: nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, settle

#: Tables, hash functions of a table, buckets a query visits in each table, and vectors per block of a bucket.
TABLES, FUNCTIONS, PROBES, BLOCK = 6, 7, 160, 4096
#: Vectors the widths are fitted on, at most.
FIT_ROWS = 4096
#: Growth from one width of a cell that is tried to the next, beginning with the median distance to
#: the 32nd neighbour among those, and the recall there that settles on one.
GROWTH, RECALL = 1.06, 0.95
#: Queries that one group of the comparison holds, about.
QUERIES = 50_000


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows whose vector is neither null, empty nor zero and has finite components only."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok & F.exists("v", lambda x: x != 0))


def probe_order(functions: int, limit: int) -> list[tuple[int, ...]]:
    """Perturbation sets over 2m places (nearest boundaries first) in the order of their estimated score.

    Place j of 1..2m stands for the j-th nearest boundary, with the expected squared distance of
    the j-th order statistic; sets with both sides of one function are left out by the caller's
    map of places. Sets grow by shift and expand from a heap.
    """
    m = functions
    z = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out, heap = [()], [(z[0], (1,))]
    while heap and len(out) < limit:
        score, s = heapq.heappop(heap)
        if all((2 * m + 1 - j) not in s for j in s):
            out.append(s)
        last = s[-1]
        if last < 2 * m:
            heapq.heappush(heap, (score - z[last - 1] + z[last], s[:-1] + (last + 1,)))
            heapq.heappush(heap, (score + z[last], s + (last + 1,)))
    return out


class PStable:
    """h(x) = floor((a . x + b) / w) with Gaussian a, for tables of several functions each.

    Inner product becomes distance by one more component: points are divided by the largest
    norm and filled up to length 1, queries are scaled to length 1 and filled with 0.
    """

    def __init__(self, dims: int, width: float, longest: float, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables * functions, dims + 1))
        self.b = rng.uniform(0, width, tables * functions)
        self.mult = rng.integers(1, 2**62, functions, np.int64) | 1
        self.width, self.longest, self.tables, self.functions = width, longest, tables, functions
        self.orders = probe_order(functions, probes)

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.hstack((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))))

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.hstack((x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))))

    def _cells(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.a.T + self.b) / self.width).reshape(len(x), self.tables, self.functions)

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.mult).sum(-1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket keys (points x tables)."""
        return self._keys(np.floor(self._cells(self.points(x))))

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Bucket keys (queries x tables x probes), each query's in the order of estimated success."""
        f = self._cells(self.queries(x))
        low = np.floor(f)
        gap = f - low
        both = np.concatenate((gap, 1 - gap), -1)  # to the lower, to the upper boundary
        rank = np.argsort(both, -1, kind="stable")
        out = np.empty((*f.shape[:2], len(self.orders)), np.int64)
        for k, places in enumerate(self.orders):
            cells = low.copy()
            for j in places:
                at = rank[..., j - 1]
                step = np.where(at < self.functions, -1.0, 1.0)
                np.put_along_axis(cells, (at % self.functions)[..., None], np.take_along_axis(cells, (at % self.functions)[..., None], -1) + step[..., None], -1)
            out[..., k] = self._keys(cells)
        return out


def fit(sample: np.ndarray, k: int, longest: float, tables: int, functions: int, probes: int, asked: int = 128) -> PStable:
    """The hashing of least width whose visited buckets hold RECALL of the sample's own k nearest. Widths grow until they do: in the end one bucket holds all."""
    dims = sample.shape[1]
    base = PStable(dims, 1.0, longest)
    x, q = base.points(sample), sample[:asked]
    far = np.sqrt(np.maximum(0, 2 - 2 * (base.queries(q) @ x.T)))
    unit = max(1e-9, float(np.median(np.sort(far, 1)[:, min(len(sample) - 1, 32)])))
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    true = np.argsort(-score, 1, kind="stable")[:, : max(1, min(k, len(sample) - 1))]
    width = unit
    while True:
        lsh = PStable(dims, width, longest, tables, functions, probes)
        buckets, visits = lsh.buckets(sample), lsh.probes(q)
        found = sum(any_table(buckets[true[i]], visits[i]).sum() for i in range(len(q)))
        if found >= RECALL * true.size:
            return lsh
        width *= GROWTH


def any_table(buckets: np.ndarray, visits: np.ndarray) -> np.ndarray:
    """Which points (rows x tables of buckets) a query meets in some table (tables x probes)."""
    return np.any([np.isin(buckets[:, t], visits[t]) for t in range(visits.shape[0])], axis=0)


def _matrix(col: pd.Series, dims: int) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.empty((0, dims))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """The k nearest rows of each query by inner product: (query_id, rank, id_col, score).

    Each table's buckets hold every distinct vector once; a query visits its own bucket and
    perturbed ones in the order of their estimated chance; candidates of all tables are merged
    and ranked by the exact inner product of the original vectors. Equal vectors share one entry
    with their k + 1 smallest ids, which is all that any answer can need; so do equal queries.
    Large buckets are split into blocks of about `block` vectors and queries into shares of about
    QUERIES, so that no group of the comparison grows with the input, and only k rows per query
    leave a group. A query that finds fewer than k takes the rest from a comparison with all
    blocks of vectors.

    Rows with a null id, or a vector that is null, empty, zero, of another length than most, or
    has null or non-finite components, take no part, as queries or candidates. A query's own row
    is not its candidate; ties go to the smaller id; ids that repeat count as one row with the
    smallest vector. Fewer than k candidates: all of them. Other columns are ignored.
    """
    with scratch():
        return _nearest(vectors, queries, k, id_col, vec_col, tables, functions, probes, block)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, tables: int, functions: int, probes: int, block: int) -> DataFrame:
    spark = vectors.sparkSession
    schema = f"query_id long, rank int, {id_col} long, score double"

    def distinct(df: DataFrame) -> DataFrame:
        return usable(df, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))

    base = distinct(vectors)
    lengths = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["d"]
    ids = F.slice(F.array_sort(F.collect_list("id")), 1, k + 1)

    # equal vectors: the k + 1 smallest ids of each task's share first, then of all
    def share(df: DataFrame) -> DataFrame:
        df = df.where(F.size("v") == dims).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
        small = df.groupBy("v", "part").agg(ids.alias("ids"))
        return small.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))

    points = settle(share(base).select(F.monotonically_increasing_id().alias("p"), "v", "ids"), "points")
    # equal queries are asked once, under the smallest of their ids
    own = distinct(queries).where(F.size("v") == dims)
    asked = settle(own.groupBy("v").agg(F.min("id").alias("q")), "queries")
    owners = settle(own.join(asked, "v").select("q", F.col("id").alias("query_id")), "owners", keep=True)
    n, shares = points.count(), max(1, -(-asked.count() // QUERIES))
    longest = points.select(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    sample = np.array([r["v"] for r in points.select("v").orderBy(F.xxhash64("v")).limit(FIT_ROWS).collect()])
    lsh = spark.sparkContext.broadcast(fit(sample, k, longest, tables, functions, probes))

    def to_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = lsh.value.buckets(_matrix(batch["v"], dims))
            t = keys.shape[1]
            yield pd.DataFrame({"p": np.repeat(batch["p"].to_numpy(), t), "t": np.tile(np.arange(t, dtype=np.int32), len(batch)), "bucket": keys.ravel()})

    def to_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = lsh.value.probes(_matrix(batch["v"], dims))
            per = keys.shape[1] * keys.shape[2]
            yield pd.DataFrame({"q": np.repeat(batch["q"].to_numpy(), per), "t": np.tile(np.repeat(np.arange(keys.shape[1], dtype=np.int32), keys.shape[2]), len(batch)), "bucket": keys.ravel()})

    member = settle(points.select("p", "v").mapInPandas(to_buckets, "p long, t int, bucket long"), "members")
    sizes = member.groupBy("t", "bucket").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    # small buckets share a cell, which is what one group of the comparison holds
    cells = max(1, -(-n // (16 * block)))
    cell = F.struct("t", F.pmod(F.xxhash64("t", "bucket", "s"), F.lit(cells)).alias("h"), "share")
    each = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    share_of = F.pmod(F.xxhash64(F.lit("share"), "q"), F.lit(shares)).cast("int").alias("share")
    member = member.join(sizes, ["t", "bucket"]).withColumn("s", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int"))
    member = member.select("t", "bucket", "s", "p", each).select(cell.alias("cell"), "bucket", "s", "p").join(points.select("p", "v"), "p")
    visits = asked.select("q", "v").mapInPandas(to_probes, "q long, t int, bucket long").join(sizes, ["t", "bucket"])
    visits = visits.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", share_of).select(cell.alias("cell"), "bucket", "s", "q")
    # a query goes to a cell once, with the buckets that it visits there
    visits = visits.groupBy("cell", "q").agg(F.collect_set(F.struct("bucket", "s")).alias("to")).join(asked.select("q", "v"), "q")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            groups = right.groupby(["bucket", "s"], sort=False).indices
            pv, pid = _matrix(right["v"], dims), right["p"].to_numpy()
            qv, qid = _matrix(left["v"], dims), left["q"].to_numpy()
            visited: dict[tuple, list[int]] = {}
            for i, to in enumerate(left["to"]):
                for x in to:
                    visited.setdefault((x["bucket"], x["s"]), []).append(i)
            for key, rows in visited.items():
                if (at := groups.get(key)) is not None:
                    out.append(_best(qv[rows], qid[rows], pv[at], pid[at], k + 1))
        return _top(out, k + 1)

    found = visits.groupBy("cell").cogroup(member.groupBy("cell")).applyInPandas(compare, "q long, p long, score double")
    # (the tables' products of one pair can differ in the last place)
    nearest_of = lambda f: f.groupBy("q", "p").agg(F.max("score").alias("score")).groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "p"))), 1, 2 * k + 2).alias("x")).select("q", F.explode("x").alias("x")).select("q", "x.p", (-F.col("x.far")).alias("score"))
    found = settle(nearest_of(found), "found")

    enough = found.join(points.select("p", F.size("ids").alias("c")), "p").groupBy("q").agg(F.sum("c").alias("c")).where(F.col("c") > k).select("q")
    short = asked.select("q", "v").join(enough, "q", "left_anti")
    if short.limit(1).count():
        # beyond the visited buckets: these queries against all vectors, in blocks
        b = max(1, -(-n // block))
        short = settle(short, "short").select("q", "v", share_of, F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("s"))
        blocks = points.select("p", "v", F.pmod(F.xxhash64("p"), F.lit(b)).cast("int").alias("s"), each)

        def whole(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return _top([_best(_matrix(left["v"], dims), left["q"].to_numpy(), _matrix(right["v"], dims), right["p"].to_numpy(), k + 1)] if len(left) and len(right) else [], k + 1)

        found = found.union(short.groupBy("s", "share").cogroup(blocks.groupBy("s", "share")).applyInPandas(whole, "q long, p long, score double"))

    # k + 1 groups of equal vectors are enough for a query, whichever of them holds its own row
    pairs = nearest_of(found).select("q", "p").join(points, "p").join(asked.select("q", F.col("v").alias("qv")), "q")

    @F.pandas_udf("double")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((_matrix(a, dims) * _matrix(b, dims)).sum(1))

    exact = pairs.select("q", "ids", product("v", "qv").alias("score"))
    ranked = exact.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "ids"))).alias("x"))
    flat = F.flatten(F.transform("x", lambda e: F.transform(e.ids, lambda i: F.struct(e.far.alias("far"), i.alias("id")))))
    ranked = settle(ranked.select("q", F.array_sort(flat).alias("x")), "ranked", keep=True).join(owners, "q").select("query_id", "x")
    mine = F.slice(F.filter("x", lambda e: e.id != F.col("query_id")), 1, k)
    ranked = ranked.select("query_id", F.posexplode(mine).alias("at", "e"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias(id_col), (-F.col("e.far")).alias("score"))


def _best(q: np.ndarray, qid: np.ndarray, p: np.ndarray, pid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, point ids, products) of the k largest inner products of each query, in slices of bounded size."""
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(q), 1024):
        tops: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(p), 8192):
            s = q[lo : lo + 1024] @ p[at : at + 8192].T
            take = np.argpartition(-s, k - 1, 1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            tops.append((np.take_along_axis(s, take, 1), pid[at : at + 8192][take]))
        score, ids = np.hstack([t[0] for t in tops]), np.hstack([t[1] for t in tops])
        order = np.argsort(-score, 1, kind="stable")[:, :k]
        out.append((np.repeat(qid[lo : lo + 1024], order.shape[1]), np.take_along_axis(ids, order, 1).ravel(), np.take_along_axis(score, order, 1).ravel()))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _top(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """The k largest of each query over several parts that share no point."""
    if not parts:
        return pd.DataFrame({"q": np.empty(0, np.int64), "p": np.empty(0, np.int64), "score": np.empty(0)})
    q, p, score = (np.concatenate([x[i] for x in parts]) for i in range(3))
    order = np.lexsort((-score, q))
    q, p, score = q[order], p[order], score[order]
    start = np.concatenate(([True], q[1:] != q[:-1]))
    first = np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - first < k
    return pd.DataFrame({"q": q[keep], "p": p[keep], "score": score[keep]})
