"""Components of similar texts from an inverted index, without all pairs of a group.

1. A round of stars links the entries of a token to one centre.
2. What is still apart in a token is compared with one centre of the token's largest component.
   A text near its centre is then held as its difference from it (shingles added, shingles
   removed). The symmetric difference of two texts is that of their differences, so of two texts
   with one centre, not both linked to it, the differences must overlap: a prefix join on
   differences finds every such pair. Copies that were edited independently share no additions,
   so they meet in no pair, however many they are. Before that join a round of stars on the tokens
   of differences links those that went the same way, so that the join lists no pairs among them.
3. Texts with different centres, or none near, are paired by their tokens.
Every pair is verified, and none that could hold is left out by steps 2 and 3. The marks of sets
(shingles.marks), known from the first comparisons, leave out pairs that differ in too many places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, keep_ids, settle
from .shingles import MARKS, Sets, marks

#: Percent of Jaccard similarity from which a text counts as near its centre.
NEAR = 20

_MARKS = [f"m{i}" for i in range(MARKS)]
_CENTRE = [f"c{i}" for i in range(MARKS)]


def apart(percent: int, slack: int = 0) -> str:
    """The condition on structs a and b that their sets differ in more shingles than a link of at least percent allows; slack: by how much both sizes together can be short."""
    differ = " + ".join(f"bit_count(a.{m} ^ b.{m})" for m in _MARKS)
    return f"coalesce({differ} > floor({100 - percent} * (a.n + b.n + {slack}) / {100 + percent}), false)"


def shared_entries(entries: DataFrame) -> DataFrame:
    """Entries whose token has more than one, as a written table. Counts are summed before they are shuffled, so that a token may have any share of all entries."""
    several = settle(entries.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "tokens")
    out = settle(keep_ids(entries, several, "token"), "entries")
    discard(several)
    return out


@dataclass
class Texts:
    """Texts by id, how their sets are made, and the percent of Jaccard similarity that links two."""

    fetch: Callable[[DataFrame], DataFrame]  # ids (id) -> (id, text) of at least those, a written table if passing
    sets: Sets
    percent: int
    passing: bool = True  # whether fetch writes a table for one use

    def _compared(self, pairs: DataFrame, compare: Callable, schema: str, name: str) -> DataFrame:
        """compare over (a, b, ta, tb), each task's rows by a where the join sorts; a written table."""
        ids = settle(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
        texts = self.fetch(ids)
        joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        joined = joined.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
        out = settle(joined.mapInPandas(compare, schema), name)
        discard(ids, *[texts] * self.passing)
        return out

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with linked, near (at least NEAR percent) and the marks of b, a written table."""
        sets, percent = self.sets, self.percent

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, sa = None, None
            for batch in batches:
                linked, near, places = [], [], []
                for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"], strict=True):
                    if a != last:
                        last, sa = a, sets.of(ta)
                    sb = sets.of(tb)
                    both = sets.common(sa, sb)
                    union = len(sa) + len(sb) - both
                    linked.append(both > 0 and 100 * both >= percent * union)
                    near.append(both > 0 and 100 * both >= NEAR * union)
                    places.append(marks(sb))
                columns = np.array(places, np.int64).reshape(-1, MARKS)
                yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": linked, "near": near, **{m: columns[:, i] for i, m in enumerate(_MARKS)}})

        return self._compared(pairs, run, f"a long, b long, linked boolean, near boolean, {' long, '.join(_MARKS)} long", "compared")

    def differences(self, pairs: DataFrame, frequent=None) -> DataFrame:
        """For pairs (a: centre, b: text): id, centre, n (size of its set), m (of its difference), like (the Jaccard measure), linked, near, prefix and the marks of its set and the centre's, a written table.

        prefix has as many tokens of the difference as a partner can lack, and one more: first
        what the text adds, by rarity (frequent: a broadcast of keys and counts), then what it lacks.
        """
        sets, percent = self.sets, self.percent

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, sa, ma = None, None, []
            keys, counts = frequent.value if frequent is not None else (np.empty(0, np.int64), np.empty(0, np.int64))
            for batch in batches:
                rows = []
                for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                    if a != last:
                        last, sa = a, sets.of(ta)
                        ma = marks(sa).tolist()
                    sb = sets.of(tb)
                    both = sets.common(sa, sb)
                    union = len(sa) + len(sb) - both
                    near = 100 * both >= NEAR * union
                    prefix = np.empty(0, np.int64)
                    if near:
                        added, removed = sets.difference(sa, sb)
                        often = np.zeros(len(added), np.int64)
                        if len(keys) and len(added):
                            at = np.minimum(np.searchsorted(keys, added), len(keys) - 1)
                            often = np.where(keys[at] == added, counts[at], 0)
                        prefix = np.concatenate((added[np.lexsort((added, often))], ~np.sort(removed)))[: len(sb) * (100 - percent) // percent + 1]
                    rows.append((b, a, len(sb), union - both, both / union if union else 0.0, both > 0 and 100 * both >= percent * union, near, prefix, *marks(sb).tolist(), *ma))
                yield pd.DataFrame(rows, columns=["id", "centre", "n", "m", "like", "linked", "near", "prefix", *_MARKS, *_CENTRE])

        return self._compared(pairs, run, f"id long, centre long, n long, m long, like double, linked boolean, near boolean, prefix array<long>, {' long, '.join(_MARKS + _CENTRE)} long", "diffs")


def _row(entries: DataFrame, *first: str):
    """An entry without its token as a struct, the given columns first."""
    return F.struct(*first, *[c for c in entries.columns if c not in ("token", *first)])


def star_pairs(entries: DataFrame, rank: str, admit: str) -> DataFrame:
    """(a, b): a the centre of a token, which has the smallest (rank column, id), b each other id that admit lets through."""
    first = entries.groupBy("token").agg(F.min(_row(entries, rank, "id")).alias("a"))
    joined = entries.select("token", _row(entries, "id").alias("b")).join(first, "token")
    return joined.where("a.id <> b.id").where(admit).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def open_entries(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """Entries of tokens that lie in several components, with comp and the token's largest one as main; a written table."""
    e = entries.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    sizes = e.groupBy("token", "comp").agg(F.count("*").alias("n"))
    top = sizes.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("k")).where("k > 1")
    return settle(e.join(top.select("token", F.col("top.comp").alias("main")), "token"), "open")


def centres(e: DataFrame, rank: str) -> DataFrame:
    """(a, b, fits): for each id b of open entries the centre of the component that most of its tokens have as main, and whether their sizes let them be near.

    A component's centre is what has the smallest (rank, id) of it in most tokens.
    """
    first = e.where("comp = main").groupBy("token", "main").agg(F.min(F.struct(rank, "id", "n")).alias("x"))
    hub = first.groupBy("main", "x.id", "x.n").agg(F.count("*").alias("k")).groupBy("main").agg(F.max(F.struct("k", "id", "n")).alias("h"))
    votes = e.groupBy("id", "n", "main").agg(F.count("*").alias("k")).groupBy("id", "n").agg(F.max(F.struct("k", "main")).alias("v"))
    joined = votes.select("id", "n", "v.main").join(hub, "main").where("h.id <> id")
    return joined.select(F.col("h.id").alias("a"), F.col("id").alias("b"), F.expr(f"100 * least(h.n, n) >= {NEAR} * greatest(h.n, n)").alias("fits"))


def near_entries(diffs: DataFrame) -> DataFrame:
    """(centre, token, pos, id, n, m, linked, marks) of the prefixes of texts near a centre, where a centre's token has several, not all of them linked to it; a written table.

    Most tokens of a difference are its own, so they are counted before anything else of their entries moves.
    """
    e = diffs.where("near").select("centre", "id", "n", "m", "linked", *_MARKS, F.posexplode("prefix").alias("pos", "token"))
    counted = e.groupBy("centre", "token").agg(F.count("*").alias("k"), F.sum(F.expr("cast(linked as int)")).alias("l"))
    several = settle(counted.where("k > 1 and l < k").select("centre", "token"), "tokens")
    out = settle(keep_ids(e, several, ["centre", "token"]), "near")
    discard(several)
    return out


def _near_rule(percent: int) -> str:
    """The condition on structs a and b of two entries of a centre's token that they may link and lie in different components."""
    return f"a.id <> b.id and a.comp <> b.comp and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) and not {apart(percent)}"


def _pairs(joined: DataFrame, rule: str) -> DataFrame:
    return joined.where(rule).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def near_stars(e: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: of near entries that may link, those with one that is not linked to its centre, the same for all of a token.

    Texts that went the same way from their centre are linked by these, and what is left for near_pairs are pairs of different ways.
    """
    e = e.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    row = F.struct("id", "n", "comp", *_MARKS)
    first = e.where("not linked").groupBy("centre", "token").agg(F.min(row).alias("a"))
    return _pairs(e.select("centre", "token", row.alias("b")).join(first, ["centre", "token"]), _near_rule(percent)).distinct()


def near_pairs(e: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: all that may link of near entries in different components.

    The first token that two differences share comes after places p and q with p + q at most the
    symmetric difference allowed, so one of the two has it early; and of two texts that are both
    linked to the centre nothing is asked.
    """
    e = e.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    early = f"{2 * percent} * pos <= {100 - percent} * n"
    row = F.struct("id", "n", "m", "linked", "comp", "pos", *_MARKS)
    side = lambda part, name: part.select("centre", "token", row.alias(name))
    first = e.where(early)
    one = side(first.where("not linked"), "a").join(side(e, "b"), ["centre", "token"])
    two = side(e.where(f"not linked and not ({early})"), "a").join(side(first.where("linked"), "b"), ["centre", "token"])
    allowed = f"floor({100 - percent} * (a.n + b.n) / {100 + percent})"
    needed = f"ceil((a.m + b.m - {allowed}) / 2)"
    rule = f"{_near_rule(percent)} and least(a.m - a.pos, b.m - b.pos) >= {needed} and a.pos + b.pos <= {allowed}"
    return _pairs(one, rule).union(_pairs(two, rule)).distinct()


def far_pairs(e: DataFrame, near: DataFrame, likes: DataFrame, percent: int, early: str, admit: str) -> DataFrame:
    """(a, b), a < b, of one token, in different components and not near the same centre; near: (id, centre).

    likes: (id, hub, low, high, marks of the set or nulls), bounds on the Jaccard measure of an id
    and a hub. The distance that belongs to it is a metric, so two texts whose measures with one
    hub are further apart than a link allows cannot link.

    early: the condition on an entry to lie in the first part of its prefix that a partner of at
    least its size must share, so that one side of a pair is an early entry of the smaller set.
    """
    e = e.drop("main").join(near, "id", "left").withColumn("kin", F.struct(F.col("centre").isNotNull().alias("near"), F.coalesce("centre", "comp").alias("of"))).drop("centre")
    sizes = e.groupBy("token", "kin").agg(F.count("*").alias("k"))
    top = sizes.groupBy("token").agg(F.max(F.struct("k", "kin")).alias("top"), F.count("*").alias("k")).where("k > 1").select("token", F.col("top.kin").alias("most"))
    e = settle(e.join(top, "token").join(likes, "id", "left"), "far")
    row = F.struct(*[c for c in e.columns if c != "token"])
    side = lambda part, name: part.select("token", row.alias(name))
    first = e.where(early)
    far = f"coalesce(a.hub = b.hub and greatest(a.low - b.high, b.low - a.high) > {(100 - percent) / 100 + 1e-9!r}D, false)"
    rule = f"a.comp <> b.comp and a.kin <> b.kin and ({admit}) and not {far} and not {apart(percent, 2)}"
    one = side(first.where("kin <> most"), "a").join(side(e, "b"), "token")
    if early == "true":  # then a token's main kin only has to be on one side
        both = one.where(f"{rule} and (b.kin = b.most or a.id < b.id)")
    else:
        two = side(first.where("kin = most"), "a").join(side(e.where("kin <> most"), "b"), "token")
        both = one.union(two).where(f"{rule} and (a.n < b.n or a.n = b.n and a.id < b.id)")
    return both.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def link(entries: DataFrame, texts: Texts, rank: str, admit: str = "true", early: str = "true", star_admit: str = "true", more: DataFrame | None = None, expand: DataFrame | None = None, grouped: DataFrame | None = None, frequent=None) -> DataFrame:
    """Links (a, b) that span the components of texts of which two share a token.

    entries: (token, id, n, ...), one row each, n the size of the id's set; rank: the column by which a centre is chosen; admit
    and star_admit: conditions on the structs a and b of two entries of a token, the latter for
    stars; early: see far_pairs; more: further pairs for the stars; expand: (group, id) if an
    entry's id stands for a group of ids: what follows the stars sees every member, and as
    grouped further entries that members of a group share; frequent: see Texts.differences.
    """
    pairs = star_pairs(entries, rank, star_admit)
    pairs = settle(pairs if more is None else pairs.union(more).distinct(), "pairs")
    compared = texts.compare(pairs)
    discard(pairs)
    links = compared.where("linked").select("a", "b")
    comp = settle(components(links), "comp")
    if expand is not None:
        entries = entries.withColumnRenamed("id", "group").join(expand, "group").select(*entries.columns).unionByName(grouped)
    rest = open_entries(entries, comp)
    tried = settle(compared.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("near").alias("close"), F.max(F.struct("b", *_MARKS)).alias("of")), "tried")
    # what was compared with its centre and is not near it needs no second look
    hubs = centres(rest, rank).withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(tried, ["x", "y"], "left")
    hubs = settle(hubs.select("a", "b", F.expr("fits and coalesce(close, true)").alias("open"), *[F.expr(f"case when of.b = b then of.{m} end").alias(m) for m in _MARKS]), "centres")
    diffs = texts.differences(hubs.where("open").select("a", "b"), frequent)
    likes = diffs.select("id", F.col("centre").alias("hub"), F.col("like").alias("low"), F.col("like").alias("high"), *_MARKS)
    likes = likes.union(hubs.where("not open").select(F.col("b").alias("id"), F.col("a").alias("hub"), F.lit(0.0).alias("low"), F.lit(NEAR / 100).alias("high"), *_MARKS))
    own = diffs.groupBy(F.col("centre").alias("id")).agg(*[F.first(c).alias(c) for c in _CENTRE]).join(likes.select("id"), "id", "left_anti")
    likes = likes.union(own.select("id", *[F.lit(None).cast(k).alias(c) for c, k in (("hub", "long"), ("low", "double"), ("high", "double"))], *_CENTRE))
    links = links.union(diffs.where("linked").select(F.col("centre").alias("a"), F.col("id").alias("b")))
    # a centre is near itself
    kin = diffs.where("near").select("id", "centre")
    kin = kin.union(diffs.select(F.col("centre").alias("id"), "centre").distinct().join(kin.select("id"), "id", "left_anti"))
    near, e = near_entries(diffs), rest
    stars = settle(near_stars(near, comp, texts.percent).join(tried.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti"), "pairs")
    if stars.count():
        alike = texts.compare(stars).where("linked").select("a", "b")
        links = links.union(alike)
        tried = tried.select("x", "y").union(stars.select("a", "b"))
        comp = settle(components(links), "comp")
        e = rest.drop("comp").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    found = near_pairs(near, comp, texts.percent).union(far_pairs(e, kin, likes, texts.percent, early, admit))
    last = settle(found.distinct().join(tried.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti"), "pairs")
    discard(rest, near)
    return links.union(texts.compare(last).where("linked").select("a", "b")) if last.limit(1).count() else links
