"""Operator 8: similarity groups of documents by the Jaccard measure of their word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefix
from .common import bound_batches, components, discard, keep_ids, scratch, settle
from .linking import Texts, link, shared_entries
from .shingles import WordShingles


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85, margin: int = 25, frequent_at: int = 8) -> DataFrame:
    """One row per document id: (id_col, n_shingles, component_id), a written table.

    Two documents link when 100 * intersection >= percent * union of their sets of
    distinct word shingles (lower-cased A-Z, words parted by ASCII white space; a text of
    fewer words is one shingle). Grouped prefix join: equal sets become one class, classes
    with the same prefix and size one group; groups meet on prefix shingles under length
    and positional bounds, then members are expanded and verified on the shingles of their own
    texts. Shingles are compared by 64-bit hashes (see shingles.WordShingles for the odds of a
    collision), equal sets by the sum and the exclusive or of theirs.

    Null, empty and blank texts have no shingles and link with nothing. Rows with a null id
    are left out; rows that repeat an id count as one document, whose text is the smallest.
    Other columns are ignored. An empty table gives an empty result.
    """
    bound_batches(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    if docs.groupBy("id").count().where("count > 1").limit(1).count():
        docs = docs.groupBy("id").agg(F.min("text").alias("text"))
    with scratch():
        return settle(_groups(docs, WordShingles(shingle), percent, margin, frequent_at).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id")), "groups", keep=True)


def _groups(docs: DataFrame, kind: WordShingles, percent: int, margin: int, frequent_at: int) -> DataFrame:
    """(id, n, comp) of documents (id, text); comp is null for those without a link."""
    whole = settle(prefix.text_sets(docs, kind.of, percent, margin), "sets")
    frequent = prefix.frequent_shingles(whole, frequent_at)
    sets = settle(whole.drop("early"), "sizes")
    classes = settle(sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    several = sets.where("n > 0").join(classes.where("copies > 1").select("n", "d1", "d2", F.col("id").alias("rep")), ["n", "d1", "d2"]).select("id", "rep")
    several = settle(several.where("id <> rep"), "copies")
    discard(classes)
    prefixes = prefix.prefixes(keep_ids(whole.where("n > 0").select("id", "n", "early"), several.select("id"), "id", "left_anti"), docs, kind.of, percent, frequent)
    discard(whole)

    keyed = prefixes.select("id", "n", F.xxhash64("prefix").alias("k1"), F.hash("prefix").alias("k2"))
    grouped = keyed.groupBy("n", "k1", "k2").agg(F.min("id").alias("group"), F.count("*").alias("k")).where("k > 1")
    members = settle(keyed.join(grouped, ["n", "k1", "k2"]).select("group", "id"), "members")
    inner = members.where("group <> id")
    heads = keep_ids(prefixes, settle(inner.select("id"), "ids"), "id", "left_anti")
    entries = shared_entries(prefix.entries_of(heads))
    # members of a group share one more token, which no other group has
    own = prefix.entries_of(keep_ids(prefixes, members.select("id"), "id")).where("pos = 0").drop("token").join(members, "id")
    own = own.withColumn("token", F.xxhash64(F.lit("group"), "group")).select(*entries.columns)
    expand = members.union(heads.select(F.col("id").alias("group"), "id").join(members.select("id"), "id", "left_anti").select("group", "id"))

    size, place, sketched, early = prefix.bounds(percent)
    links = link(
        entries,
        Texts(lambda ids: settle(keep_ids(docs, ids, "id"), "texts"), kind, percent),
        "pos",
        admit=f"({size}) and ({place}) and ({sketched})",
        early=early,
        star_admit=f"({size}) and ({place})",
        more=inner.select(F.col("group").alias("a"), F.col("id").alias("b")),
        expand=expand,
        grouped=own,
        frequent=frequent,
    )
    edges = links.union(several.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    return sets.select("id", "n").join(components(edges), "id", "left")
