"""The registered opN_<name> queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat_format import TRAP, chat_digests, format_chats
from .common import work_dir
from .decontaminate import contamination
from .html_text import extract_text
from .jaccard_join import jaccard_groups
from .language_id import identify_languages
from .line_dedup import dedup_lines
from .pii import pseudonymise
from .sentencepiece_bpe import encode_documents
from .token_rollup import RollupStore, bpe_counter, facts, revised, signed, word_count


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, by inner product."""
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge-dropout ids of every document, and whether they decode to its text."""
    return encode_documents(_read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(_read(spark, sf_dir, "pages"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    return pseudonymise(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents and the line kept for it."""
    return dedup_lines(_read(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents: word counts, BPE counts, and a revision of the
    word counts by a newer version of their tokenizer; the last batch is delivered twice."""
    docs = _read(spark, sf_dir, "documents").select("source", "lang", "text")
    store = RollupStore(spark, f"{work_dir(spark)}/rollup-{uuid4().hex}")
    words = facts(docs, "words-1", F.size(F.split("text", " ")))
    store.commit("load-words", signed(words, 1))
    store.commit("load-bpe", signed(facts(docs, "byte_bpe_50k", bpe_counter(spark)(F.col("text"))), 1))
    revision = revised(words, facts(docs, "words-2", word_count(F.col("text"))))
    store.commit("revise-words", revision)
    store.commit("revise-words", revision)
    return store.totals()


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return identify_languages(_read(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at Jaccard 0.85 of 4-word shingles."""
    return jaccard_groups(_read(spark, sf_dir, "documents"), shingle=4, percent=85)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 formatted, and digests of the output read back."""
    chats = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], chats.schema)
    return chat_digests(format_chats(chats.unionByName(trap)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of benchmark items."""
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_html_extraction": op3_html_extraction,
    "op4_surrogates": op4_surrogates,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_rollup": op6_token_rollup,
    "op7_language_id": op7_language_id,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_decontamination": op10_decontamination,
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = "replace(replace(replace(text, '\\', '\\s'), '###', '\\h'), '</turn>', '\\t')"
_LABEL = "CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE CASE WHEN role IN ('System', 'User', 'Assistant') THEN '\\r' ELSE '' END || replace(replace(replace(replace(role, '\\', '\\s'), '###', '\\h'), '</turn>', '\\t'), ': ', '\\c') END"

#: DuckDB SQL for the operators whose results SQL can state.
ORACLE_SQL: dict[str, str] = {
    "op8_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END AS g FROM w),
        s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(g) AS g FROM g)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.id)
        SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id""",
    "op9_chat_formatting": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-7, 0, 'user', '{TRAP}'), (-7, 1, 'assistant', '{TRAP}')),
        f AS (SELECT *, '### ' || {_LABEL} || ': ' || {_ESCAPED} || '</turn>' || chr(10) AS piece FROM c),
        g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars,
          string_agg(role, ',' ORDER BY turn, role, text) AS roles FROM f GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
          regexp_full_match(roles, '(system,)?user(,assistant,user)*(,assistant)?') AS valid FROM g""",
    "op10_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all({_LOW.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        l AS (SELECT item, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
        x AS (SELECT DISTINCT item, size, v FROM (SELECT item, size, unnest(list_transform(range(1, len(w) - size + 2), lambda s: array_to_string(w[s : s + size - 1], ' '))) AS v FROM l)),
        p AS (SELECT k, size, unnest(range(1, len(w) - size + 2)) AS s, unnest(list_transform(range(1, len(w) - size + 2), lambda s: array_to_string(w[s : s + size - 1], ' '))) AS v FROM d, (SELECT DISTINCT size FROM x) WHERE len(w) >= size),
        h AS (SELECT k, s, p.size, item FROM p JOIN x ON x.v = p.v AND x.size = p.size),
        a AS (SELECT k, count(DISTINCT spot) AS n FROM (SELECT k, unnest(range(s, s + size)) AS spot FROM h) GROUP BY k),
        t AS (SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
        SELECT doc_id, len(w) AS n_words, coalesce(a.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, t.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN a USING (k) LEFT JOIN t USING (k)""",
}
