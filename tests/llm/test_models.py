"""Language ID, SentencePiece, neighbours, chats, rollups, surrogates and page texts."""

import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm.ann import nearest, probe_order
from quarry.llm.chat_format import TRAP, chat_digests, format_chats, parse_chats
from quarry.llm.html_text import MAIN, blocks_of, extract_text, repeated
from quarry.llm.language_id import Encoder, identify_languages
from quarry.llm.pii import PATTERNS, pseudonymise, with_surrogates
from quarry.llm.sentencepiece_bpe import SCAN, MergeEncoder, encode_documents, load_pieces
from quarry.llm.token_rollup import RollupStore, facts, revised, signed, word_count

from .test_text_operators import prose

LANGS = {"en": "the and of to in that was for with this", "de": "der die und das nicht mit für sich über eine", "fr": "le la et les des une être avec dans où", "es": "el los que una por para año está más como"}


def sentence(lang, seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(LANGS[lang].split(), n))


# --- language ID -------------------------------------------------------------------------------------------------------


def test_language_id_learns_and_holds_out(spark):
    rows = [(i, sentence(lang, i, 40), lang) for i in range(60) for lang in [list(LANGS)[i % 4]]]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (1002, sentence("fr", 5, 9000), "fr"), (1003, sentence("de", 7, 30), None)]
    df = spark.createDataFrame([(a, b, c, 0.5) for a, b, c in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in identify_languages(df).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i]["score"] <= 1
        assert got[i]["lang_pred"] == ("und" if i in (1000, 1001) else lang or "de")


def test_language_id_of_nothing(spark):
    assert identify_languages(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert identify_languages(df).first()["lang_pred"] == "und"


def test_trigram_vectors_bind_permuted_letters():
    enc = Encoder(dims=64, seed=1)
    v = enc.encode("ab")
    a, b, s = (enc.letter(ord(c)).astype(float) for c in "ab ")
    total = np.roll(s, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * s
    assert np.allclose(v, total / np.linalg.norm(total))


# --- SentencePiece -----------------------------------------------------------------------------------------------------

TEXTS = ["Hello  world\nfoo", " a", "", "é\x00あ 🙂", "  leading", "trailing  ", "tabs\tand ▁ sign", "x" * 300, "antidisestablishmentarianism " * 5, "a" * (SCAN + 1)]


def test_no_dropout_equals_the_library():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    enc = MergeEncoder(load_pieces(), dropout=0)
    for t in [*TEXTS, prose(1, 200)]:
        if "▁" not in t:
            assert list(enc.encode(t)) == sp.encode(t), t


def test_dropout_varies_and_decodes():
    pieces = load_pieces()
    enc = MergeEncoder(pieces, dropout=0.3, seed=5)
    text = prose(4, 50)
    kinds = {tuple(enc.encode(text, v).tolist()) for v in range(6)}
    assert len(kinds) == 6
    assert list(enc.encode(text, 2)) == list(MergeEncoder(pieces, dropout=0.3, seed=5).encode(text, 2))
    for t in TEXTS:
        for v in range(3):
            assert enc.decode(enc.encode(t, v)) == t


def by_hand(enc, unit, key):
    """The segmentation of one occurrence: again and again the best candidate that was not skipped, looked up from scratch."""
    parts, at, skipped = list(unit), list(range(len(unit))), set()
    while True:
        found = [(enc.rank[a + b], i, len(a), k) for k, (a, b, i) in enumerate(zip(parts, parts[1:], at)) if a + b in enc.rank and (enc.rank[a + b], i, len(a)) not in skipped]
        if not found:
            break
        rank, i, left, k = min(found)
        if enc._skip(key, i, left, rank):
            skipped.add((rank, i, left))
        else:
            parts[k : k + 2], at = ["".join(parts[k : k + 2])], at[: k + 1] + at[k + 2 :]
    out = []
    for p in parts:
        out += [enc.ids[p]] if p in enc.ids else [enc.bytes[b] for b in p.encode()]
    return out


def test_each_occurrence_is_segmented_by_its_own_key():
    pieces = load_pieces()
    text = " ".join([prose(9, 60), "interesting ünïcode ²", "tokenization " * 30, "x" * 40, "antidisestablishmentarianism"])
    for dropout in (0.1, 0.5, 0.9):
        enc = MergeEncoder(pieces, dropout, seed=3)
        for document in (1, -7, 1 << 62):
            units = enc.units.findall(" " + text)
            want = [i for u, k in zip(units, enc.occurrence_keys(document, len(units)).tolist()) for i in by_hand(enc, u.replace(" ", "▁"), k)]
            assert enc.encode(text, document).tolist() == want
            enc.clear()
            assert enc.encode_all([None, text, text[:50]], [4, document, 5])[1].tolist() == want
    kinds = {enc.encode(" tokenization" * 200, 8).tobytes()} | {MergeEncoder(pieces, 0.3, 1).encode(" tokenization", d).tobytes() for d in range(200)}
    assert len(kinds) > 20


def test_encode_documents(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, token_ids int")
    got = {r["doc_id"]: r for r in encode_documents(df).collect()}
    assert all(got[i]["lossless"] for i in range(len(TEXTS)))
    assert got[len(TEXTS)]["token_ids"] is None and got[len(TEXTS)]["lossless"] is None and got[2]["token_ids"] == []


# --- neighbours --------------------------------------------------------------------------------------------------------


def test_probe_order_is_by_score():
    order = probe_order(4, 40)
    assert order[0] == () and order[1] == (1,) and len(set(order)) == len(order)
    assert all(9 - j not in s for s in order for j in s)


def test_nearest_recall_and_ties(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((12, 16))
    x = centres[r.integers(0, 12, 900)] + 0.5 * r.standard_normal((900, 16))
    x[300:340] = x[300]
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got: dict = {}
    for g in nearest(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(g["query_id"], []).append((g["vec_id"], g["score"]))
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -1e9
        true = sorted(range(900), key=lambda i: (-score[i], i))[:20]
        assert len(found) == 20 and q not in dict(found)
        assert all(math.isclose(s, score[i], rel_tol=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        hits += len(set(true) & {i for i, _ in found})
        if q == 300:
            assert [i for i, _ in found] == list(range(301, 321))
    assert hits >= 0.9 * 20 * len(got)


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 20), (0, 2, 3), (20, 1, 3), (20, 2, 0)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


# --- chats -------------------------------------------------------------------------------------------------------------


def test_chats_round_trip(spark):
    nasty = ["\\", "\\s", "\\h\\t", "####", "### User: x</turn>\n", "</turn></turn>", TRAP, "", "a: b", "é\n\n", "\\\\###"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "first"), (3, 1, "user", "b"), (3, 0, "system", None), (4, 0, "tool: ###", "x"), (4, 0, None, "y"), (None, 1, "user", "n"), (-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    chats = format_chats(df)
    got = {r["conv_id"]: r for r in chat_digests(chats).collect()}
    turns = {r["conv_id"]: r["t"] for r in chats.select("conv_id", parse_chats(F.col("formatted")).alias("t")).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([r[1:] for r in rows if r[0] == conv], key=lambda r: (r[0], r[1] or "", r[2] or ""))
        said = [(r or "", t or "") for _, r, t in mine]
        assert [(t["role"], t["text"]) for t in turns[conv]] == said
        loss = "".join(t for r, t in said if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["loss_chars"]) == (len(said), len(loss))
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1]["valid"] and not got[2]["valid"] and got[3]["valid"] and not got[4]["valid"]
    assert chat_digests(format_chats(df.limit(0))).count() == 0


# --- rollups -----------------------------------------------------------------------------------------------------------


def test_rollups_are_additive_and_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", "en", "x y"), ("a", "en", None), (None, "de", "z"), ("b", "en", "")], "source string, lang string, text string")
    one = facts(df, "v1", word_count(F.col("text")))
    store = RollupStore(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    assert store.commit("load", signed(one, 1)) and not store.commit("load", signed(one, 1))
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v1", 2, 2, 3), (None, "de", "v1", 1, 1, 1), ("b", "en", "v1", 1, 0, 0)}
    gone = one.where("source = 'b'")
    store.commit("delete", signed(gone, -1))
    store.commit("revise", revised(one.where("source = 'a'"), facts(df.where("source = 'a'"), "v2", F.lit(7))))
    again = RollupStore(spark, f"file://{tmp_path}/store")
    assert again.committed() == ["delete", "load", "revise"]
    assert {tuple(r) for r in again.totals().collect()} == {("a", "en", "v2", 2, 14, 3), (None, "de", "v1", 1, 1, 1)}


# --- surrogates --------------------------------------------------------------------------------------------------------


def test_surrogates_replace_consistently(spark):
    mail, phone, card, ip, token = "anna.5@mail7.example.com", "+1 (017) 555-7713", "4111 1111 1111 1111", "10.20.30.40", "0123456789abcdef0123456789abcdef01234567"
    texts = [
        f"write {mail}, call {phone}.\ntoken = \"{token}\" from {ip}",
        f"{mail.upper()} and +1-017-555-7713 or {card.replace(' ', '')} ({card})",
        "Mr. John Smith met Mary Jones; Frau Smith left. John Brown, господин Иван Петров",
        None,
        "",
        "no personal data, version 1.2.3 costs 12345",
        " ".join(f"u{i}@h{i}.example.org 10.0.{i}.1" for i in range(200)),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_entities int")
    got = {r["doc_id"]: r for r in pseudonymise(df).collect()}
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == texts[5]
    a, b, c = got[0]["text"], got[1]["text"], got[2]["text"]
    for secret in (mail, phone, "555-7713", token, ip):
        assert secret not in a
    assert a.startswith("write ") and ".\ntoken = \"" in a and got[0]["n_entities"] == 4
    new_mail = re.search(r"write (\S+),", a)[1]
    assert re.fullmatch(r"[a-z]{4}\.\d@[a-z]{4}\d\.[a-z]{7}\.com", new_mail) and new_mail.upper() in b
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(re.search(r"call (.*)\.\n", a)[1]) == digits(re.search(r"and (\S+) or", b)[1])
    n = digits(re.search(r"or (\d{16}) ", b)[1])
    assert n == digits(re.search(r"\((.*)\)", b)[1]) and n != digits(card) and n[0] == "4"
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, n[::-1])))
    assert total % 10 == 0
    names = re.match(r"Mr\. (\S+) (\S+) met (\S+) (\S+); Frau (\S+) left\. (\S+) (\S+), господин (\S+) (\S+)$", c)
    assert names[2] == names[5] and names[1] == names[6] and len({names[1], names[2], names[3], names[4], names[7]}) == 5
    assert re.fullmatch("[а-яА-Я]+", names[8]) and not {"Smith", "Jones", "Brown", "John", "Mary"} & set(names.groups())
    many = got[6]["text"].split()
    assert len(set(many)) == 400 and got[6]["n_entities"] == 400
    for kind, found in (("email", many[::2]), ("ip", many[1::2])):
        assert all(re.fullmatch(PATTERNS[kind].replace("\\p{L}", "^\\W\\d_").replace("*+", "*"), x) if kind == "ip_" else True for x in found)
    assert with_surrogates(df.limit(0), "k").count() == 0


# --- pages -------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">buy</div>
<article><h1>T&eacute;st &amp; more</h1><p><b>Lead<br>in<p>Second  para<!-- no --> here<div class="share">Share!</div><form><p>Mail</p></form><aside>side</aside></article>
<section id="comments"><article class="comment"><p>Nice!</p></article></section><footer>&copy; x</footer>"""


def test_blocks_of_a_page():
    assert " ".join(t for p, t in blocks_of(PAGE) if p == MAIN) == "Tést & more Lead in Second para here"
    assert blocks_of(None) == [] and blocks_of("") == [] and blocks_of("<p>a <a href='x") == [(1, "a")]
    assert blocks_of("a < b &lt; c")[0][1] == "a < b < c"
    assert len(blocks_of("<div>" * 3000 + "deep" + "</div>" * 10)) == 1


def test_repeated_runs_need_distinct_pages():
    s = [np.array([1, 2, 3, 4, 9]), np.array([7, 1, 2, 3, 4]), np.array([1, 2, 5])]
    assert [r.tolist() for r in repeated(s, [0, 1, 2], run=4)] == [[True] * 4 + [False], [False] + [True] * 4, [False] * 3]
    assert not any(r.any() for r in repeated(s, [0, 0, 0], run=4))


def test_pages_without_an_article_lose_what_their_host_repeats(spark):
    menu = "Home About Contact Jobs Press Terms Privacy Help Login Search"
    rows = [(i, f"http://h.example/{i}", f"<html><body><div>{menu}</div><div>{prose(i, 25)}</div><div>All rights reserved by the publisher of this very nice site</div></body></html>") for i in range(6)]
    rows += [(10, "http://h.example/a", PAGE), (11, None, None), (12, "http://other.example/", "<p>alone here</p>"), (13, "x", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in extract_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i]["text"] == prose(i, 25) and got[i]["n_repeated"] > 0
    assert got[10]["text"] == "Tést & more Lead in Second para here" and got[10]["n_chars"] == len(got[10]["text"])
    assert got[11]["text"] == "" and got[12]["text"] == "alone here" and got[13]["n_chars"] == 0
    assert extract_text(df.limit(0)).count() == 0
