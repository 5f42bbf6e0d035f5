"""Surrogates: what is found, what form it keeps, distinctness and coreference by brute force, and texts that could exhaust a matcher."""

import re

from quarry.llm.pii import PATTERNS, with_surrogates

SCHEMA = "doc_id long, text string"


def rewritten(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r["doc_id"]: (r["text"], r["n_entities"]) for r in with_surrogates(df, key).collect()}


def test_forms_are_kept(spark):
    texts = [
        "Dr. Anna-Maria O'Neil saw MR JOHN SMITH and Mr. John Smith's son.",
        "Write to John.Smith@Mail.Example.com or john.smith@mail.example.com",
        "Call 020 7946 0958 from 2001:db8:85a3:0:0:8a2e:370:7334",
        "Pay GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432 now",
        "My name is Wei Zhang. Author: Priya Patel",
        'password=Ab3xYz99Qr and token = "f3ef4d6b2755a36d7d"',
    ]
    got = rewritten(spark, texts)
    a = re.fullmatch(r"Dr\. ([A-Z][a-z]+)-([A-Z][a-z]+) O'([A-Z][a-z]+) saw MR ([A-Z]+) ([A-Z]+) and Mr\. ([A-Z][a-z]+) ([A-Z][a-z]+)'s son\.", got[0][0])
    assert a and got[0][1] == 3
    assert not {"anna", "maria", "neil", "john", "smith"} & {x.lower() for x in a.groups()}
    assert (a[4], a[5]) == (a[6].upper(), a[7].upper())
    b = re.fullmatch(r"Write to (\S+) or (\S+)", got[1][0])
    assert b[1].lower() == b[2] != "john.smith@mail.example.com" and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{4}@[A-Z][a-z]{3}\.[A-Z][a-z]{6}\.com", b[1])
    c = re.fullmatch(r"Call (\d{3} \d{4} \d{4}) from ((?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4})", got[2][0])
    assert c and c[1] != "020 7946 0958" and c[2] != "2001:db8:85a3:0:0:8a2e:370:7334"
    d = re.fullmatch(r"Pay (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) or (GB\d\d[A-Z]{4}\d{14}) now", got[3][0])
    assert d and d[1].replace(" ", "") == d[2] != "GB82WEST12345698765432"
    assert int("".join(str(int(x, 36)) for x in d[2][4:] + d[2][:4])) % 97 == 1
    assert got[4][1] == 2 and not re.search("Wei|Zhang|Priya|Patel", got[4][0])
    assert got[5][1] == 2 and re.fullmatch(r'password=[A-Z][a-z]\d[a-z][A-Z][a-z]\d\d[A-Z][a-z] and token = "[a-z0-9]{18}"', got[5][0]) and "Ab3x" not in got[5][0]


def test_distinct_entities_stay_distinct_and_equal_ones_equal(spark):
    names = ["James", "John", "Robert", "Mary", "Laura"]
    people = [(g, s) for g in names for s in ("Miller", "Fisher", "Baker", "Carter")]
    mails = [f"user{i}@site{i % 3}.org" for i in range(40)]
    texts = [f"{g} {s} wrote to {mails[i % 40]}" for i, (g, s) in enumerate(people * 4)]
    got = rewritten(spark, texts)
    seen = {}
    for i, (g, s) in enumerate(people * 4):
        a, b, mail = re.fullmatch(r"(\w+) (\w+) wrote to (\S+)", got[i][0]).groups()
        for kind, old, new in (("given", g, a), ("surname", s, b), ("mail", mails[i % 40], mail)):
            assert new != old and seen.setdefault((kind, old), new) == new
    for kind in ("given", "surname", "mail"):
        made = [v for (k, _), v in seen.items() if k == kind]
        known = {o for k, o in seen if k == kind}
        assert len(made) == len(set(made)) and not known & set(made)
    assert rewritten(spark, texts[:20]) != rewritten(spark, texts[:20], "other key")


RUNS = ["a@" + "b." * 500_000, "a." * 500_000, "A" * 1_000_000, "0" * 1_000_000, "1." * 500_000, "f:" * 500_000, "f" * 1_000_000, "GB82" * 250_000, "GB82 " * 200_000, "+1 " * 300_000, "12 " * 300_000, "Dr " * 300_000, "Anna-" * 200_000, "O'" * 400_000, "token=" * 160_000, "(" * 1_000_000, "Mr John " * 100_000 + "x", "é" * 1_000_000]


def test_long_runs_end_no_executor(spark):
    got = rewritten(spark, RUNS)
    for i, run in enumerate(RUNS):
        assert (got[i][0] == run) == (got[i][1] == 0)


def test_each_kind_in_a_long_text(spark):
    texts = {"email": "a.b@c.org", "ip": "10.20.30.40", "ipv6": "fe80::1:2", "ssn": "123-45-6789", "iban": "DE89370400440532013000", "card": "4111 1111 1111 1111", "phone": "+1 (212) 555-0100", "secret": "0123456789abcdef0123456789abcdef", "credential": "password: hunter2hunter2", "person": "Mrs Karen Young"}
    assert set(texts) == set(PATTERNS)
    filler = "lorem ipsum " * 40_000
    got = rewritten(spark, [filler + x + " " + filler for x in texts.values()])
    for i, x in enumerate(texts.values()):
        assert got[i][1] == 1 and got[i][0].startswith(filler) and got[i][0].endswith(filler) and x not in got[i][0]


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a@b.org", 1, "k"), (None, None, 2, "k"), (None, "c@d.org", 3, "k"), (5, "a@b.org", 4, "k"), (5, "a@b.org", 4, "k"), (6, "", 5, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __found int, __key string").withColumn("__map", df_lit())
    out = with_surrogates(df, "k")
    assert out.columns == ["doc_id", "text", "__found", "__key", "__map", "n_entities"]
    got = {r["__found"]: r for r in out.collect()}
    assert out.count() == 6 and got[1]["text"] == got[4]["text"] != "a@b.org" and got[3]["text"] not in ("c@d.org", got[1]["text"])
    assert (got[2]["text"], got[2]["n_entities"], got[5]["text"]) == (None, 0, "") and got[1]["__key"] == "k" and got[1]["__map"] == 7
    assert with_surrogates(spark.createDataFrame([], SCHEMA), "k").count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit(7)
