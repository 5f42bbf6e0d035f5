"""Roles spelled like labels, and long texts, come back from the formatted conversation."""

from pyspark.sql import functions as F

from quarry.llm.chat_format import chat_digests, format_chats, parse_chats


def test_roles_like_labels_are_not_those_roles(spark):
    roles = ["user", "assistant", "User", "Assistant", "System", "\\r", "\\rUser", "\\sUser", "a: b", "", None]
    rows = [(k, t, r, f"text {t}") for k, pair in enumerate((a, b) for a in roles for b in roles) for t, r in enumerate(pair)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = format_chats(df)
    got = {r["conv_id"]: [(x["role"], x["text"], x["loss"]) for x in r["t"]] for r in chats.select("conv_id", parse_chats(F.col("formatted")).alias("t")).collect()}
    for k in got:
        assert got[k] == [(r or "", x, r == "assistant") for c, _, r, x in rows if c == k]
    digests = {r["conv_id"]: (r["turns_sha256"], r["loss_chars"]) for r in chat_digests(chats).collect()}
    by_roles = {tuple(r or "" for c, _, r, _ in rows if c == k): v for k, v in digests.items()}
    assert len({v[0] for v in by_roles.values()}) == len(by_roles)
    assert by_roles[("User", "Assistant")][1] == 0 and by_roles[("user", "assistant")][1] == 6


def test_long_texts_and_clashing_columns(spark):
    texts = ["### </turn>\n\\" * 40_000, "x" * 1_000_000]
    df = spark.createDataFrame([(1, t, r, x, "v") for t, (r, x) in enumerate(zip(("user", "assistant"), texts))], "conv_id long, turn long, role string, text string, formatted string")
    row = format_chats(df).select("n_turns", "valid", parse_chats(F.col("formatted")).alias("t")).first()
    assert row["n_turns"] == 2 and row["valid"] and [x["text"] for x in row["t"]] == texts
