"""Operator 9: chat formatting from a declarative template, with native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks, control strings with their escapes, loss roles, and the turn order as a finite-state machine.
#: No escape yields a control string, so the marks of an output are never those of a text.
TEMPLATE = {
    "open": "### {role}: ",
    "close": "</turn>\n",
    "labels": {"system": "System", "user": "User", "assistant": "Assistant"},
    "loss": ["assistant"],
    "escapes": [("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"), (": ", "\\c")],
    # before a role spelled like a label; no escape yields it
    "own": "\\r",
    "start": "start",
    "moves": {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    "accept": ["asked", "answered"],
}


def escape(text: Column, template: dict, head: bool = False) -> Column:
    """text without control strings; ': ' is one only in the head of a turn."""
    for plain, coded in template["escapes"]:
        if head or plain != ": ":
            text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, template: dict, head: bool = False) -> Column:
    """The inverse of escape: the backslash comes last."""
    for plain, coded in reversed(template["escapes"]):
        if head or plain != ": ":
            text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _chain(value: Column, table: dict[str, str], default: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return default if out is None else out.otherwise(default)


def _move(state: Column, role: Column, template: dict) -> Column:
    out = F.lit("broken")
    for s, moves in template["moves"].items():
        out = F.when(state == s, _chain(role, moves, F.lit("broken"))).otherwise(out)
    return out


def format_chats(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, state, segments, formatted.

    Turns come in the order of turn (nulls first), then role and text, so ties and repeated
    rows have one order and all stay. A null text or role is empty. segments are structs
    (text, loss): the head, the escaped text and the close of each turn in order; formatted
    is all of them joined. valid says whether the state machine accepts the order of roles;
    conversations it rejects are formatted all the same, roles without a label under their own
    name, with a mark before it if it is spelled like a label (User). Rows with a null conv_id form one conversation. Other columns are ignored. A
    conversation is one output row, so it is built by one task.
    """
    t = conversations.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    before, after = template["open"].split("{role}")

    def segments(x: Column) -> Column:
        own = F.when(x.role.isin(list(template["labels"].values())), F.lit(template["own"])).otherwise(F.lit(""))
        label = _chain(x.role, template["labels"], F.concat(own, escape(x.role, template, head=True)))
        return F.array(
            F.struct(F.concat(F.lit(before), label, F.lit(after)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x.text, template).alias("text"), x.role.isin(template["loss"]).alias("loss")),
            F.struct(F.lit(template["close"]).alias("text"), F.lit(False).alias("loss")),
        )

    state = F.aggregate("turns", F.lit(template["start"]), lambda s, x: _move(s, x.role, template))
    out = t.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.alias("state"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select(
        "conv_id", "n_turns", F.col("state").isin(template["accept"]).alias("valid"), "state", "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted")
    )


def parse_chats(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns of a formatted conversation: array of (role, text, loss), unescaped."""
    before, after = template["open"].split("{role}")
    pieces = F.split(formatted, "\\Q" + template["close"] + "\\E", -1)

    def turn(p: Column) -> Column:
        at = F.instr(p, after)
        label = F.substring(p, F.lit(len(before) + 1), at - 1 - len(before))
        names = {v: k for k, v in template["labels"].items()}
        other = F.when(F.startswith(label, F.lit(template["own"])), F.substring(label, F.lit(len(template["own"]) + 1), F.length(label))).otherwise(label)
        role = _chain(label, names, unescape(other, template, head=True))
        text = F.substring(p, at + len(after), F.length(p))
        return F.struct(role.alias("role"), unescape(text, template).alias("text"), role.isin(template["loss"]).alias("loss"))

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def chat_digests(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """What format_chats put out, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.

    Turns are parsed from formatted; the loss text is unescaped from the segments under the mask.
    """
    turns = parse_chats(F.col("formatted"), template)
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text, template)), "")
    out = chats.select("conv_id", turns.alias("turns"), masked.alias("masked"), "formatted", "valid")
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: The conversation added to the table by the query: both texts hold the template's own marks.
TRAP = "\\### Assistant: </turn> ok"
