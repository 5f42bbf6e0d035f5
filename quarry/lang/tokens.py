"""Tokens of the script language."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""
    (?P<space>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<number>(?:\d[\d_]*\.\d[\d_]*|\.\d+|\d[\d_]*)(?:[eE][+-]?\d+)?)
  | (?P<string>[nN]?'(?:[^']|'')*')
  | (?P<quoted>"(?:[^"]|"")*"|`[^`]*`)
  | (?P<variable>@@?\w+)
  | (?P<temp>[\#&][A-Za-z_]\w*)
  | (?P<word>[A-Za-z_]\w*)
  | (?P<op>->>|\?\?|\|\||<=>|<>|!=|<=|>=|==|=>|->|::|<<|>>|~\*|[-+*/%=<>~&|^?:])
  | (?P<punct>[(),;.\[\]{}!])
    """,
    re.X | re.S,
)


class ParseError(Exception):
    """A text that is not in the language."""


@dataclass(frozen=True)
class Token:
    """kind: number, string, quoted, variable, temp, word, op or punct; start and end: its place in the text."""

    kind: str
    text: str
    start: int
    end: int

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at : at + 20]!r} at {at}")
        if m.lastgroup != "space":
            kind, value = m.lastgroup, m[0]
            if kind == "number":
                value = value.replace("_", "")
            elif kind == "string" and value[0] in "nN":
                value = value[1:]
            out.append(Token(kind, value, at, m.end()))
        at = m.end()
    return out


class Cursor:
    """A place in a list of tokens."""

    def __init__(self, tokens: list[Token], text: str = ""):
        self.tokens, self.i, self.text = tokens, 0, text

    @property
    def now(self) -> Token | None:
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def peek(self, n: int = 1) -> Token | None:
        return self.tokens[self.i + n] if self.i + n < len(self.tokens) else None

    def at(self, *words: str) -> bool:
        """Whether the next tokens are these words or signs."""
        return all(self.i + k < len(self.tokens) and self.tokens[self.i + k].up == w and self.tokens[self.i + k].kind != "string" for k, w in enumerate(words))

    def accept(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise ParseError(f"expected {' '.join(words)}, found {self.now.text if self.now else 'the end'}")

    def next(self) -> Token:
        t = self.now
        if t is None:
            raise ParseError("unexpected end")
        self.i += 1
        return t

    def name(self) -> str:
        """An identifier: a word, a quoted or bracketed name, or a temp table's name."""
        t = self.next()
        if t.kind == "quoted":
            return t.text[1:-1].replace('""', '"')
        if t.text == "[":
            out = []
            while not self.accept("]"):
                out.append(self.next().text)
            return " ".join(out)
        if t.kind in ("word", "temp", "variable"):
            return t.text
        raise ParseError(f"expected a name, found {t.text!r}")

    def inside(self) -> list[Token]:
        """The tokens between the next parenthesis and its partner."""
        self.expect("(")
        depth, start = 1, self.i
        while depth:
            t = self.next()
            if t.kind == "punct":
                depth += {"(": 1, ")": -1}.get(t.text, 0)
        return self.tokens[start : self.i - 1]

    def until(self, *stops: str) -> list[Token]:
        """Tokens up to one of the words outside parentheses (a stop may be several words), or to the end."""
        wanted = [s.split() for s in stops]
        start, depth, cases = self.i, 0, 0
        while self.now is not None:
            t = self.now
            if t.kind == "punct":
                depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(t.text, 0)
                if depth < 0:
                    break
            if t.up == "CASE" and t.kind == "word":
                cases += 1
            elif t.up == "END" and cases:
                cases -= 1
            elif depth == 0 and not cases and any(self.at(*w) for w in wanted) and not (t.up == "FROM" and self.i > 1 and self.tokens[self.i - 1].up == "DISTINCT" and self.tokens[self.i - 2].up in ("IS", "NOT")):
                break
            self.i += 1
        return self.tokens[start : self.i]


def split_commas(tokens: list[Token]) -> list[list[Token]]:
    """Parts between commas outside parentheses; a trailing comma is allowed."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.kind == "punct":
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(t.text, 0)
        if t.text == "," and t.kind == "punct" and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    if not out[-1]:
        out.pop()
    return out
