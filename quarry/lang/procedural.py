"""Procedural function bodies over rows: a small interpreter that runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from .tokens import Cursor, ParseError, Token, split_commas

_FUNCTIONS: dict[str, Callable] = {
    "UPPER": lambda s: None if s is None else s.upper(),
    "LOWER": lambda s: None if s is None else s.lower(),
    "LEN": lambda s: None if s is None else len(s),
    "TRIM": lambda s: None if s is None else s.strip(),
    "ABS": lambda x: None if x is None else abs(x),
    "ROUND": lambda x, n=0: None if x is None else round(x, int(n)),
    "COALESCE": lambda *a: next((x for x in a if x is not None), None),
    "SUBSTRING": lambda s, i, n: None if s is None else s[int(i) - 1 : int(i) - 1 + int(n)],
    "CONCAT": lambda *a: "".join("" if x is None else str(x) for x in a),
}


class _Result(Exception):
    pass


def _value(c: Cursor, env: dict, level: int = 0):
    """An expression by precedence: OR, AND, NOT, comparison, + -, * / %, unary."""
    if level == 0:
        x = _value(c, env, 1)
        while c.accept("OR"):
            y = _value(c, env, 1)
            x = bool(x) or bool(y)
        return x
    if level == 1:
        x = _value(c, env, 2)
        while c.accept("AND"):
            y = _value(c, env, 2)
            x = bool(x) and bool(y)
        return x
    if level == 2:
        if c.accept("NOT"):
            x = _value(c, env, 2)
            return None if x is None else not x
        x = _value(c, env, 3)
        if c.accept("IS"):
            no = c.accept("NOT")
            c.expect("NULL")
            return (x is not None) if no else x is None
        if c.now is not None and c.now.kind == "op" and c.now.text in ("=", "==", "<>", "!=", "<", "<=", ">", ">="):
            op = c.next().text
            y = _value(c, env, 3)
            if x is None or y is None:
                return None
            if isinstance(x, str) and isinstance(y, str):
                x, y = x.lower(), y.lower()
            return {"=": x == y, "==": x == y, "<>": x != y, "!=": x != y}.get(op) if op in ("=", "==", "<>", "!=") else {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return x
    if level == 3:
        x = _value(c, env, 4)
        while c.now is not None and c.now.text in ("+", "-", "||"):
            op = c.next().text
            y = _value(c, env, 4)
            if x is None or y is None:
                x = None
            elif op == "||" or isinstance(x, str) or isinstance(y, str):
                x = f"{x}{y}"
            else:
                x = x + y if op == "+" else x - y
        return x
    if level == 4:
        x = _value(c, env, 5)
        while c.now is not None and c.now.text in ("*", "/", "%"):
            op = c.next().text
            y = _value(c, env, 5)
            if x is None or y is None:
                x = None
            elif op == "*":
                x = x * y
            elif op == "%":
                x = x % y if x >= 0 else -(-x % y)
            else:
                x = int(x / y) if isinstance(x, int) and isinstance(y, int) else x / y
        return x
    t = c.next()
    if t.text == "-":
        x = _value(c, env, 5)
        return None if x is None else -x
    if t.kind == "number":
        return int(t.text) if t.text.isdigit() else float(t.text)
    if t.kind == "string":
        return t.text[1:-1].replace("''", "'")
    if t.kind == "variable":
        return env[t.text.lower()]
    if t.text == "(":
        c.i -= 1
        return _value(Cursor(c.inside()), env)
    if t.up in ("NULL", "TRUE", "FALSE"):
        return {"NULL": None, "TRUE": True, "FALSE": False}[t.up]
    if t.up == "CASE":
        hit, out = False, None
        while c.accept("WHEN"):
            w = Cursor(c.until("THEN"))
            c.expect("THEN")
            v = Cursor(c.until("WHEN", "ELSE", "END"))
            if not hit and _value(w, env):
                hit, out = True, _value(v, env)
        if c.accept("ELSE"):
            v = Cursor(c.until("END"))
            if not hit:
                out = _value(v, env)
        c.expect("END")
        return out
    if c.at("(") and t.up in _FUNCTIONS:
        return _FUNCTIONS[t.up](*[_value(Cursor(p), env) for p in split_commas(c.inside())])
    raise ParseError(f"{t.text!r} in a function body")


def _run(c: Cursor, env: dict, *ends: str) -> None:
    while c.now is not None and c.now.up not in ends:
        if c.accept(";"):
            continue
        if c.accept("DECLARE"):
            name = c.next().text.lower()
            c.until("=", ";")
            env[name] = _value(Cursor(c.until(";")), env) if c.accept("=") else None
        elif c.accept("SET"):
            name = c.next().text.lower()
            c.accept("=")
            env[name] = _value(Cursor(c.until(";", "END", "ELSE")), env)
        elif c.accept("RETURN"):
            raise _Result(_value(Cursor(c.until(";", "END", "ELSE")), env))
        elif c.accept("IF"):
            hit = _value(Cursor(c.until("BEGIN", "RETURN", "SET", "THEN")), env)
            c.accept("THEN")
            _branch(c, env, bool(hit))
            c.accept(";")
            if c.accept("ELSE"):
                _branch(c, env, not hit)
        elif c.accept("WHILE"):
            start = c.i
            while True:
                c.i = start
                hit = _value(Cursor(c.until("BEGIN")), env)
                _branch(c, env, bool(hit))
                if not hit:
                    break
        else:
            raise ParseError(f"{c.now.text!r} in a function body")


def _branch(c: Cursor, env: dict, hit: bool) -> None:
    start = c.i
    if c.accept("BEGIN"):
        depth, begin = 1, c.i
        while depth:
            t = c.next()
            depth += {"BEGIN": 1, "CASE": 1, "END": -1}.get(t.up, 0)
        body = c.tokens[begin : c.i - 1]
    else:
        c.until(";", "ELSE")
        c.accept(";")
        body = c.tokens[start : c.i]
    if hit:
        _run(Cursor(body), env)


def compile_body(tokens: list[Token], parameters: list[tuple[str, str]]) -> Callable:
    """A Python function of the parameters (as texts) that runs a body and gives its RETURN as text."""

    def convert(x: str | None, kind: str):
        if x is None or kind == "string":
            return x
        if kind in ("int", "bigint", "smallint"):
            return int(float(x))
        if kind.startswith(("decimal", "double", "float")):
            return float(x)
        return x

    def f(*args):
        env: dict = {p: convert(a, k) for (p, k), a in zip(parameters, args, strict=True)}
        try:
            _run(Cursor(tokens), env)
        except _Result as r:
            return None if r.args[0] is None else str(r.args[0])
        return None

    return f
