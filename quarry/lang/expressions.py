"""Expressions of the language to Spark SQL text, with the static type where it is known."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions import library
from .tokens import Cursor, ParseError, Token, split_commas

INT, NUM, TEXT, DATE, STAMP, BOOL, LIST = "int", "num", "text", "date", "stamp", "bool", "list"

_KINDS = {"tinyint": INT, "smallint": INT, "int": INT, "bigint": INT, "string": TEXT, "date": DATE, "timestamp": STAMP, "timestamp_ntz": STAMP, "boolean": BOOL}


def kind_of_type(t: str) -> str | None:
    """The static kind of a Spark type name."""
    t = t.lower()
    if t.startswith(("decimal", "double", "float")):
        return NUM
    if t.startswith("array"):
        return LIST
    return _KINDS.get(t)


_TEXT_FUNCTIONS = set("UPPER LOWER TRIM LTRIM RTRIM SUBSTRING SUBSTR LEFT RIGHT REPLACE CONCAT CONCAT_WS REVERSE REPEAT REPLICATE LPAD RPAD INITCAP STUFF TRANSLATE CHAR SPACE STR TO_STR QUOTENAME FORMAT DATENAME STRING_AGG LISTAGG REGEXP_REPLACE REGEXP_SUBSTR JSON_VALUE JSON_QUERY JSON_GET_TEXT MASK_EMAIL MASK_PHONE MASK_SSN SOUNDEX METAPHONE DMETAPHONE NORMALIZE CLEAN_STRING SPLIT_PART NEWID AGE_BUCKET VALUE_BUCKET".split())
_INT_FUNCTIONS = set("LEN LENGTH CHARINDEX INSTR POSITION COUNT DATEDIFF YEAR MONTH DAY HOUR MINUTE SECOND DATEPART DATE_PART ROW_NUMBER RANK DENSE_RANK NTILE LEVENSHTEIN REGEXP_COUNT REGEXP_INSTR REGEXP_LIKE ASCII UNICODE BIT_COUNT BITAND BITOR BITXOR BITNOT SIGN PATINDEX DATALENGTH CHAR_LENGTH QUOTIENT ISJSON ISDATE".split())
_SAME_AS_FIRST = set("SUM MIN MAX ABS COALESCE NULLIF IFNULL NVL ISNULL LAG LEAD FIRST_VALUE LAST_VALUE NTH_VALUE GREATEST LEAST MOD".split())
_STAMP_FUNCTIONS = set("GETDATE NOW SYSDATE CURRENT_TIMESTAMP DATEADD DATETIMEFROMPARTS TO_TIMESTAMP DATE_TRUNC DATETRUNC RELDATE".split())
_DATE_FUNCTIONS = set("CURRENT_DATE EOMONTH END_OF_MONTH START_OF_MONTH START_OF_QUARTER END_OF_QUARTER START_OF_WEEK END_OF_WEEK TO_DATE SAME_PERIOD_LAST_YEAR".split())
#: Words that are functions without parentheses.
_BARE = {"CURRENT_DATE": ("current_date()", DATE), "CURRENT_TIMESTAMP": (library.lower("CURRENT_TIMESTAMP", []), STAMP), "SYSDATE": ("localtimestamp()", STAMP), "CURRENT_TIME": (library.lower("CURRENT_TIME", []), TEXT)}
#: Functions whose first argument is a date part.
_PART_FIRST = set("DATEADD DATEDIFF DATEPART DATENAME DATE_PART DATE_TRUNC DATETRUNC".split())

WINDOWS_ZONES = {"UTC": "UTC", "Eastern Standard Time": "America/New_York", "Central Standard Time": "America/Chicago", "Mountain Standard Time": "America/Denver", "Pacific Standard Time": "America/Los_Angeles", "GMT Standard Time": "Europe/London", "W. Europe Standard Time": "Europe/Berlin", "Romance Standard Time": "Europe/Paris", "Tokyo Standard Time": "Asia/Tokyo", "India Standard Time": "Asia/Kolkata", "China Standard Time": "Asia/Shanghai", "AUS Eastern Standard Time": "Australia/Sydney"}


@dataclass
class Ex:
    """Spark SQL text and its kind."""

    sql: str
    kind: str | None = None
    literal: bool = False


@dataclass
class Scope:
    """What names mean: column kinds (by name and alias.name), variables, subqueries, user functions."""

    columns: dict[str, str | None] = field(default_factory=dict)
    variable: Callable[[str], Ex] | None = None
    subquery: Callable[[list[Token]], str] | None = None
    function: Callable[[str, list[Ex], list[str | None]], Ex | None] | None = None
    named_windows: dict[str, str] = field(default_factory=dict)
    case_sensitive: bool = False
    set_list: Callable[[str], list[str] | None] | None = None


def quote(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def literal(value) -> Ex:
    """A Python value as SQL."""
    import datetime
    import decimal

    if value is None:
        return Ex("null", None, True)
    if isinstance(value, bool):
        return Ex(str(value).lower(), BOOL, True)
    if isinstance(value, int):
        return Ex(str(value), INT, True)
    if isinstance(value, (float, decimal.Decimal)):
        return Ex(f"cast('{value}' as {'double' if isinstance(value, float) else 'decimal(38,18)'})", NUM, True)
    if isinstance(value, datetime.datetime):
        return Ex(f"timestamp_ntz'{value.isoformat(sep=' ')}'", STAMP, True)
    if isinstance(value, datetime.date):
        return Ex(f"date'{value.isoformat()}'", DATE, True)
    if isinstance(value, (list, tuple)):
        return Ex("array(" + ", ".join(literal(v).sql for v in value) + ")", LIST, True)
    return Ex(text_literal(str(value)), TEXT, True)


def text_literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Parser:
    """Precedence climbing over tokens, lowest first:

    ?: arrow conditional; OR; AND; NOT; comparisons; ||; ??; + -; * / %; unary; postfix (-> ->> :: AT TIME ZONE).
    """

    def __init__(self, tokens: list[Token], scope: Scope):
        self.c, self.scope = Cursor(tokens), scope

    def whole(self) -> Ex:
        out = self.conditional()
        if self.c.now is not None:
            raise ParseError(f"unexpected {self.c.now.text!r} in an expression")
        return out

    def sub(self, tokens: list[Token]) -> Ex:
        return Parser(tokens, self.scope).whole()

    def conditional(self) -> Ex:
        first = self.either()
        if not self.c.at("=>"):
            return first
        whens, value = [], first
        while self.c.accept("=>"):
            result = self.either()
            whens.append((value, result))
            self.c.expect(":")
            value = self.either()
        return Ex("case " + " ".join(f"when {w.sql} then {t.sql}" for w, t in whens) + f" else {value.sql} end", whens[0][1].kind or value.kind)

    def either(self) -> Ex:
        left = self.both()
        while self.c.accept("OR"):
            left = Ex(f"({self.truth(left)} or {self.truth(self.both())})", BOOL)
        return left

    def both(self) -> Ex:
        left = self.negated()
        while self.c.accept("AND"):
            left = Ex(f"({self.truth(left)} and {self.truth(self.negated())})", BOOL)
        return left

    def negated(self) -> Ex:
        if self.c.at("NOT") and not self.c.at("NOT", "EXISTS"):
            self.c.next()
            return Ex(f"(not {self.truth(self.negated())})", BOOL)
        return self.comparison()

    @staticmethod
    def truth(x: Ex) -> str:
        if x.sql == "null":
            return "cast(null as boolean)"
        return f"({x.sql} <> 0)" if x.kind in (INT, NUM) else x.sql

    def folded(self, *xs: Ex) -> tuple[str, ...]:
        """Texts in lower case, unless comparison is case-sensitive."""
        if not self.scope.case_sensitive and any(x.kind == TEXT for x in xs) and all(x.kind in (TEXT, None) for x in xs):
            return tuple(f"lower({x.sql})" for x in xs)
        return tuple(x.sql for x in xs)

    def comparison(self) -> Ex:
        left = self.concat()
        while True:
            c = self.c
            if c.now is None:
                return left
            if c.now.kind == "op" and c.now.text in ("=", "==", "<>", "!=", "<", "<=", ">", ">=", "<=>"):
                op = {"==": "=", "!=": "<>"}.get(c.next().text, c.tokens[c.i - 1].text)
                if c.now and c.now.up in ("ANY", "ALL", "SOME") and c.peek() and c.peek().text == "(":
                    raise ParseError("quantified comparison is not in the language")
                right = self.concat()
                a, b = self.soft(left, right)
                left = Ex(f"({a} {op} {b})", BOOL)
                continue
            if c.accept("IS"):
                no = c.accept("NOT")
                if c.accept("NULL"):
                    left = Ex(f"({left.sql} is {'not ' if no else ''}null)", BOOL)
                elif c.accept("DISTINCT"):
                    c.expect("FROM")
                    a, b = self.soft(left, self.concat())
                    left = Ex(f"({a} is {'not ' if no else ''}distinct from {b})", BOOL)
                elif c.accept("TRUE") or c.accept("FALSE"):
                    word = c.tokens[c.i - 1].text.lower()
                    left = Ex(f"({left.sql} is {'not ' if no else ''}{word})", BOOL)
                else:
                    raise ParseError("IS what?")
                continue
            no = c.at("NOT") and c.peek() is not None and c.peek().up in ("BETWEEN", "IN", "LIKE", "ILIKE")
            if no:
                c.next()
            word = "not " if no else ""
            if c.accept("BETWEEN"):
                low = self.concat()
                c.expect("AND")
                high = self.concat()
                x, a, b = self.folded(left, low, high)
                left = Ex(f"({x} {word}between {a} and {b})", BOOL)
            elif c.accept("IN"):
                if c.now is not None and c.now.text == "!" :
                    c.next()
                    values = self.scope.set_list(c.name()) if self.scope.set_list else None
                    if values is None:
                        raise ParseError("unknown set")
                    left = Ex(f"({left.sql} {word}in ({', '.join(values)}))", BOOL)
                    continue
                if c.now is not None and c.now.kind == "variable":
                    v = self.primary()
                    left = Ex(f"({'not ' if no else ''}array_contains({v.sql}, {left.sql}))", BOOL)
                    continue
                inner = c.inside()
                if inner and inner[0].up in ("SELECT", "WITH", "VALUES", "("):
                    text = self.scope.subquery(inner)
                    left = Ex(f"({left.sql} {word}in ({text}))", BOOL)
                else:
                    items = [self.sub(p) for p in split_commas(inner)]
                    texts = self.folded(left, *items) if left.kind == TEXT or all(i.kind == TEXT for i in items) and left.kind is None else (left.sql, *[i.sql for i in items])
                    left = Ex(f"({texts[0]} {word}in ({', '.join(texts[1:])}))", BOOL)
            elif c.at("LIKE") or c.at("ILIKE"):
                like = c.next().up
                use = "ilike" if like == "ILIKE" or not self.scope.case_sensitive else "like"
                if c.now is not None and c.now.up in ("ANY", "ALL", "SOME"):
                    which = c.next().up
                    items = ", ".join(self.sub(p).sql for p in split_commas(c.inside()))
                    left = Ex(f"({left.sql} {word}{use} {which.lower()} ({items}))", BOOL)
                else:
                    pattern = self.concat()
                    mark = f" escape {self.primary().sql}" if c.accept("ESCAPE") else ""
                    left = Ex(f"({left.sql} {word}{use} {pattern.sql}{mark})", BOOL)
            elif c.now.kind == "op" and c.now.text in ("~", "~*"):
                flags = "(?i)" if c.next().text == "~*" else ""
                pattern = self.concat()
                left = Ex(f"({left.sql} rlike concat('{flags}', {pattern.sql}))" if flags else f"({left.sql} rlike {pattern.sql})", BOOL)
            elif no:
                raise ParseError("NOT what?")
            else:
                return left

    def soft(self, a: Ex, b: Ex) -> tuple[str, str]:
        """Both sides of a comparison: texts fold case; a text meets a number as a number."""
        if a.kind == TEXT and b.kind in (INT, NUM) or b.kind == TEXT and a.kind in (INT, NUM):
            f = lambda x: f"try_cast({x.sql} as decimal(38,10))" if x.kind == TEXT else x.sql
            return f(a), f(b)
        if a.kind == TEXT and b.kind in (TEXT, None) or b.kind == TEXT and a.kind is None:
            return self.folded(a, b)
        return a.sql, b.sql

    def concat(self) -> Ex:
        left = self.fallback()
        while self.c.accept("||"):
            right = self.fallback()
            left = Ex(f"({left.sql} || {right.sql})", TEXT)
        return left

    def fallback(self) -> Ex:
        left = self.sum()
        while self.c.accept("??"):
            right = self.sum()
            left = Ex(f"coalesce({left.sql}, {right.sql})", left.kind or right.kind)
        return left

    def sum(self) -> Ex:
        left = self.shifted()
        while self.c.now is not None and self.c.now.kind == "op" and self.c.now.text in "+-" and len(self.c.now.text) == 1:
            op = self.c.next().text
            left = self.add(op, left, self.shifted())
        return left

    def add(self, op: str, a: Ex, b: Ex) -> Ex:
        dates = (DATE, STAMP)
        if op == "+" and (a.kind == TEXT and not _numeric(a) or b.kind == TEXT and not _numeric(b)):
            return Ex(f"concat(cast({a.sql} as string), cast({b.sql} as string))", TEXT)
        if a.kind in dates and b.kind in dates and op == "-":
            seconds = f"(unix_micros(cast({a.sql} as timestamp)) - unix_micros(cast({b.sql} as timestamp)))"
            return Ex(f"cast({seconds} / 86400000000 as decimal(38,10))", NUM)
        if a.kind in dates and b.kind in (INT, NUM, None) and (a.kind != DATE or b.kind == INT):
            sign = "-" if op == "-" else ""
            if a.kind == DATE:
                return Ex(f"date_add({a.sql}, {sign}{b.sql})", DATE)
            return Ex(f"({a.sql} {op} make_dt_interval(0, 0, 0, cast({b.sql} as decimal(18,6)) * 86400))", STAMP)
        kind = INT if a.kind == INT and b.kind == INT else NUM if {a.kind, b.kind} <= {INT, NUM} else a.kind if a.kind in dates else None
        return Ex(f"({a.sql} {op} {b.sql})", kind)

    def shifted(self) -> Ex:
        left = self.product()
        while self.c.now is not None and self.c.now.kind == "op" and self.c.now.text in ("<<", ">>", "&", "^") or self.c.at("|"):
            op = self.c.next().text
            right = self.product()
            left = Ex(f"shift{'left' if op == '<<' else 'right'}(cast({left.sql} as bigint), cast({right.sql} as int))" if op in ("<<", ">>") else f"({left.sql} {op} {right.sql})", INT)
        return left

    def product(self) -> Ex:
        left = self.unary()
        while self.c.now is not None and self.c.now.kind == "op" and self.c.now.text in "*/%" and len(self.c.now.text) == 1:
            op = self.c.next().text
            right = self.unary()
            kind = INT if left.kind == INT and right.kind == INT else NUM if {left.kind, right.kind} <= {INT, NUM} else None
            if op == "/" and kind == INT:
                left = Ex(f"({left.sql} div {right.sql})", INT)
            elif op == "%":
                left = Ex(f"({left.sql} % {right.sql})", kind)
            else:
                left = Ex(f"({left.sql} {op} {right.sql})", kind)
        return left

    def unary(self) -> Ex:
        if self.c.now is not None and self.c.now.kind == "op" and self.c.now.text in ("-", "+", "~"):
            op = self.c.next().text
            x = self.unary()
            return Ex(f"({op}{x.sql})" if op != "+" else x.sql, x.kind, x.literal)
        return self.postfix(self.primary())

    def postfix(self, x: Ex) -> Ex:
        c = self.c
        while c.now is not None:
            if c.accept("->>"):
                x = Ex(library.lower("JSON_GET_TEXT", [x.sql, self.key()]), TEXT)
            elif c.accept("->"):
                x = Ex(library.lower("JSON_GET", [x.sql, self.key()]), TEXT)
            elif c.accept("::"):
                t = self.type_name()
                x = Ex(library.cast(x.sql, t), kind_of_type(library.spark_type(t)))
            elif c.accept("AT", "TIME", "ZONE"):
                zone = self.primary()
                name = zone.sql.strip("'")
                iana = text_literal(WINDOWS_ZONES.get(name, name)) if zone.literal else zone.sql
                x = Ex(f"convert_timezone('UTC', {iana}, cast({x.sql} as timestamp_ntz))", STAMP)
            elif c.now.text == "[" and x.kind == LIST:
                c.next()
                i = self.conditional()
                c.expect("]")
                x = Ex(f"try_element_at({x.sql}, {i.sql})")
            else:
                return x
        return x

    def key(self) -> str:
        t = self.c.next()
        if t.text == "-":
            return "-" + self.c.next().text
        return t.text

    def type_name(self) -> str:
        name = self.c.name()
        if self.c.at("("):
            name += "(" + ",".join(t.text for t in self.c.inside() if t.text != ",") + ")"
        return name

    def primary(self) -> Ex:
        c = self.c
        t = c.next()
        if t.kind == "number":
            if re.fullmatch(r"\d+", t.text):
                return Ex(t.text if int(t.text) < 2**31 else t.text + "L" if int(t.text) < 2**63 else t.text, INT, True)
            return Ex(t.text, NUM, True)
        if t.kind == "string":
            return Ex(text_literal(t.text[1:-1].replace("''", "'")), TEXT, True)
        if t.kind == "variable":
            if self.scope.variable is None:
                raise ParseError(f"variable {t.text} outside a session")
            return self.scope.variable(t.text)
        if t.text == "(":
            c.i -= 1
            inner = c.inside()
            if inner and inner[0].up in ("SELECT", "WITH"):
                return Ex(f"({self.scope.subquery(inner)})")
            parts = split_commas(inner)
            if len(parts) > 1:
                return Ex("array(" + ", ".join(self.sub(p).sql for p in parts) + ")", LIST)
            x = self.sub(inner)
            return Ex(f"({x.sql})", x.kind, x.literal)
        if t.text == "[":
            depth, start = 1, c.i
            while depth:
                u = c.next()
                depth += {"[": 1, "]": -1}.get(u.text, 0)
            inner = c.tokens[start : c.i - 1]
            names = len(inner) == 1 and inner[0].kind == "word"
            if names and (inner[0].text.lower() in self.scope.columns or c.now is not None and c.now.text == "."):
                return self.column(inner[0].text)
            if inner and all(u.kind == "word" for u in inner):
                return self.column(" ".join(u.text for u in inner))
            return Ex("array(" + ", ".join(self.sub(p).sql for p in split_commas(inner)) + ")", LIST)
        if t.kind == "quoted":
            return self.column(t.text[1:-1].replace('""', '"'))
        if t.kind == "op" and t.text == "*":
            return Ex("*")
        if t.kind != "word":
            raise ParseError(f"unexpected {t.text!r} in an expression")
        up = t.up
        if up in ("NULL", "TRUE", "FALSE"):
            return Ex(up.lower(), BOOL if up != "NULL" else None, True)
        if up == "CASE":
            return self.case()
        if up in ("CAST", "TRY_CAST") and c.at("("):
            inner = Cursor(c.inside())
            value = Parser(inner.until("AS"), self.scope).whole()
            inner.expect("AS")
            p = Parser(inner.tokens[inner.i :], self.scope)
            name = p.type_name()
            return Ex(library.cast(value.sql, name, up == "TRY_CAST"), kind_of_type(library.spark_type(name)))
        if up in ("EXISTS",) and c.at("("):
            return Ex(f"exists ({self.scope.subquery(c.inside())})", BOOL)
        if up == "NOT" and c.accept("EXISTS"):
            return Ex(f"(not exists ({self.scope.subquery(c.inside())}))", BOOL)
        if up in ("DATE", "TIMESTAMP", "DATETIME") and c.now is not None and c.now.kind == "string":
            s = c.next().text
            return Ex(f"date{s}" if up == "DATE" else f"timestamp_ntz{s}", DATE if up == "DATE" else STAMP)
        if c.at("("):
            return self.call(t.text)
        if up in _BARE and up.lower() not in self.scope.columns:
            return Ex(*_BARE[up])
        return self.column(t.text)

    def column(self, first: str) -> Ex:
        c = self.c
        path = [first]
        while c.now is not None and c.now.text == "." and c.peek() is not None:
            c.next()
            if c.accept("*"):
                return Ex(".".join(map(quote, path)) + ".*")
            path.append(c.name())
        key = ".".join(path).lower()
        kind = self.scope.columns.get(key, self.scope.columns.get(path[-1].lower()))
        return Ex(".".join(map(quote, path)), kind)

    def case(self) -> Ex:
        c = self.c
        base = None if c.at("WHEN") else self.conditional()
        out, kinds = "case", []
        while c.accept("WHEN"):
            when = self.conditional()
            c.expect("THEN")
            then = self.conditional()
            kinds.append(then.kind)
            if base is not None:
                a, b = self.soft(base, when)
                out += f" when {a} = {b} then {then.sql}"
            else:
                out += f" when {self.truth(when)} then {then.sql}"
        if c.accept("ELSE"):
            last = self.conditional()
            kinds.append(last.kind)
            out += f" else {last.sql}"
        c.expect("END")
        known = {k for k in kinds if k}
        return Ex(out + " end", known.pop() if len(known) == 1 else NUM if known and known <= {INT, NUM} else None)

    def call(self, name: str) -> Ex:
        c, up = self.c, name.upper()
        inner = c.inside()
        if up == "TRIM" and any(t.up in ("BOTH", "LEADING", "TRAILING", "FROM") for t in inner if t.kind == "word"):
            cur = Cursor(inner)
            side = cur.next().text if cur.now.up in ("BOTH", "LEADING", "TRAILING") else "both"
            what = cur.until("FROM")
            cur.expect("FROM")
            s = self.sub(cur.tokens[cur.i :]).sql
            return Ex(f"trim({side} {self.sub(what).sql if what else chr(39) + ' ' + chr(39)} from {s})", TEXT)
        if up == "EXTRACT":
            cur = Cursor(inner)
            part = cur.next().text
            cur.expect("FROM")
            return Ex(library.lower("DATEPART", [part, self.sub(cur.tokens[cur.i :]).sql]), INT)
        if up == "POSITION" and any(t.up == "IN" for t in inner):
            cur = Cursor(inner)
            find = cur.until("IN")
            cur.expect("IN")
            return Ex(f"position({self.sub(find).sql} in {self.sub(cur.tokens[cur.i :]).sql})", INT)
        if up == "OVERLAY":
            cur = Cursor(inner)
            parts = [self.sub(cur.until("PLACING"))]
            for w in ("PLACING", "FROM", "FOR"):
                if cur.accept(w):
                    parts.append(self.sub(cur.until("FROM", "FOR")))
            return Ex("overlay(" + ", ".join(p.sql for p in parts) + ")", TEXT)
        distinct = False
        if inner and inner[0].up == "DISTINCT":
            distinct, inner = True, inner[1:]
        order = ""
        if up in ("STRING_AGG", "LISTAGG"):
            cur = Cursor(inner)
            inner = cur.until("ORDER BY")
            order = self.order(cur) if cur.accept("ORDER", "BY") else ""
        parts = split_commas(inner)
        args: list[Ex] = []
        if up in _PART_FIRST and parts and len(parts[0]) == 1:
            args.append(Ex(parts[0][0].text))
            parts = parts[1:]
        if up in ("CONVERT", "TRY_CONVERT"):
            args.append(Ex("".join(t.text for t in parts[0])))
            parts = parts[1:]
        names: list[str | None] = []
        for p in parts:
            if len(p) > 2 and p[0].kind == "variable" and p[1].text == "=":
                names.append(p[0].text)
                p = p[2:]
            else:
                names.append(None)
            args.append(Ex("*") if len(p) == 1 and p[0].text == "*" else self.sub(p))
        custom = self.scope.function(name, args, names) if self.scope.function else None
        if custom is not None:
            return custom
        if distinct:
            if args and args[0].sql == "*":
                raise ParseError("COUNT(DISTINCT *)")
            sql = f"{library.RENAMED.get(up, name)}(distinct {', '.join(a.sql for a in args)})"
        else:
            sql = library.lower(name, [a.sql for a in args])
        kind = TEXT if up in _TEXT_FUNCTIONS else INT if up in _INT_FUNCTIONS else STAMP if up in _STAMP_FUNCTIONS else DATE if up in _DATE_FUNCTIONS else None
        if up in _SAME_AS_FIRST and args:
            kind = args[0].kind
        if up == "IIF" and len(args) > 2:
            sql = f"case when {self.truth(args[0])} then {args[1].sql} else {args[2].sql} end"
            kind = args[1].kind or args[2].kind
        if up in ("AVG", "ROUND", "SQRT", "SAFE_DIVIDE", "STDDEV", "RAND"):
            kind = NUM
        if c.accept("WITHIN", "GROUP"):
            cur = Cursor(c.inside())
            cur.expect("ORDER", "BY")
            sql += f" within group (order by {self.order(cur)})"
        elif order:
            sql += f" within group (order by {order})"
        filtered = None
        if c.accept("FILTER"):
            cur = Cursor(c.inside())
            cur.expect("WHERE")
            filtered = self.sub(cur.tokens[cur.i :]).sql
            if not c.at("OVER"):
                sql += f" filter (where {filtered})"
        if c.accept("OVER"):
            if filtered is not None:
                first = "1" if not args or args[0].sql == "*" else args[0].sql
                rest = "".join(", " + a.sql for a in args[1:])
                sql = f"{library.RENAMED.get(up, name)}(case when {filtered} then {first} end{rest})"
            if c.at("("):
                sql += f" over ({self.window(c.inside(), sql)})"
            else:
                w = c.name()
                if w.lower() not in self.scope.named_windows:
                    raise ParseError(f"unknown window {w}")
                sql += f" over ({self.scope.named_windows[w.lower()]})"
        return Ex(sql, kind)

    def order(self, cur: Cursor) -> str:
        """Sort keys, to the end of the cursor or the frame."""
        out = []
        for p in split_commas(cur.until("ROWS", "RANGE", "GROUPS")):
            k = Cursor(p)
            e = self.sub(k.until("ASC", "DESC", "NULLS"))
            out.append(" ".join([e.sql, *[t.text for t in k.tokens[k.i :]]]))
        return ", ".join(out)

    def window(self, tokens: list[Token], call: str) -> str:
        cur = Cursor(tokens)
        out = []
        if cur.now is not None and cur.now.kind == "word" and cur.now.up not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS"):
            w = cur.name()
            if w.lower() not in self.scope.named_windows:
                raise ParseError(f"unknown window {w}")
            out.append(self.scope.named_windows[w.lower()])
        if cur.accept("PARTITION", "BY"):
            out.append("partition by " + ", ".join(self.sub(p).sql for p in split_commas(cur.until("ORDER BY", "ROWS", "RANGE", "GROUPS"))))
        if cur.accept("ORDER", "BY"):
            out.append("order by " + self.order(cur))
        if cur.now is not None:
            if cur.now.up == "GROUPS" or any(t.up == "EXCLUDE" for t in cur.tokens[cur.i :]):
                raise ParseError("GROUPS frames and EXCLUDE are rewritten before expressions are read")
            out.append(" ".join(self.frame(cur)))
        elif not out and re.match(r"(?i)(row_number|rank|dense_rank|ntile|lag|lead|percent_rank|cume_dist|nth_value)\b", call):
            out.append("order by 1")
        return " ".join(out)

    def frame(self, cur: Cursor) -> list[str]:
        out = []
        while cur.now is not None:
            t = cur.next()
            out.append(self.scope.variable(t.text).sql if t.kind == "variable" and self.scope.variable else t.text)
        return out


def _numeric(x: Ex) -> bool:
    """Whether a text is a literal that reads as a number."""
    return x.literal and re.fullmatch(r"'[-+]?\d+(\.\d+)?'", x.sql) is not None


def parse(tokens: list[Token], scope: Scope) -> Ex:
    return Parser(tokens, scope).whole()
