"""Queries of the language to DataFrames: SELECT blocks become Spark SQL text, and the operators
that Spark SQL has no syntax for become DataFrame calls between them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import library
from ..operators import joins, pattern, recursion, reshape, windows
from ..operators.quality import Rule
from .expressions import LIST, TEXT, Parser, Scope, kind_of_type, quote
from .tokens import Cursor, ParseError, Token, split_commas

_CLAUSES = ("FROM", "WHERE", "GROUP BY", "HAVING", "WINDOW", "QUALIFY", "ORDER BY", "LIMIT", "OFFSET", "FETCH", "USING SAMPLE", "FOR JSON", "FOR XML", "ON FAILURE", "INTO")
_SETS = ("UNION", "EXCEPT", "MINUS", "INTERSECT")
_JOIN_STARTS = set("JOIN INNER LEFT RIGHT FULL CROSS OUTER SEMI ANTI ASOF FUZZY".split())
_NOT_ALIAS = _JOIN_STARTS | set("ON WHERE GROUP HAVING WINDOW QUALIFY ORDER LIMIT OFFSET FETCH USING FOR INTO UNION EXCEPT MINUS INTERSECT PIVOT UNPIVOT MATCH_RECOGNIZE WITH LATERAL KEEP SET WHEN".split())


@dataclass
class Relation:
    """A FROM item: Spark SQL text, and the columns its alias has."""

    sql: str
    alias: str
    columns: list[tuple[str, str]]
    df: DataFrame | None = None
    watermark: dict | None = None


@dataclass
class Source:
    """The relations joined so far. In packed form each alias is one struct column of a single view."""

    sql: str = ""
    relations: list[Relation] = field(default_factory=list)
    packed: bool = False


@dataclass
class Result:
    """A query's rows, where they go, and its data-quality clauses."""

    df: DataFrame
    into: str | None = None
    rules: list[Rule] = field(default_factory=list)
    quarantine: str | None = None
    source: DataFrame | None = None


class Compiler:
    """Compiles queries for a session (see session.Session for what it must offer)."""

    def __init__(self, session, ctes: dict[str, DataFrame] | None = None, outer: Scope | None = None):
        self.session, self.ctes, self.outer = session, dict(ctes or {}), outer

    # --- whole queries -------------------------------------------------------------------------------------------------

    def frame(self, tokens: list[Token]) -> DataFrame:
        return self.result(tokens).df

    def run(self, sql: str) -> DataFrame:
        return self.session.spark.sql(sql)

    def view(self, df: DataFrame) -> str:
        return self.session.register_view(df)

    def result(self, tokens: list[Token]) -> Result:
        """A query with its WITH clause, set operations and final order."""
        c = Cursor(tokens)
        me = Compiler(self.session, self.ctes, self.outer)
        if c.accept("WITH"):
            me.common_tables(c)
            return me.result(c.tokens[c.i :])
        parts, ops = self.operands(c.tokens[c.i :])
        if not ops:
            return me.operand(parts[0])
        # a trailing ORDER BY or LIMIT belongs to the whole
        last = Cursor(parts[-1])
        if last.now is not None and last.now.text == "(" :
            last.inside()
            tail = last.tokens[last.i :]
            parts[-1] = last.tokens[: last.i]
        else:
            body = last.until("ORDER BY", "LIMIT", "OFFSET", "FETCH", "FOR JSON", "FOR XML")
            tail = last.tokens[last.i :]
            parts[-1] = body
        into = None
        frames = []
        for p in parts:
            r = me.operand(p)
            into = into or r.into
            frames.append(r.df)
        df = frames[0]
        stack = [df]
        pending: list[str] = []

        def apply(a: DataFrame, op: str, b: DataFrame) -> DataFrame:
            if op.endswith("BY NAME"):
                return reshape.union_by_name(a, b, distinct="ALL" not in op)
            if len(a.columns) != len(b.columns):
                raise ParseError("set operands have different numbers of columns")
            b = b.toDF(*a.columns)
            if op == "UNION ALL":
                return a.union(b)
            if op == "UNION":
                return a.union(b).distinct()
            return a.intersect(b) if op == "INTERSECT" else a.subtract(b)

        for op, b in zip(ops, frames[1:], strict=True):
            if op == "INTERSECT":
                stack[-1] = apply(stack[-1], op, b)
            else:
                pending.append(op)
                stack.append(b)
        df = stack[0]
        for op, b in zip(pending, stack[1:], strict=True):
            df = apply(df, op, b)
        if tail:
            name = me.view(df)
            df = me.run(f"select * from {name} {me.tail_sql(tail, df)}")
        return Result(df, into)

    def operands(self, tokens: list[Token]) -> tuple[list[list[Token]], list[str]]:
        c, parts, ops = Cursor(tokens), [], []
        while True:
            parts.append(c.until(*_SETS))
            if c.now is None:
                return parts, ops
            op = c.next().up
            op = "EXCEPT" if op == "MINUS" else op
            if c.accept("ALL"):
                op += " ALL"
            c.accept("DISTINCT")
            if c.accept("BY", "NAME"):
                op += " BY NAME"
            ops.append(op)

    def tail_sql(self, tokens: list[Token], df: DataFrame) -> str:
        c = Cursor(tokens)
        scope = self.scope([Relation("", "", df.dtypes)])
        out = ""
        if c.accept("ORDER", "BY"):
            out += " order by " + self.order_sql(c.until("LIMIT", "OFFSET", "FETCH"), scope)
        return out + self.limit_sql(c, scope)

    def operand(self, tokens: list[Token]) -> Result:
        c = Cursor(tokens)
        if c.at("("):
            inner = c.inside()
            if c.now is None:
                return Compiler(self.session, self.ctes, self.outer).result(inner)
        if c.accept("VALUES"):
            return Result(self.values(c.tokens[c.i :], None))
        if c.accept("PIVOT"):
            return Result(self.pivot_statement(c))
        if c.accept("UNPIVOT"):
            return Result(self.unpivot_statement(c))
        return self.block(tokens)

    def common_tables(self, c: Cursor) -> None:
        recursive = c.accept("RECURSIVE")
        while True:
            name = c.name()
            columns = [t[0].text for t in split_commas(c.inside())] if c.at("(") else None
            c.expect("AS")
            body = c.inside()
            refers = any(t.kind in ("word", "quoted") and t.text.strip('"').lower() == name.lower() for t in body)
            parts, ops = self.operands(body)
            if (recursive or refers) and refers and len(parts) > 1 and ops[0].startswith("UNION"):
                df = self.recursive(name, columns, parts, ops)
            else:
                df = Compiler(self.session, self.ctes, self.outer).frame(body)
                df = df.toDF(*columns) if columns else df
            self.ctes[name.lower()] = df
            if not c.accept(","):
                return

    def recursive(self, name: str, columns: list[str] | None, parts: list[list[Token]], ops: list[str]) -> DataFrame:
        anchor = Compiler(self.session, self.ctes).frame(parts[0])
        anchor = anchor.toDF(*columns) if columns else anchor

        def step(new: DataFrame) -> DataFrame:
            out = None
            for p in parts[1:]:
                rows = Compiler(self.session, self.ctes | {name.lower(): new}).frame(p).toDF(*anchor.columns)
                out = rows if out is None else out.union(rows)
            return out

        return recursion.recursive(anchor, step, distinct="ALL" not in ops[0], max_depth=self.session.max_recursion)

    def values(self, tokens: list[Token], names: list[str] | None) -> DataFrame:
        rows = [split_commas(Cursor(p).inside()) for p in split_commas(tokens)]
        if len({len(r) for r in rows}) != 1:
            raise ParseError("rows of VALUES differ in length")
        scope = self.scope([])
        names = names or [f"column{i + 1}" for i in range(len(rows[0]))]
        text = ", ".join("(" + ", ".join(Parser(v, scope).whole().sql for v in r) + ")" for r in rows)
        return self.run(f"select * from values {text} as t({', '.join(map(quote, names))})")

    # --- scopes --------------------------------------------------------------------------------------------------------

    def scope(self, relations: list[Relation], packed: bool = False) -> Scope:
        columns: dict[str, str | None] = dict(self.outer.columns) if self.outer else {}
        for r in relations:
            for c, t in r.columns:
                columns[c.lower()] = kind_of_type(t)
                if r.alias:
                    columns[f"{r.alias}.{c}".lower()] = kind_of_type(t)
        out = Scope(columns, self.session.variable, None, self.session.user_function, {}, self.session.case_sensitive, self.session.set_values)
        out.subquery = lambda tokens: self.subquery_sql(tokens, out)
        return out

    def subquery_sql(self, tokens: list[Token], scope: Scope) -> str:
        """A subquery as text, so that Spark sees its outer references."""
        return Compiler(self.session, self.ctes, scope).text(tokens)

    def text(self, tokens: list[Token]) -> str:
        """A query as Spark SQL text; only plain blocks keep outer references."""
        c = Cursor(tokens)
        if c.at("WITH"):
            return f"select * from {self.view(self.frame(tokens))}"
        parts, ops = self.operands(tokens)
        if ops and not any("BY NAME" in o for o in ops):
            out = self.text(parts[0])
            for o, p in zip(ops, parts[1:], strict=True):
                out += f" {o.lower()} {self.text(p)}"
            return out
        if not ops and c.at("SELECT"):
            plain = self.block_sql(tokens)
            if plain is not None:
                return plain
        return f"select * from {self.view(self.frame(tokens))}"

    # --- FROM ----------------------------------------------------------------------------------------------------------

    def primary(self, c: Cursor) -> Relation:
        lateral = c.accept("LATERAL")
        df, columns, sql = None, None, None
        if c.at("("):
            inner = c.inside()
            if inner and inner[0].up == "VALUES":
                c.accept("AS")
                alias = c.name()
                names = [t[0].text for t in split_commas(c.inside())] if c.at("(") else None
                df = self.values(inner[1:], names)
                return self.suffix(c, Relation(f"{self.view(df)} as {quote(alias)}", alias, df.dtypes, df))
            if lateral:
                body = Compiler(self.session, self.ctes, self.outer_with(self.joined)).text(inner)
                alias, names = self.alias(c)
                columns = self.lateral_columns(inner)
                sql = f"lateral ({body}) as {quote(alias)}"
                return Relation(sql, alias, columns)
            df = Compiler(self.session, self.ctes, self.outer).frame(inner)
        else:
            name = c.name()
            while c.now is not None and c.now.text == "." and c.peek() is not None:
                c.next()
                name += "." + c.name()
            if c.at("(") and name.upper() not in self.ctes:
                return self.suffix(c, self.table_function(name, c, lateral))
            df = self.ctes.get(name.lower())
            if df is None:
                df = self.session.table(name)
            watermark = None
            if c.at("WITH") and c.peek() is not None and c.peek().text == "(":
                c.next()
                watermark = self.options(c.inside())
            default = name.split(".")[-1].lstrip("#&")
            alias, names = self.alias(c, default)
            if names:
                df = df.toDF(*names)
            if watermark is not None:
                df = self.session.high_water(df, name, watermark)
            return self.suffix(c, Relation(f"{self.view(df)} as {quote(alias)}", alias, df.dtypes, df))
        alias, names = self.alias(c, f"q{id(df) % 10**6}")
        if names:
            df = df.toDF(*names)
        return self.suffix(c, Relation(f"{self.view(df)} as {quote(alias)}", alias, df.dtypes, df))

    def outer_with(self, relations: list[Relation]) -> Scope:
        return self.scope(relations)

    def lateral_columns(self, tokens: list[Token]) -> list[tuple[str, str]]:
        """Column names of a lateral subquery, as far as its items name them."""
        c = Cursor(tokens)
        if not c.accept("SELECT"):
            return []
        c.accept("DISTINCT")
        if c.accept("TOP"):
            c.next()
        out = []
        for item in split_commas(c.until(*_CLAUSES)):
            if item[-1].kind in ("word", "quoted"):
                out.append((item[-1].text.strip('"'), "unknown"))
        return out

    def alias(self, c: Cursor, default: str | None = None) -> tuple[str, list[str] | None]:
        given = c.accept("AS")
        t = c.now
        if given or t is not None and (t.kind == "quoted" or t.kind == "word" and t.up not in _NOT_ALIAS):
            name = c.name()
        elif default is not None:
            name = default
        else:
            raise ParseError("a derived table needs an alias")
        names = [p[0].text.strip('"') for p in split_commas(c.inside())] if given and c.at("(") else None
        return name, names

    def options(self, tokens: list[Token]) -> dict[str, object]:
        out: dict[str, object] = {}
        for p in split_commas(tokens):
            key = p[0].up
            if len(p) == 1:
                out[key] = True
            else:
                out[key] = self.session.scalar(p[2:])
        return out

    def table_function(self, name: str, c: Cursor, lateral: bool) -> Relation:
        up = name.upper()
        scope = self.outer_with(self.joined) if self.joined else self.scope([])
        inner = c.inside()
        if up in ("JSON_TABLE", "XMLTABLE"):
            rows, kinds = self.document_table(up, inner, scope)
            alias, _ = self.alias(c, up.lower())
            fields = ", ".join(f"r.{quote(n)} as {quote(n)}" for n, _ in kinds)
            return Relation(f"lateral (select {fields} from explode({rows}) as x(r)) as {quote(alias)}" if self.joined else f"(select {fields} from (select explode({rows}) as r)) as {quote(alias)}", alias, kinds)
        args = [Parser(p, scope).whole() for p in split_commas(inner)]
        if up == "OPENJSON":
            path = args[1].sql if len(args) > 1 else "'$'"
            doc = f"try_variant_get(try_parse_json({args[0].sql}), {path}, 'variant')"
            as_map = f"transform(map_entries(try_variant_get({doc}, '$', 'map<string,variant>')), e -> struct(e.key as key, e.value as v))"
            as_list = f"transform(try_variant_get({doc}, '$', 'array<variant>'), (v, i) -> struct(cast(i as string) as key, v as v))"
            rows = f"transform(coalesce({as_map}, {as_list}), e -> struct(e.key as key, coalesce(try_variant_get(e.v, '$', 'string'), to_json(e.v)) as value))"
            alias, _ = self.alias(c, "openjson")
            fields = "r.key as `key`, r.value as `value`"
            kinds = [("key", "string"), ("value", "string")]
            return Relation(f"lateral (select {fields} from explode({rows}) as x(r)) as {quote(alias)}" if self.joined else f"(select {fields} from (select explode({rows}) as r)) as {quote(alias)}", alias, kinds)
        if up not in library.TABLE_FUNCTIONS:
            df = self.session.table_function(name, args)
            alias, _ = self.alias(c, name.lower())
            return Relation(f"{self.view(df)} as {quote(alias)}", alias, df.dtypes, df)
        column = "value" if up == "GENERATE_SERIES" else "Value"
        array = library.TABLE_FUNCTIONS[up]([a.sql for a in args])
        if up == "GENERATE_SERIES":
            array = self.series([a.sql for a in args])
        if up in ("UNNEST", "FLATTEN"):
            array = args[0].sql if args[0].kind == LIST or args[0].kind is None else f"array({args[0].sql})"
            if up == "FLATTEN":
                array = f"flatten({array})" if "array(array(" in array.lower().replace(" ", "") else array
        alias, names = self.alias(c, up.lower())
        column = names[0] if names else column
        kind = "bigint" if up == "GENERATE_SERIES" else "string"
        if self.joined:
            return Relation(f"lateral explode({array}) as {quote(alias)}({quote(column)})", alias, [(column, kind)])
        return Relation(f"(select explode({array}) as {quote(column)}) as {quote(alias)}", alias, [(column, kind)])

    @staticmethod
    def series(args: list[str]) -> str:
        """An inclusive series; empty where it cannot reach the end, none for nulls, an error for step 0."""
        a, b = args[0], args[1]
        step = args[2] if len(args) > 2 else "1"
        guard = f"case when {step} = 0 then raise_error('step 0') when {step} > 0 then {a} <= {b} else {a} >= {b} end" if len(args) > 2 else f"{a} <= {b}"
        return f"case when {guard} then sequence({a}, {b}, {step}) end"

    def document_table(self, up: str, tokens: list[Token], scope: Scope) -> tuple[str, list[tuple[str, str]]]:
        """JSON_TABLE and XMLTABLE: an array of structs, and its fields."""
        c = Cursor(tokens)
        doc = Parser(c.until(","), scope).whole().sql
        c.expect(",")
        path = c.next().text.strip("'")
        c.accept(",")
        c.expect("COLUMNS")
        fields = []
        for p in split_commas(c.inside()):
            pc = Cursor(p)
            name = pc.name()
            kind = library.spark_type("".join(t.text for t in pc.until("PATH")))
            at = None
            if pc.accept("PATH"):
                at = pc.next().text.strip("'")
            fields.append((name, kind, at))
        if up == "JSON_TABLE":
            base = path[:-3] if path.endswith("[*]") else path
            source = f"try_variant_get(try_parse_json({doc}), '{base}', '{'array<variant>' if path.endswith('[*]') else 'variant'}')"
            rows = source if path.endswith("[*]") else f"array({source})"
            items = ", ".join(f"cast(try_variant_get(v, '{a or '$.' + n}', 'string') as {k}) as {quote(n)}" for n, k, a in fields)
            return f"transform({rows}, v -> struct({items}))", [(n, k) for n, k, _ in fields]
        # one list of texts for each column, zipped
        lists = [f"xpath({doc}, '{path}/{(a or n)}{'' if (a or n).startswith('@') or (a or n).endswith('text()') else '/text()'}')" for n, _, a in fields]
        zipped = f"arrays_zip({', '.join(lists)})"
        items = ", ".join(f"cast(z.`{i}` as {k}) as {quote(n)}" for i, (n, k, _) in enumerate(fields))
        return f"transform({zipped}, z -> struct({items}))", [(n, k) for n, k, _ in fields]

    def suffix(self, c: Cursor, r: Relation) -> Relation:
        """PIVOT, UNPIVOT and MATCH_RECOGNIZE after a FROM item."""
        while c.now is not None and c.now.up in ("PIVOT", "UNPIVOT", "MATCH_RECOGNIZE"):
            what = c.next().up
            df = r.df if r.df is not None else self.run(f"select * from {r.sql}")
            inner = Cursor(c.inside())
            if what == "PIVOT":
                df = self.pivot_clause(df, inner)
            elif what == "UNPIVOT":
                value = inner.name()
                inner.expect("FOR")
                name = inner.name()
                inner.expect("IN")
                df = reshape.unpivot(df, [Cursor(p).name() for p in split_commas(inner.inside())], name, value)
            else:
                df = self.match(df, inner)
            alias, _ = self.alias(c, r.alias)
            r = Relation(f"{self.view(df)} as {quote(alias)}", alias, df.dtypes, df)
        return r

    def pivot_clause(self, df: DataFrame, c: Cursor) -> DataFrame:
        scope = self.scope([Relation("", "", df.dtypes)])
        agg = Parser(c.until("FOR"), scope).whole().sql
        c.expect("FOR")
        column = c.name()
        c.expect("IN")
        values, names = [], []
        for p in split_commas(c.inside()):
            pc = Cursor(p)
            t = pc.next()
            value = t.text[1:-1] if t.kind in ("string", "quoted") else pc.name() if t.text == "[" else int(t.text) if t.kind == "number" and t.text.isdigit() else t.text
            if t.text == "[":
                value = p[1].text
            values.append(value)
            names.append(pc.name() if pc.accept("AS") else None)
        used = {column.lower()} | {t.lower() for t in re.findall(r"`([^`]+)`", agg)}
        group = [x for x in df.columns if x.lower() not in used]
        kinds = {a.lower(): t for a, t in df.dtypes}
        if kinds[column.lower()].startswith(("int", "bigint", "smallint")):
            values = [int(v) for v in values]
        elif not kinds[column.lower()].startswith(("decimal", "double")):
            values = [str(v) for v in values]
        out = df.groupBy(*group).pivot(column, values).agg(F.expr(agg))
        for v, n in zip(values, names, strict=True):
            if n:
                out = out.withColumnRenamed(str(v), n)
        return out

    def pivot_statement(self, c: Cursor) -> DataFrame:
        """PIVOT source ON column [IN (..)] USING aggregates [GROUP BY columns]."""
        r = self.statement_source(c)
        c.expect("ON")
        column = c.name()
        values = None
        if c.accept("IN"):
            values = [self.session.scalar(p) for p in split_commas(c.inside())]
        c.expect("USING")
        scope = self.scope([Relation("", "", r.dtypes)])
        using = {}
        for p in split_commas(c.until("GROUP BY")):
            pc = Cursor(p)
            e = Parser(pc.until("AS"), scope).whole().sql
            using[pc.name() if pc.accept("AS") else e] = F.expr(e)
        group = None
        if c.accept("GROUP", "BY"):
            group = [Cursor(p).name() for p in split_commas(c.until())]
        else:
            used = {column.lower()} | {x.lower() for e in using for x in re.findall(r"`([^`]+)`", e)}
            used |= {x.lower() for a in using.values() for x in re.findall(r"\w+", str(a))}
            group = [x for x in r.columns if x.lower() not in used]
        return reshape.pivot(r, column, using, group, values)

    def unpivot_statement(self, c: Cursor) -> DataFrame:
        """UNPIVOT source ON columns | COLUMNS(..) INTO NAME n VALUE v."""
        r = self.statement_source(c)
        c.expect("ON")
        columns: list[str] = []
        for p in split_commas(c.until("INTO")):
            pc = Cursor(p)
            if pc.at("COLUMNS") and pc.peek() is not None and pc.peek().text == "(":
                pc.next()
                columns += self.selected_columns(r.columns, pc.inside())
            else:
                columns.append(pc.name())
        c.expect("INTO")
        c.expect("NAME")
        name = c.name()
        c.expect("VALUE")
        return reshape.unpivot(r, columns, name, c.name())

    def statement_source(self, c: Cursor) -> DataFrame:
        if c.at("("):
            return Compiler(self.session, self.ctes).frame(c.inside())
        name = c.name()
        return self.ctes[name.lower()] if name.lower() in self.ctes else self.session.table(name)

    @staticmethod
    def selected_columns(columns: list[str], tokens: list[Token]) -> list[str]:
        """COLUMNS(*), COLUMNS(* EXCLUDE (..)) and COLUMNS('regex')."""
        c = Cursor(tokens)
        if c.now is not None and c.now.kind == "string":
            rx = c.next().text[1:-1]
            return [x for x in columns if re.search(rx, x, re.I)]
        c.expect("*")
        gone = set()
        if c.accept("EXCLUDE"):
            gone = {Cursor(p).name().lower() for p in split_commas(c.inside())} if c.at("(") else {c.name().lower()}
        return [x for x in columns if x.lower() not in gone]

    def match(self, df: DataFrame, c: Cursor) -> DataFrame:
        """MATCH_RECOGNIZE ( ... )."""
        text = lambda ts: " ".join(t.text for t in ts).replace(" . ", ".").replace("( ", "(").replace(" )", ")").replace(" (", "(")
        partition: list[str] = []
        measures: dict[str, str] = {}
        define: dict[str, str] = {}
        all_rows = False
        order, pat = "", ""
        while c.now is not None:
            if c.accept("PARTITION", "BY"):
                partition = [Cursor(p).name() for p in split_commas(c.until("ORDER BY"))]
            elif c.accept("ORDER", "BY"):
                order = text(c.until("MEASURES", "ONE ROW", "ALL ROWS", "PATTERN"))
            elif c.accept("MEASURES"):
                for p in split_commas(c.until("ONE ROW", "ALL ROWS", "PATTERN", "AFTER")):
                    pc = Cursor(p)
                    e = text(pc.until("AS"))
                    pc.expect("AS")
                    measures[pc.name()] = e
            elif c.accept("ONE", "ROW", "PER", "MATCH"):
                pass
            elif c.accept("ALL", "ROWS", "PER", "MATCH"):
                all_rows = True
            elif c.accept("AFTER", "MATCH"):
                c.until("PATTERN")
            elif c.accept("PATTERN"):
                pat = "".join(t.text if t.kind != "word" else f" {t.text}" for t in c.inside())
            elif c.accept("DEFINE"):
                for p in split_commas(c.until()):
                    pc = Cursor(p)
                    name = pc.name()
                    pc.expect("AS")
                    define[name] = text(pc.tokens[pc.i :])
            else:
                raise ParseError(f"unexpected {c.now.text!r} in MATCH_RECOGNIZE")
        return pattern.match_recognize(df, order, pat, define, measures, partition, all_rows)

    joined: list[Relation] = []

    def source(self, tokens: list[Token]) -> Source:
        """The FROM clause."""
        c = Cursor(tokens)
        self.joined = []
        first = self.primary(c)
        src = Source(first.sql, [first])
        self.joined = src.relations
        while c.now is not None:
            if c.accept(","):
                r = self.primary(c)
                src.sql += f", {r.sql}" if r.sql.startswith("lateral") else f" cross join {r.sql}"
                src.relations.append(r)
                continue
            kind = ""
            if c.accept("CROSS", "APPLY") or c.at("OUTER", "APPLY"):
                outer = c.accept("OUTER", "APPLY")
                r = self.applied(c)
                src.sql += f" {'left' if outer else 'inner'} join {r.sql}" + (" on true" if outer else "")
                src.relations.append(r)
                continue
            while c.now is not None and c.now.up in _JOIN_STARTS | {"HASH", "LOOP", "MERGE"} and c.now.up != "JOIN":
                kind += c.next().up + " "
            c.expect("JOIN")
            words = kind.split()
            hint = next((w for w in words if w in ("HASH", "LOOP", "MERGE")), None)
            if hint:
                words.remove(hint)
            r = self.primary(c)
            keep = None
            if "ASOF" in words or "FUZZY" in words:
                c.expect("ON")
                on = c.until(",", "KEEP BEST", *_JOIN_STARTS)
                if c.accept("KEEP", "BEST"):
                    keep = int(self.session.scalar([c.next()]))
                how = "left" if "LEFT" in words else "inner"
                src = self.asof(src, r, on, how) if "ASOF" in words else self.fuzzy(src, r, on, how, keep)
                self.joined = src.relations
                continue
            if "SEMI" in words or "ANTI" in words:
                name = "left " + ("semi" if "SEMI" in words else "anti")
            else:
                name = " ".join(w for w in words if w != "OUTER").lower() or "inner"
            if name == "full":
                # generated code holds all pairs of a key at once; the plain scan holds its rows and yields pair by pair
                self.session.spark.conf.set("spark.sql.codegen.join.fullOuterSortMergeJoin.enabled", "false")
            on_sql = ""
            scope_relations = [*src.relations, r]
            if c.accept("ON"):
                on = c.until(",", *_JOIN_STARTS)
                on_sql = " on " + Parser(on, self.scope(scope_relations)).whole().sql
            src.sql += f" {name} join {r.sql}{on_sql}"
            if "SEMI" not in words and "ANTI" not in words:
                src.relations.append(r)
        return src

    def applied(self, c: Cursor) -> Relation:
        if c.at("("):
            inner = c.inside()
            body = Compiler(self.session, self.ctes, self.scope(self.joined)).text(inner)
            alias, _ = self.alias(c, "applied")
            return Relation(f"lateral ({body}) as {quote(alias)}", alias, self.lateral_columns(inner))
        return self.primary(c)

    def pack(self, src: Source, extra: list[str] = (), where: str = "") -> tuple[DataFrame, Source]:
        """The relations as one view with a struct column for each alias (and extra columns)."""
        if src.packed:
            items = [quote(r.alias) for r in src.relations if r.alias != "__flat"] + [quote(n) for r in src.relations if r.alias == "__flat" for n, _ in r.columns]
        else:
            items = [f"struct({quote(r.alias)}.*) as {quote(r.alias)}" for r in src.relations]
        df = self.run(f"select {', '.join([*items, *extra])} from {src.sql}{where}")
        return df, Source(f"{self.view(df)}", src.relations, True)

    def qualified(self, tokens: list[Token], relations: list[Relation]) -> list[Token]:
        """Column names with their alias, where one relation alone has them."""
        owner: dict[str, list[str]] = {}
        for r in relations:
            for n, _ in r.columns:
                owner.setdefault(n.lower(), []).append(r.alias)
        out: list[Token] = []
        for i, t in enumerate(tokens):
            after = tokens[i + 1].text if i + 1 < len(tokens) else ""
            before = tokens[i - 1].text if i else ""
            name = t.text.strip('"').lower()
            if t.kind in ("word", "quoted") and before != "." and after not in (".", "(") and len(owner.get(name, [])) == 1 and owner[name][0] != "__flat":
                out += [Token("quoted", f'"{owner[name][0]}"', t.start, t.end), Token("punct", ".", t.start, t.end)]
            out.append(t)
        return out

    def asof(self, src: Source, r: Relation, on: list[Token], how: str) -> Source:
        equal, ordered = [], []
        relations = [*src.relations, r]
        c = Cursor(self.qualified(on, relations))
        while c.now is not None:
            part = c.until("AND")
            c.accept("AND")
            pc = Cursor(part)
            left = pc.until("=", "==", "<", "<=", ">", ">=")
            op = pc.next().text
            right = pc.tokens[pc.i :]
            mine = any(t.kind in ("word", "quoted") and t.text.strip('"').lower() == r.alias.lower() for t in left)
            if mine:
                left, right = right, left
                op = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
            (equal if op in ("=", "==") else ordered).append((left, op, right))
        if len(ordered) != 1:
            raise ParseError("ASOF JOIN needs exactly one inequality")
        ls, rs = self.scope(src.relations), self.scope([r])
        lx = [Parser(a, ls).whole().sql for a, _, _ in equal] + [Parser(ordered[0][0], ls).whole().sql]
        rx = [Parser(b, rs).whole().sql for _, _, b in equal] + [Parser(ordered[0][2], rs).whole().sql]
        left_df, packed = self.pack(src, [f"{x} as __l{i}" for i, x in enumerate(lx)])
        right_df = self.run(f"select struct({quote(r.alias)}.*) as {quote(r.alias)}, {', '.join(f'{x} as __r{i}' for i, x in enumerate(rx))} from {r.sql}")
        n = len(lx) - 1
        out = joins.asof_join(left_df, right_df, f"__l{n}", f"__r{n}", [(f"__l{i}", f"__r{i}") for i in range(n)], ordered[0][1], how)
        out = out.drop(*[f"__l{i}" for i in range(n + 1)], *[f"__r{i}" for i in range(n + 1)])
        return Source(self.view(out), relations, True)

    def fuzzy(self, src: Source, r: Relation, on: list[Token], how: str, keep: int | None) -> Source:
        relations = [*src.relations, r]
        c = Cursor(self.qualified(on, relations))
        left = c.until(">", ">=", "<", "<=")
        op = c.next().text
        limit = c.tokens[c.i :]
        if any(t.up == "SIMILARITY" for t in limit):
            left, limit = limit, left
            op = {"<": ">", "<=": ">="}.get(op, op)
        lc = Cursor(left)
        lc.expect("SIMILARITY")
        args = split_commas(lc.inside())
        a, b = args[0], args[1]
        if any(t.text.strip('"').lower() == r.alias.lower() for t in a):
            a, b = b, a
        mode = args[2][0].text.strip("'") if len(args) > 2 else "JAROWINKLER"
        left_df, _ = self.pack(src, [f"{Parser(a, self.scope(src.relations)).whole().sql} as __l"])
        right_df = self.run(f"select struct({quote(r.alias)}.*) as {quote(r.alias)}, {Parser(b, self.scope([r])).whole().sql} as __r from {r.sql}")
        out = joins.fuzzy_join(left_df, right_df, "__l", "__r", float(self.session.scalar(limit)), mode, op, keep, how).drop("__l", "__r")
        return Source(self.view(out), [*relations, Relation("", "__flat", [("__score", "double")])], True)

    # --- SELECT --------------------------------------------------------------------------------------------------------

    def order_sql(self, tokens: list[Token], scope: Scope, aliases: dict[str, list[Token]] | None = None) -> str:
        if len(tokens) in (1, 2) and tokens[0].up == "ALL":
            return "all" + (" desc" if len(tokens) == 2 and tokens[1].up == "DESC" else "")
        out = []
        for p in split_commas(tokens):
            c = Cursor(p)
            e = Parser(c.until("ASC", "DESC", "NULLS"), scope).whole()
            text = e.sql
            if e.kind == TEXT and not scope.case_sensitive and not e.literal:
                text = f"lower({text})"
            out.append(" ".join([text, *[t.text for t in c.tokens[c.i :]]]))
        return ", ".join(out)

    def limit_sql(self, c: Cursor, scope: Scope) -> str:
        """LIMIT, OFFSET and FETCH in any order."""
        limit = offset = None
        value = lambda ts: Parser(ts, scope).whole().sql
        while c.now is not None:
            if c.accept("LIMIT"):
                limit = value(c.until("OFFSET", "FETCH", "LIMIT"))
            elif c.accept("OFFSET"):
                ts = c.until("LIMIT", "FETCH", "ROWS", "ROW")
                c.accept("ROWS") or c.accept("ROW")
                offset = value(ts)
            elif c.accept("FETCH"):
                c.accept("FIRST") or c.accept("NEXT")
                ts = c.until("ROWS", "ROW", "ONLY")
                c.accept("ROWS") or c.accept("ROW")
                c.accept("ONLY")
                limit = value(ts) if ts else "1"
            else:
                raise ParseError(f"unexpected {c.now.text!r}")
        return (f" limit {limit}" if limit else "") + (f" offset {offset}" if offset else "")

    def clauses(self, tokens: list[Token]) -> dict[str, list[Token]]:
        c = Cursor(tokens)
        c.expect("SELECT")
        out: dict[str, list[Token]] = {}
        if c.accept("DISTINCT"):
            out["DISTINCT"] = []
        else:
            c.accept("ALL")
        if c.accept("TOP"):
            out["TOP"] = c.inside() if c.at("(") else [c.next()]
            if c.accept("PERCENT"):
                out["PERCENT"] = []
            if c.accept("WITH", "TIES"):
                out["TIES"] = []
            if c.accept("DISTINCT"):
                out["DISTINCT"] = []
        out["SELECT"] = self.select_list(c)
        limits: list[Token] = []
        while c.now is not None:
            for clause in _CLAUSES:
                words = clause.split()
                if c.at(*words):
                    start = c.i
                    c.i += len(words)
                    stops = [x for x in _CLAUSES if x != clause or clause in ("LIMIT",)]
                    body = c.until(*stops)
                    if clause in ("LIMIT", "OFFSET", "FETCH"):
                        limits += c.tokens[start : c.i]
                    else:
                        out[clause] = body
                    break
            else:
                raise ParseError(f"unexpected {c.now.text!r} after a query")
        if limits:
            out["LIMIT"] = limits
        return out

    @staticmethod
    def select_list(c: Cursor) -> list[Token]:
        """The select list: ON FAILURE inside it belongs to an item's rules, not to the query."""
        start = c.i
        while True:
            c.until(*_CLAUSES)
            if c.at("ON", "FAILURE"):
                rest = Cursor(c.tokens[c.i :])
                rest.until("FROM")
                if rest.now is not None:
                    c.i += 2
                    continue
            return c.tokens[start : c.i]

    def items(self, tokens: list[Token], src: Source, scope: Scope) -> tuple[list[tuple[str, str | None]], list[Rule], dict[str, list[Token]]]:
        """(text, alias) of the select list, rules of EXPECT, and the tokens behind each alias."""
        out: list[tuple[str, str | None]] = []
        rules: list[Rule] = []
        behind: dict[str, list[Token]] = {}
        for p in split_commas(tokens):
            c = Cursor(p)
            star = c.at("*")
            owner = None
            if not star and len(p) >= 3 and p[1].text == "." and p[2].text == "*":
                owner, star = p[0].text.strip('"'), True
                c.i = 2
            if star:
                c.next()
                out += self.star(c, owner, src, scope)
                continue
            if c.at("COLUMNS") and c.peek() is not None and c.peek().text == "(":
                c.next()
                names = [n for r in src.relations for n, _ in r.columns]
                out += [(quote(n), None) for n in self.selected_columns(names, c.inside())]
                continue
            body = c.until("AS", "EXPECT", "ON FAILURE")
            alias = None
            if c.accept("AS"):
                alias = c.next().text.strip("'\"") if c.now.kind == "string" else c.name()
            elif len(body) > 1 and body[-1].kind in ("word", "quoted") and body[-1].up not in ("END", "NULL", "TRUE", "FALSE") and body[-2].text not in (".", "(", ",") and body[-2].kind != "op" and body[-2].up not in ("AND", "OR", "NOT", "THEN", "ELSE", "WHEN", "CASE", "IS", "ZONE", "OVER", "LIKE", "ILIKE", "IN", "BETWEEN", "DISTINCT", "FROM", "ESCAPE"):
                alias = body[-1].text.strip('"')
                body = body[:-1]
            x = Parser(body, scope).whole()
            if alias is None:
                alias = body[-1].text.strip('"') if len(body) in (1, 3) and body[-1].kind in ("word", "quoted") and x.sql.startswith("`") else body[-2].text if len(body) > 2 and body[-1].text == "]" and x.sql.startswith("`") else None
            if alias:
                behind[alias.lower()] = body
            while c.accept("EXPECT"):
                rules += self.expectations(c, alias or x.sql.strip("`"), scope)
                if alias is None:
                    c.accept("AS") and c.name()
            if c.accept("AS"):
                new = c.name()
                rules = [Rule(new, r.kind, r.args, r.action) if r.column == alias else r for r in rules]
                alias = new
            out.append((x.sql, alias))
        return out, rules, behind

    def expectations(self, c: Cursor, column: str, scope: Scope) -> list[Rule]:
        """Rules after EXPECT, up to the next EXPECT; each with its ON FAILURE action."""
        out: list[Rule] = []

        def values(tokens: list[Token]) -> tuple:
            return tuple(self.session.scalar(p) for p in split_commas(tokens))

        def one() -> Rule:
            no = c.accept("NOT")
            if no and c.accept("NULL"):
                return Rule(column, "NOT NULL")
            if no and c.accept("BLANK"):
                return Rule(column, "NOT BLANK")
            if c.accept("UNIQUE"):
                if c.accept("WITH"):
                    return Rule(column, "UNIQUE WITH", tuple(Cursor(p).name() for p in split_commas(c.inside())))
                return Rule(column, "UNIQUE")
            for word in ("UNIQUE_FIRST", "UNIQUE_LAST"):
                if c.accept(word):
                    c.expect("BY")
                    order = c.inside() if c.at("(") else c.until("ON FAILURE", "EXPECT", "AND", "OR", "AS")
                    return Rule(column, f"{word} BY", (" ".join(t.text for t in order),))
            if c.accept("MATCHES"):
                return Rule(column, "NOT MATCHES" if no else "MATCHES", (self.session.scalar([c.next()]),))
            if c.accept("LENGTH"):
                op = c.next().text
                return Rule(column, "LENGTH", (op, self.session.scalar([c.next()])))
            if c.accept("CASTABLE"):
                c.expect("AS")
                p = Parser(c.tokens[c.i :], scope)
                kind = p.type_name()
                c.i += p.c.i
                return Rule(column, "CASTABLE AS", (library.spark_type(kind),))
            if c.accept("BETWEEN"):
                low = c.until("AND")
                c.expect("AND")
                return Rule(column, "BETWEEN", (self.session.scalar(low), self.session.scalar(c.until("ON FAILURE", "EXPECT", "AND", "OR", "AS"))))
            if c.accept("IN"):
                return Rule(column, "NOT IN" if no else "IN", values(c.inside()))
            if c.accept("EXISTS"):
                if c.accept("WITH"):
                    own = [Cursor(p).name() for p in split_commas(c.inside())]
                    c.expect("IN")
                    table = self.session.table(c.name())
                    return Rule(column, "EXISTS WITH", (table, [column, *own] if column not in own else own, [Cursor(p).name() for p in split_commas(c.inside())]))
                c.expect("IN")
                table = self.session.table(c.name())
                return Rule(column, "EXISTS IN", (table, Cursor(c.inside()).name()))
            if c.accept("EXPR"):
                return Rule(column, "EXPR", (Parser(c.inside(), scope).whole().sql,))
            if c.now is not None and c.now.kind == "op":
                op = c.next().text
                return Rule(column, op, (self.session.scalar(c.until("ON FAILURE", "EXPECT", "AND", "OR", "AS")),))
            raise ParseError(f"unknown rule at {c.now.text if c.now else 'the end'}")

        rule = one()
        while c.at("AND") or c.at("OR"):
            word = c.next().up
            rule = Rule(column, word, (rule, one()))
        action = "WARN"
        if c.accept("ON", "FAILURE"):
            action = c.next().up
        rule.action = action
        out.append(rule)
        return out

    def star(self, c: Cursor, owner: str | None, src: Source, scope: Scope) -> list[tuple[str, str | None]]:
        exclude: set[str] = set()
        replace: dict[str, str] = {}
        rename: dict[str, str] = {}
        while c.now is not None:
            if c.accept("EXCLUDE"):
                exclude |= {Cursor(p).name().lower() for p in split_commas(c.inside())} if c.at("(") else {c.name().lower()}
            elif c.accept("REPLACE"):
                for p in split_commas(c.inside()):
                    pc = Cursor(p)
                    e = Parser(pc.until("AS"), scope).whole().sql
                    pc.expect("AS")
                    replace[pc.name().lower()] = e
            elif c.accept("RENAME"):
                for p in split_commas(c.inside()) if c.at("(") else [c.until()]:
                    pc = Cursor(p)
                    old = pc.name().lower()
                    pc.expect("AS")
                    rename[old] = pc.name()
            else:
                raise ParseError(f"unexpected {c.now.text!r} after *")
        rs = [r for r in src.relations if owner is None or r.alias.lower() == owner.lower()]
        if owner is not None and not rs:
            raise ParseError(f"unknown alias {owner}")
        if not (exclude or replace or rename) and not src.packed and all(r.columns and r.columns[0][1] != "unknown" for r in rs) is False:
            return [("*" if owner is None else f"{quote(owner)}.*", None)]
        known = {n.lower() for r in rs for n, _ in r.columns}
        for n in [*exclude, *replace, *rename]:
            if n not in known:
                raise ParseError(f"unknown column {n}")
        out: list[tuple[str, str | None]] = []
        for r in rs:
            for n, _ in r.columns:
                if n.lower() in exclude:
                    continue
                base = quote(n) if r.alias == "__flat" else f"{quote(r.alias)}.{quote(n)}"
                out.append((replace.get(n.lower(), base), rename.get(n.lower(), n)))
        return out

    def block_sql(self, tokens: list[Token]) -> str | None:
        """A plain block as text; None if it needs DataFrame steps."""
        cl = self.clauses(tokens)
        if any(k in cl for k in ("PERCENT", "TIES", "QUALIFY", "USING SAMPLE", "FOR JSON", "FOR XML", "INTO", "ON FAILURE")) or self.needs_frames(tokens):
            return None
        src = self.source(cl["FROM"]) if "FROM" in cl else Source()
        if src.packed:
            return None
        scope = self.scope(src.relations)
        self.name_windows(cl, scope)
        items, rules, behind = self.items(cl["SELECT"], src, scope)
        if rules:
            return None
        return self.plain(cl, src, scope, items, behind)

    @staticmethod
    def needs_frames(tokens: list[Token]) -> bool:
        return any(t.up == "GROUPS" and t.kind == "word" or t.up == "EXCLUDE" and i + 1 < len(tokens) and tokens[i + 1].up in ("CURRENT", "GROUP", "TIES", "NO") for i, t in enumerate(tokens))

    def name_windows(self, cl: dict[str, list[Token]], scope: Scope) -> None:
        for p in split_commas(cl.get("WINDOW", [])):
            c = Cursor(p)
            name = c.name().lower()
            c.expect("AS")
            if name in scope.named_windows:
                raise ParseError(f"window {name} twice")
            scope.named_windows[name] = Parser([], scope).window(c.inside(), "sum(x)")

    def plain(self, cl: dict[str, list[Token]], src: Source, scope: Scope, items: list[tuple[str, str | None]], behind: dict[str, list[Token]], extra: list[str] = ()) -> str:
        """The block's text with everything Spark SQL has."""
        hint = ""
        # Spark ranks the rows of each outer row by a sort right below the limit only, so its keys are columns of the block
        keys = self.hidden_keys(cl, scope, items, behind) if self.outer and ("TOP" in cl or "LIMIT" in cl) else []
        select = ", ".join([f"{e} as {quote(a)}" if a else e for e, a in items] + list(extra) + [f"{e} as __s{i}" for i, (e, _) in enumerate(keys)])
        sql = f"select {hint}{'distinct ' if 'DISTINCT' in cl else ''}{select}"
        if src.sql:
            sql += f" from {src.sql}"
        fix = (lambda ts: self.qualified(ts, src.relations)) if src.packed else (lambda ts: ts)
        if "WHERE" in cl:
            x = Parser(fix(cl["WHERE"]), scope).whole()
            sql += f" where {Parser.truth(x)}"
        if "GROUP BY" in cl:
            sql += " group by " + self.group_sql(cl["GROUP BY"], scope, behind, fix)
        if "HAVING" in cl:
            sql += f" having {Parser.truth(Parser(self.with_aliases(cl['HAVING'], behind, scope), scope).whole())}"
        if keys:
            sql += " order by " + ", ".join(f"__s{i}{how}" for i, (_, how) in enumerate(keys))
        elif "ORDER BY" in cl:
            sql += " order by " + self.order_sql(cl["ORDER BY"], self.with_outputs(scope, items))
        if "TOP" in cl:
            sql += f" limit {Parser(cl['TOP'], scope).whole().sql}"
        if "LIMIT" in cl:
            sql += self.limit_sql(Cursor(cl["LIMIT"]), scope)
        return f"select * except ({', '.join(f'__s{i}' for i in range(len(keys)))}) from ({sql})" if keys else sql

    def hidden_keys(self, cl: dict[str, list[Token]], scope: Scope, items: list[tuple[str, str | None]], behind: dict[str, list[Token]]) -> list[tuple[str, str]]:
        """(text, direction) of each key of ORDER BY; none if the keys are columns of the result anyway (DISTINCT, ALL)."""
        tokens = cl.get("ORDER BY", [])
        if "DISTINCT" in cl or len(tokens) in (1, 2) and tokens[0].up == "ALL":
            return []
        out = []
        for p in split_commas(tokens):
            c = Cursor(p)
            body = c.until("ASC", "DESC", "NULLS")
            name = body[0].text.strip('"').lower()
            if len(body) == 1 and body[0].kind == "number":
                text = items[int(body[0].text) - 1][0]
            else:
                # an output name comes before a column of the source
                x = Parser(behind[name] if len(body) == 1 and name in behind else self.with_aliases(body, behind, scope), scope).whole()
                text = f"lower({x.sql})" if x.kind == TEXT and not scope.case_sensitive and not x.literal else x.sql
            out.append((text, "".join(f" {t.text}" for t in c.tokens[c.i :])))
        return out

    @staticmethod
    def with_outputs(scope: Scope, items: list[tuple[str, str | None]]) -> Scope:
        """The scope of ORDER BY: an output name hides a source column of unknown kind."""
        columns = dict(scope.columns)
        for e, a in items:
            if a and a.lower() not in columns:
                columns[a.lower()] = None
            elif a and e != f"`{a}`" and not e.endswith(f".`{a}`"):
                columns[a.lower()] = None
        return Scope(columns, scope.variable, scope.subquery, scope.function, scope.named_windows, scope.case_sensitive, scope.set_list)

    def group_sql(self, tokens: list[Token], scope: Scope, behind: dict[str, list[Token]], fix) -> str:
        c = Cursor(tokens)
        if len(tokens) == 1 and tokens[0].up == "ALL":
            return "all"
        for word in ("ROLLUP", "CUBE"):
            if c.accept(word):
                inner = c.inside()
                n = len(split_commas(inner))
                if word == "CUBE" and 2**n > self.session.max_grouping_sets:
                    raise ParseError("too many grouping sets")
                return f"{word.lower()} ({', '.join(Parser(fix(p), scope).whole().sql for p in split_commas(inner))})"
        if c.accept("GROUPING", "SETS"):
            sets = []
            for p in split_commas(c.inside()):
                keys = split_commas(Cursor(p).inside()) if p and p[0].text == "(" else [p]
                sets.append("(" + ", ".join(Parser(fix(k), scope).whole().sql for k in keys) + ")")
            return f"grouping sets ({', '.join(sets)})"
        out = []
        for p in split_commas(tokens):
            name = p[0].text.strip('"').lower() if len(p) == 1 else ""
            if name in behind and name not in scope.columns:
                p = behind[name]
            out.append(Parser(fix(p), scope).whole().sql)
        return ", ".join(out)

    @staticmethod
    def with_aliases(tokens: list[Token], behind: dict[str, list[Token]], scope: Scope) -> list[Token]:
        """Tokens with select aliases replaced by what they stand for; source columns come first."""
        out: list[Token] = []
        for i, t in enumerate(tokens):
            name = t.text.strip('"').lower()
            dotted = i and tokens[i - 1].text == "."
            if t.kind in ("word", "quoted") and name in behind and name not in scope.columns and not dotted:
                out += [Token("punct", "(", 0, 0), *behind[name], Token("punct", ")", 0, 0)]
            else:
                out.append(t)
        return out

    def frames(self, cl: dict[str, list[Token]], src: Source) -> tuple[Source, dict[str, list[Token]]]:
        """Windows with GROUPS or EXCLUDE: their ranks become columns of a packed view, the calls plain windows."""
        scope = self.scope(src.relations)
        where = ""
        if "WHERE" in cl:
            where = f" where {Parser.truth(Parser(cl.pop('WHERE'), scope).whole())}"
        extra: list[str] = []
        made: list[tuple[str, str]] = []
        tokens, out, i = cl["SELECT"], [], 0
        while i < len(tokens):
            t = tokens[i]
            c = Cursor(tokens)
            c.i = i
            if t.kind == "word" and c.peek() is not None and c.peek().text == "(":
                c.next()
                args = c.inside()
                if c.accept("OVER") and c.at("(") and self.needs_frames(w := Cursor(tokens[c.i :]).inside()):
                    c.inside()
                    name = f"__f{len(made)}"
                    made.append((name, self.framed(t.text, args, w, scope, extra, len(made), src)))
                    out.append(Token("quoted", f'"{name}"', 0, 0))
                    i = c.i
                    continue
            out.append(t)
            i += 1
        df, packed = self.pack(src, extra, where)
        cols = ", ".join([quote(r.alias) for r in src.relations] + [f"{e} as {n}" for n, e in made])
        df2 = self.run(f"select {cols} from {packed.sql}")
        new = Source(self.view(df2), [*src.relations, Relation("", "__flat", [(n, "double") for n, _ in made])], True)
        return new, cl | {"SELECT": out}

    def framed(self, name: str, args: list[Token], window: list[Token], scope: Scope, extra: list[str], n: int, src: Source) -> str:
        q = lambda ts: self.qualified(ts, src.relations)
        x = "1" if not args or args[0].text == "*" else Parser(q(args), scope).whole().sql
        c = Cursor(q(window))
        part = ""
        if c.accept("PARTITION", "BY"):
            part = "partition by " + ", ".join(Parser(p, scope).whole().sql for p in split_commas(c.until("ORDER BY", "ROWS", "RANGE", "GROUPS")))
        order = Parser([], scope).order(c) if c.accept("ORDER", "BY") else "1"
        unit = c.next().up
        frame = c.until("EXCLUDE")
        what = ""
        if c.accept("EXCLUDE"):
            what = " ".join(t.up for t in c.tokens[c.i :])
        bounds = " ".join(t.text for t in frame)
        if not bounds.upper().startswith("BETWEEN"):
            bounds = f"between {bounds} and current row"
        extra.append(f"dense_rank() over ({part} order by {order}) as __g{n}")
        extra.append(f"row_number() over ({part} order by {order}) as __n{n}")
        spec = f"{part} order by __g{n} range {bounds}" if unit == "GROUPS" else f"{part} order by __n{n} rows {bounds}" if unit == "ROWS" else f"{part} order by {order} range {bounds}"
        fn = library.RENAMED.get(name.upper(), name.lower())
        if what in ("", "NO OTHERS"):
            return f"{fn}({x}) over ({spec})"
        items = f"collect_list(struct(__n{n} as rn, __g{n} as peer, {x} as x)) over ({spec})"
        gone = {"CURRENT ROW": f"v.rn <> __n{n}", "GROUP": f"v.peer <> __g{n}", "TIES": f"(v.peer <> __g{n} or v.rn = __n{n})"}[what]
        left = f"filter(transform(filter({items}, v -> {gone}), v -> v.x), x -> x is not null)"
        total = f"aggregate({left}, cast(0 as decimal(38,10)), (a, v) -> cast(a + v as decimal(38,10)))"
        return {
            "sum": f"case when size({left}) > 0 then {total} end",
            "count": f"size({left})",
            "avg": f"case when size({left}) > 0 then {total} / size({left}) end",
            "min": f"array_min({left})",
            "max": f"array_max({left})",
        }[fn]

    def block(self, tokens: list[Token]) -> Result:
        cl = self.clauses(tokens)
        src = self.source(cl["FROM"]) if "FROM" in cl else Source()
        if self.needs_frames(cl["SELECT"]):
            src, cl = self.frames(cl, src)
        scope = self.scope(src.relations)
        self.name_windows(cl, scope)
        fix = (lambda ts: self.qualified(ts, src.relations)) if src.packed else (lambda ts: ts)
        into = cl["INTO"][0].text if "INTO" in cl else None
        items, rules, behind = self.items(fix(cl["SELECT"]), src, scope)
        late = [k for k in ("PERCENT", "TIES", "QUALIFY", "USING SAMPLE") if k in cl]
        if not late:
            if src.packed and "ORDER BY" in cl:
                names = {(a or "").lower() for _, a in items}
                cl["ORDER BY"] = [t for t in self.qualified(cl["ORDER BY"], [Relation("", r.alias, [(n, k) for n, k in r.columns if n.lower() not in names]) for r in src.relations])]
            df = self.run(self.plain(cl, src, scope, items, behind))
        else:
            df = self.late(cl, src, scope, items, behind)
        if "FOR JSON" in cl or "FOR XML" in cl:
            df = self.document(df, "JSON" if "FOR JSON" in cl else "XML", cl.get("FOR JSON", cl.get("FOR XML")))
        quarantine = None
        if "ON FAILURE" in cl:
            c = Cursor(cl["ON FAILURE"])
            action = c.next().up
            for r in rules:
                if r.action == "WARN" and action in ("THROW",):
                    r.action = action
            if c.accept("TO"):
                quarantine = c.name()
        source = src.relations[0].df if rules and len(src.relations) == 1 else None
        return Result(df, into, rules, quarantine, source)

    def late(self, cl: dict[str, list[Token]], src: Source, scope: Scope, items: list[tuple[str, str | None]], behind: dict[str, list[Token]]) -> DataFrame:
        """Blocks with QUALIFY, TOP PERCENT, WITH TIES or a sample: hidden columns, then DataFrame steps."""
        fix = (lambda ts: self.qualified(ts, src.relations)) if src.packed else (lambda ts: ts)
        extra = []
        if "QUALIFY" in cl:
            q = Parser(fix(self.with_aliases(cl["QUALIFY"], behind, scope)), scope).whole()
            extra.append(f"{Parser.truth(q)} as __q")
        order: list[str] = []
        for i, p in enumerate(split_commas(cl.get("ORDER BY", []))):
            c = Cursor(p)
            body = c.until("ASC", "DESC", "NULLS")
            if len(body) == 1 and body[0].kind == "number":
                text = items[int(body[0].text) - 1][0]
            else:
                x = Parser(fix(self.with_aliases(body, behind, scope)), scope).whole()
                text = f"lower({x.sql})" if x.kind == TEXT and not scope.case_sensitive else x.sql
            if not ("DISTINCT" in cl):
                extra.append(f"{text} as __o{i}")
                order.append(" ".join([f"__o{i}", *[t.text for t in c.tokens[c.i :]]]))
            else:
                order.append(" ".join([(body[0].text if len(body) == 1 else text), *[t.text for t in c.tokens[c.i :]]]))
        inner = {k: v for k, v in cl.items() if k not in ("ORDER BY", "LIMIT", "TOP", "DISTINCT", "QUALIFY")}
        df = self.run(self.plain(inner, src, scope, items, behind, extra))
        visible = [c for c in df.columns if not re.fullmatch(r"__q|__o\d+", c)]
        if "QUALIFY" in cl:
            df = df.where("__q").drop("__q")
        if "DISTINCT" in cl:
            df = df.distinct()
        keys = ", ".join(order)
        if "TOP" in cl and ("PERCENT" in cl or "TIES" in cl):
            n = self.session.scalar(cl["TOP"])
            if "PERCENT" in cl:
                df = windows.top_percent(df, keys, float(n)) if keys else windows.top_percent(df, "1", float(n))
            else:
                df = windows.top_with_ties(df, keys, int(n))
        elif "TOP" in cl:
            df = windows.top_n(df, keys, int(self.session.scalar(cl["TOP"]))) if keys else df.limit(int(self.session.scalar(cl["TOP"])))
        if keys:
            from ..operators.order import sort_columns

            df = df.orderBy(*sort_columns(keys))
        if "LIMIT" in cl:
            name = self.view(df)
            sort = f" order by {keys}" if keys else ""
            df = self.run(f"select * from {name}{sort}{self.limit_sql(Cursor(cl['LIMIT']), scope)}")
        if "USING SAMPLE" in cl:
            df = self.sample(df, cl["USING SAMPLE"])
        return df.select(*[quote(c) for c in visible])

    def sample(self, df: DataFrame, tokens: list[Token]) -> DataFrame:
        c = Cursor(tokens)
        n = c.until("ROWS", "ROW", "PERCENT", "%", "REPEATABLE")
        value = float(self.session.scalar(n))
        unit = c.next().up if c.now is not None and c.now.up in ("ROWS", "ROW", "PERCENT", "%") else None
        if unit is None:
            raise ParseError("USING SAMPLE needs ROWS or PERCENT")
        seed = int(self.session.scalar(c.inside())) if c.accept("REPEATABLE") else None
        return windows.sample_percent(df, value, seed) if unit in ("PERCENT", "%") else windows.sample_rows(df, int(value), seed)

    def document(self, df: DataFrame, kind: str, tokens: list[Token]) -> DataFrame:
        """FOR JSON and FOR XML: the whole result as one text."""
        c = Cursor(tokens)
        root, name = None, "row"
        while c.now is not None:
            t = c.next().up
            if t == "ROOT":
                root = self.session.scalar(c.inside()) if c.at("(") else "root"
            elif t == "PATH" and c.at("("):
                name = self.session.scalar(c.inside())
        rows = df.withColumn("__i", F.monotonically_increasing_id())
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("__i", F.struct(*df.columns).alias("r")))), lambda x: x.r)
        if kind == "JSON":
            text = F.to_json(ordered, {"ignoreNullFields": "false"})
            if root:
                text = F.concat(F.lit('{"' + str(root) + '":'), text, F.lit("}"))
            return rows.agg(text.alias("JSON"))
        fields = [f"case when r.{quote(x)} is null then '' else concat('<{x}>', {library._xml_escape(f'r.{quote(x)}')}, '</{x}>') end" for x in df.columns]
        one = f"concat('<{name}>', {', '.join(fields)}, '</{name}>')"
        out = rows.agg(ordered.alias("__rows")).select(F.expr(f"array_join(transform(__rows, r -> {one}), '')").alias("XML"))
        return out.select(F.concat(F.lit(f"<{root}>"), "XML", F.lit(f"</{root}>")).alias("XML")) if root else out

