"""A session: versioned temp tables, variables, settings, and the interpreter of script statements."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import library
from .functions.reldate import resolve as resolve_reldate
from .lang.expressions import Ex, Parser, Scope, kind_of_type, literal, quote
from .lang.query import Compiler, Result
from .lang.tokens import Cursor, ParseError, Token, split_commas, tokenize
from .operators import dml, prep, quality, transforms
from .operators.quality import QualityError
from .streaming import highwater


class ScriptError(Exception):
    """THROW or RAISEERROR, or a failed statement."""

    def __init__(self, message: str, number: int = 50000, state: int = 1, severity: int = 16):
        super().__init__(message)
        self.number, self.state, self.severity = number, state, severity


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class _Return(Exception):
    def __init__(self, value=None):
        self.value = value


class _Goto(Exception):
    def __init__(self, label: str):
        super().__init__(f"no label {label} to go to")
        self.label = label.lower()


@dataclass
class Column:
    """A declared column: its type and constraints."""

    name: str
    kind: str
    not_null: bool = False
    primary: bool = False
    unique: bool = False
    identity: bool = False
    numbers: tuple[int, int] = (1, 1)
    default: str | None = None
    check: str | None = None
    length: int | None = None
    references: tuple[str, str] | None = None
    tags: dict[str, str] = field(default_factory=dict)


@dataclass
class Function:
    """A user function or procedure."""

    name: str
    parameters: list[tuple[str, str, bool, list[Token] | None]]
    body: list[Token]
    returns: str | None = None


_STARTS = set(
    "SELECT WITH INSERT UPDATE DELETE TRUNCATE MERGE REPLACE CREATE DROP ALTER DECLARE SET IF WHILE FOR FOREACH BEGIN TRY THROW RAISEERROR RAISERROR PRINT GOTO PARALLEL RUN BULK RETURN BREAK CONTINUE EXEC EXECUTE TRANSFORM GENERATE COMPARE ASSERT EXPECT PIVOT UNPIVOT COMMIT ROLLBACK EXPLAIN REPLAY GO VALUES WAITFOR PUBLISH EXPORT".split()
)


class Session:
    """Runs scripts over Spark. Temp tables are immutable DataFrames by name; a change makes the next version."""

    def __init__(self, spark: SparkSession, state_dir: str | None = None):
        self.spark = spark
        library.register(spark)
        spark.conf.set("spark.sql.variable.substitute", "false")  # ${...} is the language's own
        self.tables: dict[str, DataFrame] = {}
        self.schemas: dict[str, list[Column]] = {}
        self.views: dict[str, list[Token]] = {}
        self.variables: dict[str, object] = {"@@rowcount": 0, "@@trancount": 0, "@@error": 0, "@@fetch_status": -1}
        self.types: dict[str, str] = {}
        self.sets: dict[str, list[str]] = {}
        self.functions: dict[str, Function] = {}
        self.procedures: dict[str, Function] = {}
        self.host: dict[str, Callable] = {}
        self.connections: dict[str, tuple[str, dict]] = {}
        self.settings: dict[str, object] = {"CASE_SENSITIVE": False, "WHAT_IF": False, "MAX_RECURSIVE_DEPTH": 10_000, "MAX_GROUPING_SETS": 4096, "DATA_QUALITY_DRY_RUN": False, "WEEK_START_DAY": "Monday", "MAX_PARALLEL_DEGREE": 8, "DATEFORMAT": "mdy"}
        self.snapshots: list[tuple] = []
        self.state = highwater.StateStore(state_dir)
        self.error: dict[str, object] = {}
        self.printed: list[str] = []
        self.warnings: list[str] = []
        self.labels: dict[str, tuple[list[Token], str | None]] = {}
        self.lineage: list[dict] = []
        #: What RUN SCRIPT hands to the parameters of this script, and the folder its own paths start from.
        self.inputs: dict[str, object] = {}
        self.outputs: set[str] = set()
        self.folder = os.getcwd()
        self._n = 0

    # --- what the compiler asks for ------------------------------------------------------------------------------------

    @property
    def case_sensitive(self) -> bool:
        return bool(self.settings["CASE_SENSITIVE"])

    @property
    def max_recursion(self) -> int:
        return int(self.settings["MAX_RECURSIVE_DEPTH"])

    @property
    def max_grouping_sets(self) -> int:
        return int(self.settings["MAX_GROUPING_SETS"])

    def register_view(self, df: DataFrame) -> str:
        self._n += 1
        name = f"qv_{id(self)}_{self._n}"
        df.createOrReplaceTempView(name)
        return name

    def table(self, name: str) -> DataFrame:
        """A temp table, view, metadata table or connection's table by name."""
        key = name.lower().replace("&", "#", 1) if name.startswith("&") else name.lower()
        if key in self.tables:
            return self.tables[key]
        if key in self.views:
            if key in getattr(self, "_open", ()):
                raise ScriptError(f"view {name} refers to itself")
            self._open = {*getattr(self, "_open", ()), key}
            try:
                return self.query(self.views[key])
            finally:
                self._open -= {key}
        if key.startswith("eng."):
            return self.metadata(key[4:])
        head, _, rest = key.partition(".")
        if head in self.connections:
            from .sources import readers

            return readers.read(self.spark, *self.connections[head], rest or None)
        if re.fullmatch(r"\w+(\.\w+)*", name) and self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise ScriptError(f"unknown table {name}")

    def metadata(self, name: str) -> DataFrame:
        """eng.tables, eng.columns, eng.views, eng.variables, eng.lineage and eng.data_quality."""
        if name == "tables":
            return self.spark.createDataFrame([(t, len(d.columns)) for t, d in self.tables.items()], "name string, columns int")
        if name == "columns":
            return self.spark.createDataFrame([(t, c, k, i + 1) for t, d in self.tables.items() for i, (c, k) in enumerate(d.dtypes)], "table_name string, column_name string, data_type string, ordinal int")
        if name == "views":
            return self.spark.createDataFrame([(v,) for v in self.views], "name string")
        if name == "variables":
            return self.spark.createDataFrame([(k, None if v is None else str(v)) for k, v in self.variables.items()], "name string, value string")
        if name == "lineage":
            return self.spark.createDataFrame([(x["target"], x["column"], x["source"], x["expression"]) for x in self.lineage], "target string, column string, source string, expression string")
        raise ScriptError(f"unknown metadata table eng.{name}")

    def put(self, name: str, df: DataFrame) -> None:
        """The next version of a temp table, under WHAT_IF only its row count."""
        if not self.settings["WHAT_IF"]:
            self.tables[name.lower().replace("&", "#", 1) if name.startswith("&") else name.lower()] = df

    def variable(self, name: str) -> Ex:
        key = name.lower()
        if key not in self.variables:
            raise ScriptError(f"unknown variable {name}")
        value = self.variables[key]
        if isinstance(value, str) and "${" in value:
            value = self.interpolate(value)
        out = literal(value)
        t = self.types.get(key)
        if t is not None and value is not None and not isinstance(value, list):
            out = Ex(f"cast({out.sql} as {t})" if kind_of_type(t) != out.kind else out.sql, kind_of_type(t), True)
        elif value is None and t is not None:
            out = Ex(f"cast(null as {t})", kind_of_type(t))
        return out

    def set_values(self, name: str) -> list[str] | None:
        return self.sets.get(name.lower())

    def interpolate(self, text: str) -> str:
        """${@v} replaced by the variable's value; unknown ones stay."""
        return re.sub(r"\$\{(@\w+)\}", lambda m: str(self.variables[m[1].lower()]) if m[1].lower() in self.variables else m[0], text)

    def scope(self) -> Scope:
        out = Scope({}, self.variable, None, self.user_function, {}, self.case_sensitive, self.set_values)
        out.subquery = lambda tokens: Compiler(self).text(tokens)
        return out

    def scalar(self, tokens: list[Token]):
        """The value of an expression without columns."""
        if len(tokens) == 1:
            t = tokens[0]
            if t.kind == "string":
                return self.interpolate(t.text[1:-1].replace("''", "'"))
            if t.kind == "number":
                return int(t.text) if t.text.isdigit() else float(t.text)
            if t.kind == "variable":
                self.variable(t.text)
                return self.variables[t.text.lower()]
            if t.kind == "word" and t.up in ("TRUE", "FALSE", "NULL"):
                return {"TRUE": True, "FALSE": False, "NULL": None}[t.up]
        if tokens and tokens[0].up == "SELECT":
            row = self.query(tokens).first()
            return None if row is None else row[0]
        x = Parser(self.interpolated(tokens), self.scope()).whole()
        row = self.spark.sql(f"select {x.sql} as x").first()
        return row[0]

    def interpolated(self, tokens: list[Token]) -> list[Token]:
        return [Token(t.kind, self.interpolate(t.text), t.start, t.end) if t.kind == "string" and "${" in t.text else t for t in tokens]

    def user_function(self, name: str, args: list[Ex], names: list[str | None]) -> Ex | None:
        """User functions inlined or interpreted, session functions as literals."""
        up = name.upper()
        if name.lower() in self.functions:
            return self.call_function(self.functions[name.lower()], args, names)
        if name.lower() in self.host:
            return Ex(f"{name.lower()}({', '.join(a.sql for a in args)})")
        if up in library.SESSION:
            return literal(self.session_function(up, [self.spark.sql(f"select {a.sql}").first()[0] for a in args]))
        return None

    def session_function(self, up: str, args: list):
        if up.startswith("ERROR_"):
            return self.error.get(up[6:].lower())
        if up == "RELDATE":
            return resolve_reldate(args[0], week_start=str(self.settings["WEEK_START_DAY"]))
        if up == "GET_JOB_STATE":
            return self.state.get(args[0])
        if up == "SET_JOB_STATE":
            self.state.set(args[0], args[1])
            return args[1]
        if up == "ENV":
            return os.environ.get(args[0])
        if up in ("CURRENT_TENANT", "TENANT_ID"):
            return self.settings.get("TENANT")
        if up == "IS_SANDBOX":
            return int(bool(self.settings.get("SANDBOX")))
        if up == "CONNECTION_PROPERTY":
            value = self.connections.get(str(args[0]).lower(), ("", {}))[1].get(str(args[1]).upper())
            return None if value is None else str(value)
        if up.startswith("REMOTE_"):
            return self.remote_function(up, args)
        if up in ("HAS_TAG", "GET_TAG_VALUE"):
            tags = {k.lower(): v for k, v in self.tags(args[0], args[1]).items()}
            tag = str(args[2]).lstrip("@").lower()
            if up == "GET_TAG_VALUE":
                return tags.get(tag)
            return int(tag in tags and (len(args) < 4 or tags[tag] == args[3]))
        return library.file_function(up, args)

    def remote_function(self, up: str, args: list):
        """What stands at a path of a folder or object store connection; null arguments and missing files give null or 0."""
        from .sources import readers

        if any(a is None for a in args):
            return None
        kind, options = self.connections[str(args[0]).lower()]
        fs, root = readers.file_system(self.spark, kind, options)
        inner = str(args[1]).strip("/")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(root, inner) if inner else root
        there = fs.getFileStatus(path) if fs.exists(path) else None
        folder = there is not None and there.isDirectory()
        if up in ("REMOTE_FILE_EXISTS", "REMOTE_DIRECTORY_EXISTS"):
            return int(there is not None and folder == (up == "REMOTE_DIRECTORY_EXISTS"))
        if there is None or folder:
            return None
        return there.getLen() if up == "REMOTE_FILE_SIZE" else dt.datetime.fromtimestamp(there.getModificationTime() / 1000)

    def tags(self, table: str, column: str) -> dict[str, str]:
        """Governance tags of a declared column."""
        for c in self.schemas.get(table.lower(), []):
            if c.name.lower() == str(column).lower():
                return c.tags
        return {}

    def table_function(self, name: str, args: list[Ex]) -> DataFrame:
        up = name.upper()
        values = [self.spark.sql(f"select {a.sql}").first()[0] for a in args]
        if up in ("FILE_LIST", "DIRECTORY"):
            root = str(values[0])
            rows = []
            deep = len(values) > 1 and values[1]
            for folder, dirs, files in os.walk(root):
                for f in sorted(files):
                    p = os.path.join(folder, f)
                    rows.append((f, p, os.path.getsize(p), dt.datetime.fromtimestamp(os.path.getmtime(p))))
                if not deep:
                    break
            return self.spark.createDataFrame(rows, "Name string, Path string, Size long, Modified timestamp")
        if up == "REMOTE_FILE_LIST":
            from .sources import readers

            rows = readers.remote(self.spark, *self.connections[str(values[0]).lower()], values[1] if len(values) > 1 else None) if len(values) < 2 or values[1] is not None else []
            rows = [(n, p, size, dt.datetime.fromtimestamp(t / 1000), d) for n, p, size, t, d in rows]
            return self.spark.createDataFrame(rows, "NAME string, FULLPATH string, SIZE long, LASTMODIFIED timestamp, ISDIRECTORY boolean")
        if up == "GET_TAGS":
            rows = [(c.name, k, v) for c in self.schemas.get(str(values[0]).lower(), []) if len(values) < 2 or c.name.lower() == str(values[1]).lower() for k, v in c.tags.items()]
            return self.spark.createDataFrame(rows, "column_name string, tag string, value string")
        raise ScriptError(f"unknown table function {name}")

    def high_water(self, df: DataFrame, name: str, options: dict) -> DataFrame:
        """WITH (WATERMARK = column, ...) on a source."""
        return highwater.incremental(df, str(options["WATERMARK"]), self.state, str(options.get("KEY") or f"{name}:{options['WATERMARK']}"), options.get("INITIAL"), bool(options.get("INCLUSIVE")) and not (options.get("STRICT") and not options.get("INCLUSIVE")))

    # --- running -------------------------------------------------------------------------------------------------------

    def register_function(self, name: str, f: Callable, returns: str = "string") -> None:
        """Make a Python function callable in queries (rows go through it one by one)."""
        self.spark.udf.register(name.lower(), f, returns)
        self.host[name.lower()] = f

    def sql(self, text: str) -> DataFrame | None:
        """Run a script; the rows of its last query."""
        self._text = text
        try:
            return self.block(Cursor(tokenize(text), text))
        except _Return:
            return None
        except _Goto as e:
            raise ScriptError(str(e)) from None

    def query(self, tokens: list[Token]) -> DataFrame:
        return Compiler(self).frame(self.interpolated(tokens))

    def block(self, c: Cursor, *ends: str) -> DataFrame | None:
        """Statements up to one of ends. GOTO moves on from a label of the same block or one around it."""
        if ends:
            return self.statements(c, *ends)
        while True:
            try:
                return self.statements(c)
            except _Goto as jump:
                at = self.label_places(c.tokens).get(jump.label)
                if at is None:
                    raise
                c.i = at

    @staticmethod
    def label_places(tokens: list[Token]) -> dict[str, int]:
        """Where the labels outside nested blocks stand."""
        out, depth = {}, 0
        for i, t in enumerate(tokens):
            if t.kind == "word" and t.up in ("BEGIN", "CASE"):
                depth += not (i + 1 < len(tokens) and tokens[i + 1].up in ("TRANSACTION", "TRAN"))
            elif t.kind == "word" and t.up == "END":
                depth -= 1
            elif depth == 0 and t.kind == "word" and t.up not in _STARTS and i + 1 < len(tokens) and tokens[i + 1].text == ":" and (i == 0 or tokens[i - 1].text in (";", ":") or tokens[i - 1].up in ("GO", "END")):
                out[t.text.lower()] = i
        return out

    def statements(self, c: Cursor, *ends: str) -> DataFrame | None:
        last = None
        while c.now is not None and not (ends and c.now.up in ends):
            if c.accept(";") or c.accept("GO"):
                continue
            if c.now.kind == "word" and c.peek() is not None and c.peek().text == ":" and c.now.up not in _STARTS:
                label = c.next().text
                c.next()
                start = c.i
                out = self.statement(c)
                self.labels[label.lower()] = (c.tokens[start : c.i], None)
            else:
                out = self.statement(c)
            if out is not None:
                last = out
        return last

    def body(self, c: Cursor) -> DataFrame | None:
        """BEGIN ... END, or one statement."""
        if c.at("BEGIN") and not (c.peek() is not None and c.peek().up in ("TRY", "TRANSACTION", "TRAN")):
            c.next()
            out = self.block(c, "END")
            c.expect("END")
            return out
        return self.statement(c)

    def skip(self, c: Cursor) -> list[Token]:
        """The tokens of a body, without running it."""
        start = c.i
        if c.at("BEGIN"):
            depth = 0
            while True:
                t = c.next()
                if t.kind == "word" and t.up in ("BEGIN", "CASE"):
                    depth += 1
                elif t.kind == "word" and t.up == "END":
                    depth -= 1
                    if not depth:
                        break
            return c.tokens[start + 1 : c.i - 1]
        self.tokens_of_statement(c)
        return c.tokens[start : c.i]

    def tokens_of_statement(self, c: Cursor) -> list[Token]:
        """Tokens up to the next semicolon, or GO, outside parentheses."""
        out = c.until(";", "GO")
        c.accept(";")
        return out

    def condition(self, c: Cursor) -> bool:
        tokens = c.until("BEGIN", "THEN", "PRINT", "SET", "SELECT INTO", "THROW", "RAISEERROR", "RETURN", "BREAK", "CONTINUE", "EXEC", "INSERT", "UPDATE", "DELETE", "SELECT", "ELSE")
        c.accept("THEN")
        value = self.scalar(tokens)
        return bool(value)

    def statement(self, c: Cursor) -> DataFrame | None:
        up = c.now.up
        handler = getattr(self, f"do_{up.lower()}", None)
        if handler is None:
            if c.at("("):
                return self.emit(self.tokens_of_statement(c))
            raise ParseError(f"unknown statement {c.now.text!r}")
        return handler(c)

    def emit(self, tokens: list[Token]) -> DataFrame | None:
        """Run a query: its rows, or nothing where they go INTO a table or variable."""
        r = Compiler(self).result(self.interpolated(tokens))
        return self.deliver(r, tokens)

    def deliver(self, r: Result, tokens: list[Token]) -> DataFrame | None:
        df = r.df
        if r.rules:
            routed = quality.route(df, r.rules, df.columns, run_id=uuid.uuid4().hex, dry_run=bool(self.settings["DATA_QUALITY_DRY_RUN"]))
            if r.quarantine:
                kept = self.tables.get(r.quarantine.lower())
                self.put(r.quarantine, routed.quarantine if kept is None or kept.columns != routed.quarantine.columns else kept.unionByName(routed.quarantine))
            self.last_routed = routed
            df = routed.clean
        if r.into is None:
            return df
        if r.into.startswith("@"):
            row = df.first()
            self.variables[r.into.lower()] = None if row is None else row[0]
            return None
        self.put(r.into, df)
        self.note_lineage(r.into, df, tokens)
        return None

    def note_lineage(self, target: str, df: DataFrame, tokens: list[Token]) -> None:
        """Which tables a new table's columns were read from."""
        sources = sorted({t.text.lower() for t in tokens if t.kind == "temp"} - {target.lower()})
        for c in df.columns:
            for s in sources or [""]:
                self.lineage.append({"target": target.lower(), "column": c, "source": s, "expression": " ".join(t.text for t in tokens)[:200]})

    # --- queries -------------------------------------------------------------------------------------------------------

    def do_select(self, c: Cursor) -> DataFrame | None:
        tokens = self.tokens_of_statement(c)
        # SELECT @v = expression assigns
        parts = split_commas(Cursor(tokens[1:]).until("FROM"))
        if parts and all(len(p) > 2 and p[0].kind == "variable" and p[1].text == "=" for p in parts):
            rest = tokens[1 + sum(len(p) for p in parts) + len(parts) - 1 :]
            query = [tokens[0]]
            for i, p in enumerate(parts):
                query += ([Token("punct", ",", 0, 0)] if i else []) + p[2:] + [Token("word", "AS", 0, 0), Token("word", f"v{i}", 0, 0)]
            row = self.query(query + rest).first()
            if row is not None:
                for p, v in zip(parts, row, strict=True):
                    self.variables[p[0].text.lower()] = v
            return None
        return self.emit(tokens)

    def do_with(self, c: Cursor) -> DataFrame | None:
        # a WITH may stand before a data change
        start = c.i
        probe = Cursor(c.tokens, c.text)
        probe.i = c.i + 1
        probe.accept("RECURSIVE")
        while True:
            probe.name()
            if probe.at("("):
                probe.inside()
            probe.expect("AS")
            probe.inside()
            if not probe.accept(","):
                break
        if probe.now is not None and probe.now.up in ("INSERT", "UPDATE", "DELETE", "MERGE"):
            comp = Compiler(self)
            c.next()
            comp.common_tables(c)
            before = dict(self.tables)
            self.tables |= comp.ctes
            try:
                out = self.statement(c)
            finally:
                for k in comp.ctes:
                    if k in before:
                        self.tables[k] = before[k]
                    else:
                        self.tables.pop(k, None)
            return out
        c.i = start
        return self.emit(self.tokens_of_statement(c))

    def do_values(self, c: Cursor) -> DataFrame | None:
        return self.emit(self.tokens_of_statement(c))

    do_pivot = do_unpivot = do_values

    def do_explain(self, c: Cursor) -> DataFrame:
        """EXPLAIN [ANALYZE]: the plan, a line for each row; with ANALYZE the one that ran, with the rows and milliseconds its operators counted."""
        c.next()
        analyze = c.accept("ANALYZE")
        plan = self.query(self.tokens_of_statement(c))._jdf.queryExecution()
        if not analyze:
            text = plan.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "step int, plan string")
        plan.toRdd().count()
        rows: list[tuple] = []

        def walk(node, depth: int) -> None:
            kind = node.getClass().getSimpleName()
            inner = {"AdaptiveSparkPlanExec": "executedPlan", "InputAdapter": "child", "WholeStageCodegenExec": "child"}.get(kind, "plan" if kind.endswith("QueryStageExec") else None)
            if inner:
                return walk(getattr(node, inner)(), depth)
            measured = node.metrics()
            value = lambda *names: next((int(measured.apply(n).value()) for n in names if measured.contains(n)), None)
            rows.append((len(rows), "  " * depth + node.nodeName(), value("numOutputRows"), value("pipelineTime", "sortTime", "aggTime", "scanTime")))
            children = node.children()
            for i in range(children.size()):
                walk(children.apply(i), depth + 1)

        walk(plan.executedPlan(), 0)
        return self.spark.createDataFrame(rows, "step int, plan string, rows long, ms long")

    # --- variables and settings ----------------------------------------------------------------------------------------

    def do_declare(self, c: Cursor) -> None:
        c.next()
        for p in split_commas(self.tokens_of_statement(c)):
            pc = Cursor(p)
            name = pc.next().text.lower()
            pc.accept("AS")
            kind = None
            given = None
            if pc.now is not None and pc.now.text != "=":
                words = pc.until("=")
                given = words[-1].up if words[-1].up in ("INPUT", "OUTPUT") else None
                kind = "".join(t.text for t in (words[:-1] if given else words)) or None
            value = None
            if pc.accept("="):
                value = self.scalar(pc.tokens[pc.i :])
            if given and name in self.inputs:
                value = self.inputs[name]
            if given == "OUTPUT":
                self.outputs.add(name)
            if kind and kind.upper() != "LIST" and not kind.upper().startswith(("ANY", "VARIANT", "MINMAX")):
                self.types[name] = library.spark_type(kind)
                if value is not None:
                    value = self.spark.sql(f"select {library.cast(literal(value).sql, kind)}").first()[0]
            self.variables[name] = value

    def do_set(self, c: Cursor) -> None:
        c.next()
        tokens = self.tokens_of_statement(c)
        pc = Cursor(tokens)
        name = pc.next()
        pc.accept("=")
        rest = pc.tokens[pc.i :]
        if name.kind == "variable":
            value = self.scalar(rest)
            t = self.types.get(name.text.lower())
            if t is not None and value is not None:
                value = self.spark.sql(f"select {library.cast(literal(value).sql, t)}").first()[0]
            self.variables[name.text.lower()] = value
            return
        word = rest[0].up if rest else "ON"
        self.settings[name.up] = {"ON": True, "OFF": False, "TRUE": True, "FALSE": False}.get(word, rest[0].text.strip("'") if rest and rest[0].kind != "number" else self.scalar(rest))

    def do_print(self, c: Cursor) -> None:
        c.next()
        self.printed.append(str(self.scalar(self.tokens_of_statement(c))))

    # --- tables --------------------------------------------------------------------------------------------------------

    def do_create(self, c: Cursor) -> None:
        c.next()
        replace = c.accept("OR", "ALTER") or c.accept("OR", "REPLACE")
        if c.accept("TABLE"):
            self.create_table(c)
        elif c.accept("VIEW"):
            name = c.name().lower()
            if name in self.views and not replace:
                raise ScriptError(f"view {name} exists")
            c.expect("AS")
            tokens = self.tokens_of_statement(c)
            if any(t.text.lower() == name for t in tokens if t.kind in ("word", "temp")):
                raise ScriptError(f"view {name} refers to itself")
            self.views[name] = tokens
        elif c.accept("FUNCTION") or c.at("PROCEDURE") or c.at("PROC"):
            procedure = c.accept("PROCEDURE") or c.accept("PROC")
            self.create_routine(c, bool(procedure))
        elif c.accept("SET") or c.at("SETS"):
            c.accept("SETS")
            c.accept("!")
            name = c.name().lower()
            c.accept("AS") or c.accept("=")
            self.sets[name] = [Parser(p, self.scope()).whole().sql for p in split_commas(c.inside())]
            self.tokens_of_statement(c)
        elif c.accept("CONNECTION"):
            name = c.name().lower()
            c.expect("AS")
            kind = c.name().upper()
            options = {}
            for p in split_commas(c.inside()):
                options[p[0].up] = self.scalar(p[2:]) if len(p) > 2 else True
            self.connections[name] = (kind, options)
            self.tokens_of_statement(c)
        elif c.accept("UNIQUE", "INDEX"):
            self.unique_index(c)
        elif c.accept("INDEX"):
            self.tokens_of_statement(c)
        elif c.accept("DATASET"):
            name = c.name().lower()
            c.expect("AS")
            self.publish(name, self.query(self.tokens_of_statement(c)))
        else:
            raise ParseError(f"CREATE {c.now.text if c.now else ''}")

    def publish(self, name: str, df: DataFrame) -> None:
        """CREATE DATASET: a Parquet snapshot of a query, read back."""
        from .operators.recursion import written

        self.tables[name] = written(df)

    def unique_index(self, c: Cursor) -> None:
        c.name()
        c.expect("ON")
        table = c.name().lower()
        columns = [Cursor(p).name() for p in split_commas(c.inside())]
        self.tokens_of_statement(c)
        if self.table(table).groupBy(*columns).count().where("count > 1").limit(1).count():
            raise ScriptError(f"duplicate key in {table}")
        if len(columns) == 1:
            for col in self.schemas.get(table, []):
                if col.name.lower() == columns[0].lower():
                    col.unique = True

    def create_table(self, c: Cursor) -> None:
        if c.accept("IF", "NOT", "EXISTS"):
            pass
        name = c.name()
        if c.accept("AS"):
            self.put(name, self.query(self.tokens_of_statement(c)))
            return
        columns: list[Column] = []
        for p in split_commas(c.inside()):
            pc = Cursor(p)
            if pc.at("PRIMARY", "KEY") or pc.at("UNIQUE") and pc.peek() is not None and pc.peek().text == "(":
                primary = pc.at("PRIMARY")
                pc.i += 2 if primary else 1
                for q in split_commas(pc.inside()):
                    for col in columns:
                        if col.name.lower() == Cursor(q).name().lower():
                            col.primary, col.not_null = col.primary or primary, col.not_null or primary
                            col.unique = col.unique or not primary
                continue
            if pc.accept("CHECK"):
                columns[-1].check = Parser(pc.inside(), self.scope()).whole().sql
                continue
            col = Column(pc.name(), "string")
            kind = pc.name()
            if pc.at("("):
                inner = pc.inside()
                kind += "(" + ",".join(t.text for t in inner if t.text != ",") + ")"
                if re.match(r"(?i)n?(var)?char|string|text", kind) and inner and inner[0].kind == "number":
                    col.length = int(inner[0].text)
            col.kind = library.spark_type(kind)
            while pc.now is not None:
                if pc.accept("NOT", "NULL"):
                    col.not_null = True
                elif pc.accept("NULL"):
                    pass
                elif pc.accept("PRIMARY", "KEY"):
                    col.primary = col.not_null = True
                elif pc.accept("UNIQUE"):
                    col.unique = True
                elif pc.accept("IDENTITY"):
                    col.identity = True
                    if pc.at("("):
                        first, step = ([int(self.scalar(p)) for p in split_commas(pc.inside())] + [1])[:2]
                        col.numbers = (first, step)
                elif pc.accept("DEFAULT"):
                    body = pc.until("NOT NULL", "PRIMARY KEY", "UNIQUE", "CHECK", "REFERENCES", "FOREIGN KEY")
                    col.default = Parser(body, self.scope()).whole().sql
                elif pc.accept("CHECK"):
                    col.check = Parser(pc.inside(), self.scope()).whole().sql
                elif pc.accept("FOREIGN", "KEY") or pc.at("REFERENCES"):
                    pc.expect("REFERENCES")
                    table = pc.name()
                    col.references = (table, Cursor(pc.inside()).name())
                elif pc.now.kind == "variable":
                    tag = pc.next().text.lstrip("@")
                    col.tags[tag] = str(self.scalar([pc.next()])) if pc.accept("=") else ""
                else:
                    pc.next()
            columns.append(col)
        self.tokens_of_statement(c)
        schema = ", ".join(f"{quote(x.name)} {x.kind}" for x in columns)
        self.schemas[name.lower()] = columns
        self.tables[name.lower()] = self.spark.createDataFrame([], schema)

    def do_drop(self, c: Cursor) -> None:
        c.next()
        kind = c.next().up
        optional = c.accept("IF", "EXISTS")
        name = c.name().lower()
        self.tokens_of_statement(c)
        home = {"TABLE": self.tables, "VIEW": self.views, "FUNCTION": self.functions, "PROCEDURE": self.procedures, "SET": self.sets, "CONNECTION": self.connections, "DATASET": self.tables, "INDEX": {name: None}}[kind]
        if name not in home and not optional:
            raise ScriptError(f"unknown {kind.lower()} {name}")
        home.pop(name, None)

    def do_alter(self, c: Cursor) -> None:
        c.next()
        c.expect("TABLE")
        name = c.name()
        df = self.table(name)
        if c.accept("ADD"):
            c.accept("COLUMN")
            column = c.name()
            kind = library.spark_type("".join(t.text for t in c.until("DEFAULT", "NOT NULL", ";")))
            default = "null"
            if c.accept("DEFAULT"):
                default = Parser(c.until("NOT NULL", ";"), self.scope()).whole().sql
            if column.lower() in {x.lower() for x in df.columns}:
                raise ScriptError(f"column {column} exists")
            df = df.withColumn(column, F.expr(default).cast(kind))
        elif c.accept("RENAME"):
            c.accept("COLUMN")
            old = c.name()
            c.expect("TO")
            df = df.withColumnRenamed(self.known(df, old), c.name())
        elif c.accept("DROP"):
            c.accept("COLUMN")
            df = df.drop(self.known(df, c.name()))
        else:
            raise ParseError("ALTER TABLE what?")
        self.tokens_of_statement(c)
        self.put(name, df)

    @staticmethod
    def known(df: DataFrame, column: str) -> str:
        for x in df.columns:
            if x.lower() == column.lower():
                return x
        raise ScriptError(f"unknown column {column}")

    def validated(self, name: str, new: DataFrame, whole: DataFrame) -> DataFrame:
        """Rows that go into a declared table: nulls, lengths, checks, keys and references hold, or the statement fails."""
        columns = self.schemas.get(name.lower(), [])
        conditions = []
        for c in columns:
            x = F.col(quote(c.name))
            if c.not_null and not c.identity:
                conditions.append((x.isNull(), f"{c.name} is null"))
            if c.length:
                if self.settings.get("TRUNCATE_STRING"):
                    new = new.withColumn(c.name, F.substring(c.name, 1, c.length))
                    whole = whole.withColumn(c.name, F.substring(c.name, 1, c.length))
                else:
                    conditions.append((F.length(x) > c.length, f"{c.name} is longer than {c.length}"))
            if c.check:
                conditions.append((~F.coalesce(F.expr(c.check), F.lit(True)), f"{c.name} fails its check"))
        if conditions:
            counts = new.agg(*[F.count_if(k).alias(f"c{i}") for i, (k, _) in enumerate(conditions)]).first()
            for i, (_, what) in enumerate(conditions):
                if counts[i]:
                    raise ScriptError(f"{name}: {what}")
        keys = [[c.name for c in columns if c.primary]] + [[c.name] for c in columns if c.unique]
        for k in keys:
            present = whole.where(" and ".join(f"{quote(x)} is not null" for x in k)) if k else whole
            if k and present.groupBy(*k).count().where("count > 1").limit(1).count():
                raise ScriptError(f"{name}: duplicate key {', '.join(k)}")
        for c in columns:
            if c.references:
                other = self.table(c.references[0]).select(F.col(c.references[1]).alias("__ref")).distinct()
                if new.where(F.col(c.name).isNotNull()).join(other, F.col(c.name) == F.col("__ref"), "left_anti").limit(1).count():
                    raise ScriptError(f"{name}: {c.name} is not in {c.references[0]}")
        return whole

    def apply_change(self, name: str, change: dml.Change, output: list[Token] | None) -> DataFrame | None:
        """Swap in a table's next version; the rows of OUTPUT, if asked for."""
        from .operators.recursion import written

        touched = change.inserted if change.inserted is not None else change.deleted
        out = self.output(change, output) if output else None
        if out is not None:
            out = written(out)
        new = self.validated(name, change.inserted, change.table) if change.inserted is not None and name.lower() in self.schemas else change.table
        self.variables["@@rowcount"] = touched.count() if touched is not None else 0
        if not self.settings["WHAT_IF"]:
            # a written version keeps lineages short and monotonic ids stable
            self.put(name, written(new))
        return out

    def output(self, change: dml.Change, tokens: list[Token]) -> DataFrame:
        base = None
        for side, df in (("inserted", change.inserted), ("deleted", change.deleted)):
            if df is None:
                continue
            df = df.select(F.struct(*df.columns).alias(side)).withColumn("__i", F.monotonically_increasing_id())
            base = df if base is None else base.join(df, "__i", "full")
        items = []
        for p in split_commas(tokens):
            pc = Cursor(p)
            body = pc.until("AS")
            alias = pc.name() if pc.accept("AS") else None
            text = ".".join(t.text for t in body if t.text != ".") if len(body) == 3 and body[1].text == "." else Parser(body, self.scope()).whole().sql
            items.append(f"{text} as {quote(alias)}" if alias else text)
        return base.selectExpr(*items)

    def returning(self, c: Cursor, *stops: str) -> list[Token] | None:
        return c.until(*stops) if c.accept("OUTPUT") else None

    def do_insert(self, c: Cursor) -> DataFrame | None:
        c.next()
        replace = c.accept("OR", "REPLACE")
        c.accept("INTO")
        return self.insert_into(c, replace)

    def do_replace(self, c: Cursor) -> DataFrame | None:
        c.next()
        c.expect("INTO")
        return self.insert_into(c, True)

    def insert_into(self, c: Cursor, replace: bool) -> DataFrame | None:
        name = c.name()
        while c.accept("."):
            name += "." + c.name()
        columns = [Cursor(p).name() for p in split_commas(c.inside())] if c.at("(") and c.peek() is not None and c.peek().up not in ("SELECT", "WITH") else None
        output = self.returning(c, "VALUES", "SELECT", "WITH")
        tokens = self.tokens_of_statement(c)
        if tokens and tokens[0].up == "VALUES":
            rows = Compiler(self).values(self.interpolated(tokens[1:]), None)
        else:
            rows = self.query(tokens)
        head = name.lower().partition(".")[0]
        if name.lower() not in self.tables and head in self.connections:
            from .sources import writers

            writers.write(rows, *self.connections[head], name.partition(".")[2] or None, mode="append")
            self.variables["@@rowcount"] = rows.count()
            return None
        target = self.table(name)
        meta = self.schemas.get(name.lower(), [])
        if replace:
            key = [x.name for x in meta if x.primary]
            return self.apply_change(name, dml.replace_rows(target, self.fitted(rows, target, columns, None), key, columns), output)
        numbered = next((x for x in meta if x.identity), None)
        identity = numbered.name if numbered else None
        defaults = {x.name: x.default for x in meta if x.default}
        return self.apply_change(name, dml.insert(target, self.fitted(rows, target, columns, identity), columns, identity, defaults, numbered.numbers if numbered else (1, 1)), output)

    def fitted(self, rows: DataFrame, target: DataFrame, columns: list[str] | None, identity: str | None) -> DataFrame:
        """Rows cast the way the language casts, column by column."""
        kinds = {a.lower(): t for a, t in target.dtypes}
        names = columns or [x for x in target.columns if x != identity][: len(rows.columns)]
        if len(names) != len(rows.columns):
            raise ScriptError(f"{len(rows.columns)} values for {len(names)} columns")
        out = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
        texts = []
        for i, n in enumerate(names):
            if n.lower() not in kinds:
                raise ScriptError(f"unknown column {n}")
            t = kinds[n.lower()]
            texts.append(f"c{i}" if out.dtypes[i][1] == t else f"{library.cast(f'c{i}', t) if not t.startswith(('array', 'struct', 'map')) else f'cast(c{i} as {t})'} as c{i}")
        return out.selectExpr(*texts)

    def do_update(self, c: Cursor) -> DataFrame | None:
        c.next()
        name = c.name()
        target_name, alias = name, name.lstrip("#&")
        if c.accept("AS") or c.now.kind == "word" and not c.at("SET"):
            alias = c.name()
        c.expect("SET")
        sets_tokens = c.until("OUTPUT", "FROM", "WHERE", ";", "GO")
        output = self.returning(c, "FROM", "WHERE", ";", "GO")
        source_tokens = c.until("WHERE", ";", "GO") if c.accept("FROM") else None
        where = c.until(";", "GO") if c.accept("WHERE") else None
        c.accept(";")
        source, on, source_alias = None, None, "s"
        relations = []
        from .lang.query import Relation

        if source_tokens is not None:
            sc = Cursor(source_tokens)
            comp = Compiler(self)
            comp.joined = []
            first = comp.primary(sc)
            if name.lower() not in self.tables and first.alias.lower() == name.lower() or first.alias.lower() == alias.lower():
                # UPDATE t SET .. FROM #target t JOIN source s ON ..
                target_name = next((t.text for t in source_tokens if t.kind == "temp"), name)
                alias = first.alias
                while not sc.accept("JOIN"):
                    if sc.accept(","):
                        break
                    sc.next()
                first = comp.primary(sc)
            source, source_alias = first.df, first.alias
            relations.append(Relation("", first.alias, first.columns))
            if sc.accept("ON"):
                on = sc.until()
        target = self.table(target_name)
        scope = Compiler(self).scope([Relation("", alias, target.dtypes), *relations])
        if target_name.startswith("#"):
            for n, t in target.dtypes:
                scope.columns[f"{target_name}.{n}".lower()] = kind_of_type(t)

        def text(tokens: list[Token]) -> str:
            fixed = [Token("word", alias, t.start, t.end) if t.kind == "temp" and t.text.lower() == target_name.lower() else t for t in tokens]
            return Parser(self.interpolated(fixed), scope).whole().sql

        sets = {}
        for p in split_commas(sets_tokens):
            pc = Cursor(p)
            left = pc.until("=")
            pc.expect("=")
            column = self.known(target, left[-1].text.strip('"') if left[-1].text != "]" else left[-2].text)
            value = text(pc.tokens[pc.i :])
            kind = dict(target.dtypes)[column]
            sets[column] = library.cast(value, kind) if kind in ("int", "bigint", "smallint") else value
        change = dml.update(target, sets, text(where) if where else "true", source, text(on) if on else None, alias, source_alias)
        return self.apply_change(target_name, change, output)

    def do_delete(self, c: Cursor) -> DataFrame | None:
        c.next()
        c.accept("FROM")
        name = c.name()
        alias = c.name() if c.now is not None and c.now.kind == "word" and c.now.up not in ("WHERE", "OUTPUT", "GO") else name.lstrip("#&")
        output = self.returning(c, "WHERE", ";", "GO")
        where = c.until(";", "GO") if c.accept("WHERE") else None
        c.accept(";")
        target = self.table(name)
        from .lang.query import Relation

        scope = Compiler(self).scope([Relation("", alias, target.dtypes)])
        if where is None:
            return self.apply_change(name, dml.delete(target, "true", alias), output)
        text = Parser(self.interpolated(where), scope).whole()
        if "(select" in text.sql:
            view = self.register_view(target.withColumn("__row", F.monotonically_increasing_id()))
            hit = self.spark.sql(f"select __row from {view} as {quote(alias)} where {Parser.truth(text)}").distinct()
            rows = self.spark.table(view)
            return self.apply_change(name, dml.Change(rows.join(hit, "__row", "left_anti").select(*target.columns), deleted=rows.join(hit, "__row", "left_semi").select(*target.columns)), output)
        return self.apply_change(name, dml.delete(target, Parser.truth(text), alias), output)

    def do_truncate(self, c: Cursor) -> None:
        c.next()
        c.accept("TABLE")
        name = c.name()
        self.tokens_of_statement(c)
        self.put(name, self.table(name).limit(0))

    def do_merge(self, c: Cursor) -> DataFrame | None:
        c.next()
        c.accept("INTO")
        name = c.name()
        alias = c.name() if c.accept("AS") or not c.at("USING") else name.lstrip("#&")
        c.expect("USING")
        comp = Compiler(self)
        comp.joined = []
        source = comp.primary(c)
        c.expect("ON")
        target = self.table(name)
        from .lang.query import Relation

        scope = comp.scope([Relation("", alias, target.dtypes), Relation("", source.alias, source.columns)])
        text = lambda ts: Parser(self.interpolated(ts), scope).whole().sql
        on = text(c.until("WHEN"))
        clauses = []
        while c.accept("WHEN"):
            no = c.accept("NOT")
            c.expect("MATCHED")
            by_source = False
            if c.accept("BY"):
                by_source = c.next().up == "SOURCE"
            kind = "not_matched_by_source" if no and by_source else "not_matched" if no else "matched"
            condition = text(c.until("THEN")) if c.accept("AND") else "true"
            c.expect("THEN")
            action = c.next().up
            values: dict[str, str] = {}
            if action == "UPDATE":
                c.expect("SET")
                for p in split_commas(c.until("WHEN", "OUTPUT", ";", "GO")):
                    pc = Cursor(p)
                    left = pc.until("=")
                    pc.expect("=")
                    values[left[-1].text.strip('"')] = text(pc.tokens[pc.i :])
            elif action == "INSERT":
                names = [Cursor(p).name() for p in split_commas(c.inside())] if c.at("(") else target.columns
                c.expect("VALUES")
                values = dict(zip(names, [text(p) for p in split_commas(c.inside())], strict=True))
            clauses.append(dml.When(kind, action.lower(), condition, values))
        output = self.returning(c, ";", "GO")
        c.accept(";")
        return self.apply_change(name, dml.merge(target, source.df, on, clauses, alias, source.alias), output)

    # --- preparation statements ----------------------------------------------------------------------------------------

    def option_list(self, tokens: list[Token]) -> dict[str, object]:
        return {p[0].up: self.scalar(p[2:]) for p in split_commas(tokens)}

    def do_transform(self, c: Cursor) -> None:
        c.next()
        target = c.name()
        c.expect("FROM")
        source = self.table(c.name())
        c.expect("USING")
        algorithm = c.name().upper()
        options = self.option_list(c.inside())
        self.tokens_of_statement(c)
        if algorithm not in transforms.ALGORITHMS:
            raise ScriptError(f"unknown algorithm {algorithm}")
        args = {}
        for k, v in options.items():
            key = {"N": "n"}.get(k, k.lower())
            if key in ("by_group", "key_cols", "row_fields"):
                v = [self.known(source, x.strip()) for x in str(v).split(",")]
            elif key.endswith("_col") and key not in ("diff_col", "pct_col", "share_col", "norm_col", "rolling_col") or key.endswith("_field"):
                v = self.known(source, str(v))
            args[key] = v
        self.put(target, transforms.ALGORITHMS[algorithm](source, **args))

    def do_generate(self, c: Cursor) -> None:
        c.next()
        if c.accept("CALENDAR"):
            c.accept("FROM")
            a = self.scalar(c.until("TO"))
            c.expect("TO")
            b = self.scalar(c.until("INTO"))
            c.expect("INTO")
            name = c.name()
            self.tokens_of_statement(c)
            self.put(name, prep.calendar(self.spark, str(a)[:10], str(b)[:10]))
            return
        n = int(self.scalar(c.until("ROWS")))
        c.expect("ROWS")
        c.expect("INTO")
        name = c.name()
        c.expect("AS")
        columns = {p[0].text.strip('"'): p[2].text[1:-1] for p in split_commas(c.inside())}
        seed = 0
        if c.accept("SEED"):
            c.accept("=")
            seed = int(self.scalar([c.next()]))
        self.tokens_of_statement(c)
        self.put(name, prep.generate_rows(self.spark, n, columns, seed))

    def do_compare(self, c: Cursor) -> None:
        c.next()
        c.expect("DATASETS")
        a = self.table(c.name())
        c.expect("WITH")
        b = self.table(c.name())
        key, exclude, into = [], [], None
        while c.now is not None and not c.at(";"):
            if c.accept("KEY"):
                c.accept("=")
                key = [Cursor(p).name() for p in split_commas(c.inside())]
            elif c.accept("EXCLUDE"):
                exclude = [Cursor(p).name() for p in split_commas(c.inside())]
            elif c.accept("INTO"):
                into = c.name()
            else:
                c.next()
        c.accept(";")
        self.put(into, prep.compare_datasets(a, b, key, exclude))

    def do_assert(self, c: Cursor) -> None:
        c.next()
        if c.accept("TABLE"):
            a = self.table(c.name())
            c.expect("MATCHES")
            b = self.table(c.name())
            options: dict[str, object] = {}
            if c.accept("WITH"):
                for p in split_commas(c.inside()):
                    options[p[0].up] = self.scalar(p[2:]) if len(p) > 2 and p[2].text != "(" else [Cursor(x).name() for x in split_commas(Cursor(p[2:]).inside())] if len(p) > 2 else True
            self.tokens_of_statement(c)
            quality.assert_table(a, b, bool(options.get("IGNORE_ORDER", False)) or not options.get("ORDERED"), float(options.get("TOLERANCE", 0) or 0), options.get("IGNORE_COLUMNS", []) or [], str(options.get("MESSAGE", "tables differ")))
            return
        tokens = self.tokens_of_statement(c)
        parts = split_commas(tokens)
        if not self.scalar(parts[0]):
            raise QualityError(str(self.scalar(parts[1])) if len(parts) > 1 else "assertion failed")

    def do_expect(self, c: Cursor) -> None:
        c.next()
        c.expect("SCHEMA")
        df = self.table(c.name())
        columns = []
        if c.accept("FROM"):
            with open(self.scalar([c.next()])) as f:
                columns = json.load(f)["schema"]
            for x in columns:
                x.setdefault("nullable", False)
        else:
            for p in split_commas(c.inside()):
                pc = Cursor(p)
                name = pc.name()
                kind = pc.name()
                pc.at("(") and pc.inside()
                columns.append({"column_name": name, "type_family": kind, "nullable": not pc.accept("NOT", "NULL")})
        warn = c.accept("ON", "DRIFT", "WARN")
        self.tokens_of_statement(c)
        self.warnings += quality.expect_schema(df, columns, warn)

    def do_replay(self, c: Cursor) -> None:
        c.next()
        c.expect("QUARANTINE")
        name = c.name()
        label = c.name() if c.accept("THROUGH") or c.accept("USING") or c.accept("INTO") else None
        self.tokens_of_statement(c)
        if label is None or label.lower() not in self.labels:
            raise ScriptError("REPLAY QUARANTINE needs the label of a SELECT")
        tokens = self.labels[label.lower()][0]
        q = self.table(name)
        source = next(t.text for i, t in enumerate(tokens) if i and tokens[i - 1].up == "FROM")
        before = self.tables.get(source.lower())
        released = q.where("__dq_status = 'released'").select(*[x for x in q.columns if not x.startswith("__dq_")])
        into = next((tokens[i + 1].text for i, t in enumerate(tokens) if t.up == "INTO"), None)
        old = self.tables.get(into.lower()) if into else None
        self.tables[source.lower()] = released
        try:
            self.statement(Cursor([t for t in tokens if t.text != ";"]))
        finally:
            if before is not None:
                self.tables[source.lower()] = before
        if into and old is not None:
            self.put(into, old.unionByName(self.tables[into.lower()], allowMissingColumns=True))
        self.put(name, q.withColumn("__dq_status", F.when(F.col("__dq_status") == "released", "replayed").otherwise(F.col("__dq_status"))))

    # --- routines ------------------------------------------------------------------------------------------------------

    def create_routine(self, c: Cursor, procedure: bool) -> None:
        name = c.name()
        parameters = []
        inner = c.inside() if c.at("(") else c.until("AS", "BEGIN")
        for p in split_commas(inner):
            pc = Cursor(p)
            pname = pc.next().text.lower()
            pc.accept("AS")
            kind = "".join(t.text for t in pc.until("=", "OUTPUT", "OUT"))
            default = pc.until("OUTPUT", "OUT") if pc.accept("=") else None
            parameters.append((pname, kind, pc.accept("OUTPUT") or pc.accept("OUT"), default))
        returns = None
        if c.accept("RETURNS"):
            returns = "".join(t.text for t in c.until("AS", "BEGIN"))
        c.accept("AS")
        body = self.skip(c)
        c.accept(";")
        (self.procedures if procedure else self.functions)[name.lower()] = Function(name, parameters, body, returns)

    def bound(self, f: Function, args: list, names: list[str | None]) -> dict[str, object]:
        out: dict[str, object] = {}
        free = [p for p in f.parameters if p[0] not in {(n or "").lower() for n in names}]
        for a, n in zip(args, names, strict=True):
            out[n.lower() if n else free.pop(0)[0]] = a
        return out

    def call_function(self, f: Function, args: list[Ex], names: list[str | None]) -> Ex:
        """A function whose body is one RETURN is inlined; another runs statement by statement, for constant arguments."""
        given = self.bound(f, args, names)
        for p, kind, _, default in f.parameters:
            if p not in given:
                given[p] = Parser(default, self.scope()).whole() if default else Ex("null")
            t = library.spark_type(kind)
            given[p] = Ex(f"cast({given[p].sql} as {t})", kind_of_type(t))
        body = [t for t in f.body if t.text != ";"]
        returns = library.spark_type(f.returns or "string")
        if body and body[0].up == "RETURN":
            scope = self.scope()
            outer = scope.variable
            scope.variable = lambda n: given[n.lower()] if n.lower() in given else outer(n)
            x = Parser(body[1:], scope).whole()
            return Ex(f"cast({x.sql} as {returns})", kind_of_type(returns))
        if any("`" in g.sql for g in given.values()):
            return Ex(f"cast({self.per_row(f)}({', '.join(f'cast({given[p].sql} as string)' for p, *_ in f.parameters)}) as {returns})", kind_of_type(returns))
        values = {p: self.spark.sql(f"select {g.sql}").first()[0] for p, g in given.items()}
        return literal(self.run_routine(f, values))

    def per_row(self, f: Function) -> str:
        """A procedural body over rows: variables, IF, WHILE and RETURN interpreted in Python on the executors."""
        from .lang.procedural import compile_body

        name = f"f_{f.name.lower()}"
        self.spark.udf.register(name, compile_body(f.body, [(p, library.spark_type(k)) for p, k, *_ in f.parameters]), "string")
        return name

    def run_routine(self, f: Function, values: dict[str, object]):
        saved, types = dict(self.variables), dict(self.types)
        depth = getattr(self, "_depth", 0)
        if depth > min(self.max_recursion, 200):
            raise ScriptError("recursion too deep")
        self._depth = depth + 1
        self.variables |= values
        self.types |= {p: library.spark_type(k) for p, k, *_ in f.parameters}
        try:
            self.block(Cursor(f.body))
            return None
        except _Return as r:
            return r.value
        finally:
            outs = {p: self.variables.get(p) for p, _, out, _ in f.parameters if out}
            self.variables, self.types, self._depth = saved, types, depth
            self._outs = outs

    def do_exec(self, c: Cursor) -> DataFrame | None:
        c.next()
        if c.at("("):
            text = self.scalar(c.inside())
            self.tokens_of_statement(c)
            return self.block(Cursor(tokenize(text)))
        target = None
        if c.now.kind == "variable" and c.peek() is not None and c.peek().text == "=":
            target = c.next().text.lower()
            c.next()
        name = c.name().lower()
        if name in self.connections and c.at("BEGIN"):
            return self.native_block(name, c)
        if name not in self.procedures:
            raise ScriptError(f"unknown procedure {name}")
        f = self.procedures[name]
        args, names, outs = [], [], []
        tokens = self.tokens_of_statement(c)
        if tokens and tokens[0].text == "(" :
            tokens = Cursor(tokens).inside()
        for p in split_commas(tokens):
            pname = None
            if len(p) > 2 and p[0].kind == "variable" and p[1].text == "=":
                pname, p = p[0].text, p[2:]
            out = p[-1].up in ("OUTPUT", "OUT")
            p = p[:-1] if out else p
            outs.append(p[0].text.lower() if out else None)
            args.append(self.scalar(p))
            names.append(pname)
        given = self.bound(f, args, names)
        for p, _, _, default in f.parameters:
            given.setdefault(p, self.scalar(default) if default else None)
        value = self.run_routine(f, given)
        for (p, _, is_out, _), o in zip(f.parameters, outs, strict=False):
            if is_out and o:
                self.variables[o] = self._outs.get(p)
        if target:
            self.variables[target] = value
        return None

    do_execute = do_exec

    def native_block(self, connection: str, c: Cursor) -> DataFrame:
        """EXECUTE connection BEGIN native SQL END: the text runs in the database as it is written."""
        from .sources import readers

        c.expect("BEGIN")
        start, depth = c.now, 1
        while True:
            t = c.next()
            depth += (t.kind == "word" and t.up in ("BEGIN", "CASE")) - (t.kind == "word" and t.up == "END")
            if not depth:
                break
        text = self.interpolate(c.text[start.start : t.start]).strip().rstrip(";")
        kind, options = self.connections[connection]
        return readers.read(self.spark, kind, options | {"QUERY": text})

    def do_run(self, c: Cursor) -> DataFrame | None:
        """RUN SCRIPT path [WITH (@parameter = value, ...)]: another script with variables of its own and the tables of this one.

        Parameters it declares as INPUT take the values; those declared as OUTPUT go back to the
        variables they are set equal to.
        """
        c.expect("RUN", "SCRIPT")
        path = str(self.scalar(c.until("WITH", ";", "GO")))
        given = [Cursor(p) for p in split_commas(c.inside())] if c.accept("WITH") else []
        self.tokens_of_statement(c)
        pairs = []
        for p in given:
            name = p.next().text.lower()
            p.expect("=")
            pairs.append((name, p.tokens[p.i :]))
        if "://" not in path:
            path = os.path.join(self.folder, path)
        row = self.spark.read.text(path, wholetext=True).first()
        child = Session(self.spark)
        shared = ("tables", "schemas", "views", "sets", "functions", "procedures", "host", "connections", "state", "printed", "warnings", "lineage")
        for x in shared:
            setattr(child, x, getattr(self, x))
        child.settings, child.folder = dict(self.settings), os.path.dirname(path)
        own = lambda t: len(t) == 1 and t[0].kind == "variable" and t[0].text.lower() not in self.variables
        child.inputs = {n: None if own(t) else self.scalar(t) for n, t in pairs}
        out = child.sql(row[0] if row else "")
        for n, t in pairs:
            if len(t) == 1 and t[0].kind == "variable" and n in child.outputs:
                self.variables[t[0].text.lower()] = child.variables[n]
        return out

    def do_bulk(self, c: Cursor) -> None:
        """BULK INSERT target [(columns)] FROM path [WITH (options)]; @@ROWCOUNT is the number of rows loaded."""
        from .sources import readers

        c.expect("BULK", "INSERT")
        name = c.name()
        columns = [p[0].text.strip('"') for p in split_commas(c.inside())] if c.at("(") else None
        c.expect("FROM")
        path = str(self.scalar(c.until("WITH", ";", "GO")))
        options = Compiler(self).options(c.inside()) if c.accept("WITH") else {}
        self.tokens_of_statement(c)
        target = self.table(name)
        header = options.get("HEADER", int(options.get("FIRSTROW", 1)) > 1)
        header = str(header).upper() == "TRUE"
        given = target.select(*columns) if columns else target
        good, rejected = readers.bulk_insert(
            self.spark, path, given, str(options.get("MAPPING", "NAME" if header else "POSITION")), max(int(options.get("FIRSTROW", 1)), 2 if header else 1), int(options.get("MAXERRORS", 0)), str(options.get("FIELDTERMINATOR", ",")), header
        )
        bad = rejected.count()
        if bad:
            self.warnings.append(f"{path}: {bad} rejected rows")
        meta = self.schemas.get(name.lower(), [])
        identity = next((x for x in meta if x.identity), None)
        self.apply_change(name, dml.insert(target, good, given.columns, identity.name if identity else None, {x.name: x.default for x in meta if x.default}, identity.numbers if identity else (1, 1)), None)

    # --- several at once, and jumps --------------------------------------------------------------------------------------

    def do_parallel(self, c: Cursor) -> None:
        """PARALLEL BEGIN ... END: its statements at the same time, at most MAX_PARALLEL_DEGREE of them. All end before an error is raised."""
        c.next()
        tokens = self.skip(c)
        parts: list[list[Token]] = [[]]
        depth = 0
        for t in tokens:
            if t.kind == "word":
                depth += (t.up in ("BEGIN", "CASE")) - (t.up == "END")
            if t.text == ";" and depth == 0:
                parts.append([])
            else:
                parts[-1].append(t)
        parts = [p for p in parts if p]

        def run(part: list[Token]) -> None:
            out = self.block(Cursor(part, c.text))
            if out is not None:
                out.write.format("noop").mode("overwrite").save()

        with ThreadPoolExecutor(max(1, int(self.settings.get("MAX_PARALLEL_DEGREE", 8)))) as pool:
            jobs = [pool.submit(run, p) for p in parts]
        errors = [e for e in (j.exception() for j in jobs) if e is not None]
        if errors:
            raise errors[0]

    def do_goto(self, c: Cursor) -> None:
        c.next()
        label = c.name()
        self.tokens_of_statement(c)
        raise _Goto(label)

    # --- control flow --------------------------------------------------------------------------------------------------

    def do_if(self, c: Cursor) -> DataFrame | None:
        c.next()
        hit = self.condition(c)
        if hit:
            out = self.body(c)
        else:
            self.skip(c)
            out = None
        c.accept(";")
        if c.accept("ELSE"):
            if hit:
                self.skip_else(c)
            else:
                out = self.body(c)
        c.accept("END", "IF")
        return out

    def skip_else(self, c: Cursor) -> None:
        if c.at("IF"):
            c.next()
            c.until("BEGIN", "THEN")
            c.accept("THEN")
            self.skip(c)
            if c.accept("ELSE"):
                self.skip_else(c)
        else:
            self.skip(c)

    def do_while(self, c: Cursor) -> None:
        c.next()
        start = c.i
        while True:
            c.i = start
            hit = self.condition(c)
            if not hit:
                self.skip(c)
                return
            try:
                self.body(c)
            except _Continue:
                continue
            except _Break:
                c.i = start
                c.until("BEGIN")
                self.skip(c)
                return

    def loop(self, values, assign: Callable, body: list[Token]) -> None:
        for v in values:
            assign(v)
            try:
                self.block(Cursor(body))
            except _Continue:
                continue
            except _Break:
                break

    def do_for(self, c: Cursor) -> None:
        """FOR @i = a TO b [STEP s], and FOR @row IN (query)."""
        c.next()
        name = c.next().text.lower()
        if c.accept("IN"):
            rows = self.query(c.inside()) if c.at("(") else self.table(c.name())
            c.accept("DO")
            body = self.skip(c)
            self.loop(rows.toLocalIterator(), lambda r: self.assign_row(name, r), body)
            return
        c.accept("=")
        a = self.scalar(c.until("TO"))
        c.expect("TO")
        b = self.scalar(c.until("STEP", "BEGIN", "DO"))
        step = self.scalar(c.until("BEGIN", "DO")) if c.accept("STEP") else 1
        c.accept("DO")
        body = self.skip(c)
        self.loop(range(int(a), int(b) + (1 if step > 0 else -1), int(step)), lambda v: self.variables.__setitem__(name, v), body)

    def assign_row(self, name: str, row) -> None:
        self.variables[name] = row[0]
        for k, v in row.asDict().items():
            self.variables[f"{name}.{k}".lower()] = v
            self.variables[f"@{k}".lower()] = v

    def do_foreach(self, c: Cursor) -> None:
        c.next()
        name = c.next().text.lower()
        c.expect("IN")
        if c.now.kind == "temp":
            values = [r[0] for r in self.table(c.name()).toLocalIterator()]
        elif c.at("(") and c.peek().up in ("SELECT", "WITH"):
            values = [r[0] for r in self.query(c.inside()).toLocalIterator()]
        else:
            values = self.scalar(c.until("BEGIN", "DO"))
        c.accept("DO")
        body = self.skip(c)
        self.loop(values or [], lambda v: self.variables.__setitem__(name, v), body)

    def do_break(self, c: Cursor) -> None:
        self.tokens_of_statement(c)
        raise _Break

    def do_continue(self, c: Cursor) -> None:
        self.tokens_of_statement(c)
        raise _Continue

    def do_return(self, c: Cursor) -> None:
        c.next()
        tokens = c.until(";", "END")
        raise _Return(self.scalar(tokens) if tokens else None)

    def do_throw(self, c: Cursor) -> None:
        c.next()
        parts = split_commas(self.tokens_of_statement(c))
        if not parts:
            raise ScriptError(str(self.error.get("message")), int(self.error.get("number") or 50000))
        values = [self.scalar(p) for p in parts]
        if len(values) >= 2:
            raise ScriptError(str(values[1]), int(values[0]), int(values[2]) if len(values) > 2 else 1)
        raise ScriptError(str(values[0]))

    def do_raiseerror(self, c: Cursor) -> None:
        c.next()
        parts = split_commas(c.inside()) if c.at("(") else split_commas(self.tokens_of_statement(c))
        c.accept(";")
        values = [self.scalar(p) for p in parts]
        raise ScriptError(str(values[0]), 50000, int(values[2]) if len(values) > 2 else 1, int(values[1]) if len(values) > 1 else 16)

    do_raiserror = do_raiseerror

    def do_waitfor(self, c: Cursor) -> None:
        self.tokens_of_statement(c)

    def do_begin(self, c: Cursor) -> DataFrame | None:
        c.next()
        if c.accept("TRY"):
            return self.try_block(c)
        if c.accept("TRANSACTION") or c.accept("TRAN"):
            self.tokens_of_statement(c)
            self.snapshots.append((dict(self.tables), dict(self.variables), dict(self.schemas)))
            self.variables["@@trancount"] = len(self.snapshots)
            return None
        out = self.block(c, "END")
        c.expect("END")
        c.accept(";")
        return out

    def try_block(self, c: Cursor) -> DataFrame | None:
        start, depth = c.i, 1
        while True:
            if c.at("BEGIN", "TRY"):
                depth += 1
            elif c.at("END", "TRY"):
                depth -= 1
                if not depth:
                    break
            c.next()
        body = c.tokens[start : c.i]
        c.expect("END", "TRY")
        c.accept(";")
        c.expect("BEGIN", "CATCH")
        begin, depth = c.i, 1
        while True:
            if c.at("BEGIN", "CATCH"):
                depth += 1
            elif c.at("END", "CATCH"):
                depth -= 1
                if not depth:
                    break
            c.next()
        handler = c.tokens[begin : c.i]
        c.expect("END", "CATCH")
        c.accept(";")
        try:
            return self.block(Cursor(body))
        except (_Break, _Continue, _Return, _Goto):
            raise
        except Exception as e:  # the language's CATCH takes any failed statement
            self.error = {"message": str(e), "number": getattr(e, "number", 50000), "state": getattr(e, "state", 1), "severity": getattr(e, "severity", 16), "line": 0}
            return self.block(Cursor(handler))

    def do_commit(self, c: Cursor) -> None:
        self.tokens_of_statement(c)
        if not self.snapshots:
            raise ScriptError("no transaction is open")
        self.snapshots.pop()
        self.variables["@@trancount"] = len(self.snapshots)

    def do_rollback(self, c: Cursor) -> None:
        self.tokens_of_statement(c)
        if not self.snapshots:
            raise ScriptError("no transaction is open")
        self.tables, self.variables, self.schemas = (dict(x) for x in self.snapshots[0])
        self.snapshots.clear()
        self.variables["@@trancount"] = 0
