"""Facts about Python files from their syntax trees; nothing is ever executed."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import struct

# Limits of one request.
MAX_DEPTH, MAX_NODES = 50, 25_000
MAX_FILES, MAX_TOTAL_BYTES, MAX_FILE_BYTES = 20, 10 * 1024 * 1024, 512 * 1024
VERBS = {"get", "post", "put", "delete", "patch", "head", "options"}
TECHNOLOGIES = (("fastapi", "FastAPI"), ("flask", "Flask"), ("django", "Django"), ("pydantic", "Pydantic"), ("sqlalchemy", "SQLAlchemy"), ("tortoise", "Tortoise ORM"))

FACT_SCHEMA = "kind string, name string, detail string, framework string, line_number int, flag boolean, owner string"
_FIELDS = [f.split(" ")[0] for f in FACT_SCHEMA.split(", ")]
Fact = tuple[str, str | None, str | None, str | None, int | None, bool | None, str | None]


def spelled(node: ast.AST | None) -> str:
    """A name, attribute, constant or subscript as text; anything else is Unknown."""
    match node:
        case ast.Name(id=x):
            return x
        case ast.Attribute(value=v, attr=x):
            return f"{spelled(v)}.{x}"
        case ast.Constant(value=v):
            return str(v)
        case ast.Subscript(value=v, slice=s):
            return f"{spelled(v)}[{spelled(s)}]"
    return "Unknown"


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _path_argument(call: ast.Call) -> str | None:
    if call.args and (first := _text(call.args[0])) is not None:
        return first
    named = (_text(k.value) for k in call.keywords if k.arg in ("path", "rule"))
    return next((p for p in named if p is not None), None)


def _technology(module: str) -> bool:
    return any(t in module.lower() for t, _ in TECHNOLOGIES)


def _routes(node: ast.FunctionDef | ast.AsyncFunctionDef) -> Iterator[Fact]:
    """Decorators named as HTTP verbs, or ``route`` with one fact a method."""
    for d in node.decorator_list:
        match d:
            case ast.Call(func=ast.Attribute(attr=verb)) if verb.lower() in VERBS:
                if path := _path_argument(d):
                    guarded = any(k.arg in ("dependencies", "security") for k in d.keywords)
                    yield "route", verb.upper(), path, "fastapi", node.lineno, guarded, node.name
            case ast.Call(func=ast.Attribute(attr="route")):
                if path := _path_argument(d):
                    listed = next((k.value.elts for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List | ast.Tuple)), [])
                    methods = [t.upper() for e in listed if (t := _text(e)) is not None] or ["GET"]
                    yield from (("route", m, path, "flask", node.lineno, False, node.name) for m in methods)


def _call_facts(node: ast.Call) -> Iterator[Fact]:
    name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else ""
    if isinstance(node.func, ast.Attribute) and node.args and (variable := _text(node.args[0])) is not None:
        caller = spelled(node.func.value)
        if name == "getenv" and "os" in caller or name == "get" and "environ" in caller:
            yield "env_ref", variable, f"{caller}.{name}", None, node.lineno, None, None
    if name in ("path", "re_path") and node.args and (path := _path_argument(node)) is not None:
        handler = spelled(node.args[1]) if len(node.args) > 1 else None
        yield "route", "GET", "/" + path.removeprefix("/") if not path.startswith("/") else path, "django", node.lineno, False, handler


def _column(value: ast.AST | None) -> bool:
    return isinstance(value, ast.Call) and "Column" in spelled(value.func)


def _model(node: ast.ClassDef) -> Iterator[Fact]:
    """A class with a model's base, or with columns in its body; then its fields."""
    bases = [spelled(b) for b in node.bases]
    pydantic = any("BaseModel" in b for b in bases)
    if not (pydantic or any("Base" in b or "Model" in b for b in bases) or any(isinstance(s, ast.Assign) and _column(s.value) for s in node.body)):
        return
    yield "model", node.name, None, "pydantic" if pydantic else "sqlalchemy", node.lineno, None, None
    for s in node.body:
        match s:
            case ast.AnnAssign(target=ast.Name(id=field), annotation=annotation, value=value):
                kind = spelled(annotation)
                optional = kind.startswith("Optional") or "None" in kind
                yield "field", field, kind, None, s.lineno, value is None or not optional, node.name
            case ast.Assign(targets=fields, value=ast.Call() as value) if _column(value):
                kind = spelled(value.args[0]) if value.args else "Any"
                yield from (("field", t.id, kind, None, s.lineno, True, node.name) for t in fields if isinstance(t, ast.Name))


def _facts_of(node: ast.AST) -> Iterator[Fact]:
    match node:
        case ast.Import(names=names):
            yield from (("import", a.name, f"import {a.name}", None, node.lineno, None, None) for a in names if _technology(a.name))
        case ast.ImportFrom(module=str(module)) if module and _technology(module):
            yield "import", module, f"from {module} import ...", None, node.lineno, None, None
        case ast.FunctionDef() | ast.AsyncFunctionDef():
            yield from _routes(node)
        case ast.ClassDef():
            yield from _model(node)
        case ast.Call():
            yield from _call_facts(node)
        case ast.Subscript(value=value, slice=ast.Constant(value=str(variable))) if "environ" in spelled(value):
            yield "env_ref", variable, f"{spelled(value)}[]", None, node.lineno, None, None


def facts(content: str | None) -> list[Fact]:
    """All facts of a file, its diagnostics, and the number of nodes visited, in reading order."""
    if content is None:
        return []
    if len(content.encode("utf-8", "replace")) > MAX_FILE_BYTES:
        return [("diagnostic", "FILE_SIZE_LIMIT_EXCEEDED", f"file exceeds {MAX_FILE_BYTES} bytes limit", "info", None, None, None)]
    try:
        tree = ast.parse(content)
    except SyntaxError as e:
        return [("diagnostic", "PARSE_SYNTAX_ERROR", f"syntax error at line {e.lineno}: {e.msg}", "warning", e.lineno, None, None)]
    except (ValueError, RecursionError, MemoryError) as e:
        return [("diagnostic", "PARSER_EXCEPTION", str(e), "warning", None, None, None)]
    out: list[Fact] = []
    visited, reported = 0, set()
    stack: list[tuple[ast.AST, int]] = [(tree, 0)]
    while stack:
        node, depth = stack.pop()
        visited += 1
        over = "MAX_DEPTH_EXCEEDED" if depth > MAX_DEPTH else "MAX_NODES_EXCEEDED" if visited > MAX_NODES else None
        if over:
            if over not in reported:
                reported.add(over)
                text = f"AST depth exceeded {MAX_DEPTH}" if depth > MAX_DEPTH else f"AST node limit {MAX_NODES} reached"
                out.append(("diagnostic", over, text, "info", None, None, None))
            continue
        out += _facts_of(node)
        stack += [(c, depth + 1) for c in reversed(list(ast.iter_child_nodes(node)))]
    out.append(("nodes", str(visited), None, None, visited, None, None))
    return out


@F.pandas_udf(T.ArrayType(struct(FACT_SCHEMA)))
def facts_udf(contents: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(_FIELDS, f, strict=True)) for f in facts(c)] for c in contents])


def latest(sources: DataFrame) -> DataFrame:
    """Each file's latest submission, its path with forward slashes.  A content is exchanged once."""
    newest = Window.partitionBy("file_id").orderBy(F.desc("received_at"), F.desc("submitted_at"), F.desc("content"))
    rows = sources.withColumn("place", F.row_number().over(newest)).where("place = 1")
    return rows.select("file_id", "task_id", "repo", F.regexp_replace("path", r"\\", "/").alias("path"), "content")


def source_facts(sources: DataFrame) -> DataFrame:
    """(task_id, file_id, path, fact columns) of every Python file, of tasks within their limits only."""
    files = latest(sources)
    python = files.where(F.lower("path").rlike(r"\.pyi?$"))
    facts = python.select("task_id", "file_id", "path", F.explode(facts_udf("content")).alias("f")).select("task_id", "file_id", "path", "f.*")
    refused = _limits(files).where("status = 'ERROR'").select(F.col("task_id").alias("refused"))
    return facts.join(refused, facts["task_id"].eqNullSafe(F.col("refused")), "left_anti")


def totals(facts: DataFrame) -> DataFrame:
    """(task_id, n_files, n_nodes): the files parsed and the nodes visited in them."""
    return facts.where("kind = 'nodes'").groupBy("task_id").agg(F.count("*").alias("n_files"), F.sum("line_number").alias("n_nodes"))


# By what the facts of an answer are sorted.
ORDERS = {"route": ("name", "detail", "path"), "model": ("name", "path"), "env_ref": ("name", "path", "line_number"), "import": ("path", "detail"), "diagnostic": ("path", "name")}


def placed(facts: DataFrame) -> DataFrame:
    """Facts of the five kinds with ``place``, from 0, in their task's answer."""
    keys = F.lit(None)
    for kind, columns in ORDERS.items():
        key = F.concat_ws("\x00", *[F.lpad(F.col(c).cast("string"), 9, "0") if c == "line_number" else F.coalesce(F.col(c), F.lit("")) for c in columns])
        keys = F.when(F.col("kind") == kind, key).otherwise(keys)
    order = Window.partitionBy("task_id", "kind").orderBy(keys, "path", "line_number", "name", "detail", "owner")
    return facts.where(F.col("kind").isin(*ORDERS)).withColumn("place", F.row_number().over(order) - 1)


def request_limits(sources: DataFrame) -> DataFrame:
    """(task_id, n_files, n_bytes, status): a task with too many files or bytes is an error as a whole."""
    return _limits(latest(sources))


def _limits(files: DataFrame) -> DataFrame:
    rows = files.groupBy("task_id").agg(F.count("*").alias("n_files"), F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("n_bytes"))
    return rows.withColumn("status", F.when((F.col("n_files") > MAX_FILES) | (F.col("n_bytes") > MAX_TOTAL_BYTES), "ERROR").otherwise("SUCCESS"))
