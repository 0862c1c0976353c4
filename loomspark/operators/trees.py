"""Operators on Python syntax trees; programs are parsed, never run."""

from __future__ import annotations

import ast
import io
import tokenize
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tree(code: str | None):
    if code is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def statements(tree: ast.AST):
    """Statements in the order of a walk by levels, without going into expressions."""
    level = list(tree.body)
    while level:
        yield from level
        deeper = []
        for n in level:
            for name in ("body", "orelse", "finalbody"):
                deeper += getattr(n, name, ())
            for part in (*getattr(n, "handlers", ()), *getattr(n, "cases", ())):
                deeper += part.body
        level = deeper


#: The method that holds the forward pass in each framework.
METHODS = {"pytorch": "forward", "paddlepaddle": "forward", "tensorflow": "call"}


def clean_comments(code: str | None, dll: str | None) -> str | None:
    """Code without the comments behind statements of the first forward method; whole-line comments stay.

    NULL where the code doesn't parse or the framework isn't known; unchanged without such a method.
    """
    tree = _tree(code)
    name = METHODS.get(dll.strip().lower()) if dll else None
    if tree is None or name is None:
        return None
    node = next((n for n in statements(tree) if isinstance(n, ast.FunctionDef) and n.name == name), None)
    if node is None:
        return code
    lines = code.split("\n")
    first, last = node.lineno - 1, node.end_lineno
    part = lines[first:last]
    if not any("#" in x for x in part):
        return code
    above = ["if 1:"] if part[0][:1].isspace() else []  # a method's lines stand alone under a header
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO("\n".join([*above, *part]) + "\n").readline))
    except (tokenize.TokenError, SyntaxError):
        return None
    for token in tokens:
        row, column = token.start
        if token.type == tokenize.COMMENT and token.line[:column].strip():
            at = row - 1 - len(above)
            part[at] = part[at][:column].rstrip()
    return "\n".join([*lines[:first], *part, *lines[last:]])


def clean_comments_column(code: Column, dll: Column) -> Column:
    @F.pandas_udf("string")
    def run(codes: pd.Series, dlls: pd.Series) -> pd.Series:
        return pd.Series([clean_comments(c, d) for c, d in zip(codes, dlls)], dtype=object)

    return run(code, dll)


#: Containers whose elements are told apart by their place.
CONTAINERS = ("Sequential", "ModuleList", "LayerList")


def _elements(call: ast.Call) -> list[ast.Call]:
    """Constructors in a container, in order."""
    parts = call.args[0].elts if len(call.args) == 1 and isinstance(call.args[0], (ast.List, ast.Tuple)) else call.args
    return [p for p in parts if isinstance(p, ast.Call)]


def definitions(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, attribute, constructor, line) of each self.<attribute> = <constructor>(...) of a program.

    The elements of a container follow it as <attribute>.<place>. Programs that don't parse give none.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            out = []
            for k, text in zip(pdf[key], pdf[code]):
                tree = _tree(text) if text and "self" in text else None
                for n in statements(tree) if tree else ():
                    if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call):
                        for t in n.targets:
                            if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                                name = ast.unparse(n.value.func)
                                out.append((k, t.attr, name, n.lineno))
                                if name.rpartition(".")[2] in CONTAINERS:
                                    out += [(k, f"{t.attr}.{i}", ast.unparse(x.func), x.lineno) for i, x in enumerate(_elements(n.value))]
            yield pd.DataFrame(out, columns=[key, "attribute", "constructor", "line"])

    return df.select(key, code).mapInPandas(run, f"{key} {kind}, attribute string, constructor string, line int")


def crash_definitions(programs: DataFrame, crashes: DataFrame, key: str, code: str) -> DataFrame:
    """(key, attribute, constructor, line, crash_line): what the module called at each crash is, from (key, crash_line, crash_code).

    A crash at self.<attribute>(...) gives the attribute's definition in the same program and, of a container, its
    elements; crashes elsewhere, and attributes that the program doesn't define, give none.
    """
    called = crashes.withColumn("called", F.regexp_extract("crash_code", r"\bself\.(\w+)\s*\(", 1)).where("called <> ''").select(key, "called", "crash_line").distinct()
    wanted = programs.join(called.select(key).distinct(), key, "left_semi")
    found = definitions(wanted, key, code).withColumn("called", F.substring_index("attribute", ".", 1)).distinct()
    return found.join(called, [key, "called"]).drop("called")


def mask_arguments(code: str | None, attribute: str, arguments: list[str]) -> str | None:
    """Code in which the named arguments of self.<attribute>'s constructor read 'mask'; unchanged where there are none."""
    tree = _tree(code)
    if tree is None:
        return None
    spans = []
    for n in statements(tree):
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and any(isinstance(t, ast.Attribute) and t.attr == attribute for t in n.targets):
            spans += [(w.value.lineno, w.value.col_offset, w.value.end_lineno, w.value.end_col_offset) for w in n.value.keywords if w.arg in arguments]
    raw = [line.encode() for line in code.split("\n")]
    for a, b, c, d in sorted(spans, reverse=True):
        if a == c:
            raw[a - 1] = raw[a - 1][:b] + b"'mask'" + raw[a - 1][d:]
    return b"\n".join(raw).decode()


def masked(df: DataFrame, key: str, code: str, attribute: str, arguments: str) -> DataFrame:
    """(key, code) with the diagnosed arguments of each row masked; NULL where the code doesn't parse."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            out = [mask_arguments(c, a, list(x) if x is not None else []) if a else c for c, a, x in zip(pdf[code], pdf[attribute], pdf[arguments])]
            yield pd.DataFrame({key: pdf[key], "code": pd.Series(out, dtype=object)})

    return df.select(key, code, attribute, arguments).mapInPandas(run, f"{key} {kind}, code string")


@F.udtf(returnType="line int, depth int, kind string")
class Statements:
    """Table function: the statements of a program with their depth and kind; none of one that doesn't parse."""

    def eval(self, code: str | None):
        tree = _tree(code)
        todo = [(n, 0) for n in tree.body[::-1]] if tree else []
        while todo:
            n, depth = todo.pop()
            yield n.lineno, depth, type(n).__name__
            inner = [x for name in ("body", "orelse", "finalbody") for x in getattr(n, name, ())]
            inner += [x for part in (*getattr(n, "handlers", ()), *getattr(n, "cases", ())) for x in part.body]
            todo += [(x, depth + 1) for x in inner[::-1]]


def parses_column(code: Column) -> Column:
    """Whether code parses as Python; NULL for NULL."""

    @F.pandas_udf("boolean")
    def run(codes: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else _tree(c) is not None for c in codes], dtype=object)

    return run(code)


