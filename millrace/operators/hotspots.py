"""Complexity by function: a scope stack over a file's signs gives each branch to the function around it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.operators.text import sources
from millrace.plans.registry import query
from millrace.sources.lake import Lake

_SIGNS = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"|\bfunction\b\s*\*?\s*(?P<named>[\w$]+)?\s*\("
    r"|(?P<bound>[\w$]+)\s*[=:]\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*=>"
    r"|(?P<branch>\b(?:if|for|while|case|catch)\b)|(?P<join>&&|\|\||\?\?)"
    r"|(?P<method>\b(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)[\w$]+)\s*\([^(){};]*\)\s*(?=\{)"
    r"|(?P<open>\{)|(?P<close>\})",
    re.S,
)
_PYTHON = re.compile(r"^(?P<indent>[ \t]*)(?:(?:async[ ]+)?def[ ]+(?P<name>\w+)|(?P<text>\S.*))", re.M)
_BRANCH = re.compile(r"\b(?:if|elif|for|while|except|case)\b")
_JOIN = re.compile(r"\b(?:and|or)\b")

#: (name, line, cyclomatic, cognitive)
Function = tuple[str, int, int, int]


def braced(text: str) -> list[Function]:
    """Functions of a language with braces, in the order in which they begin. Branches outside of any function belong to
    none; a branch counts one, and one more for each brace that it stands in within its function."""
    found: list[list] = []
    stack: list[int | None] = []  # the function that a brace opens, or None
    pending: list | None = None
    line, told = 1, 0
    for m in _SIGNS.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if kind == "open":
            if pending:
                found.append(pending)
            stack.append(len(found) - 1 if pending else None)
            pending = None
        elif kind == "close":
            if stack:
                stack.pop()
        elif kind in ("branch", "join"):
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] is not None), None)
            if at is not None:
                function = found[stack[at]]
                function[2] += 1
                function[3] += len(stack) - at if kind == "branch" else 1
        else:
            name = m["named"] or m["bound"] or m["method"] or "(anonymous)"
            line, told = line + text.count("\n", told, m.start()), m.start()
            pending = [name, line, 1, 0]
            if kind == "bound" and not re.match(r"\s*\{", text[m.end() : m.end() + 200]):
                pending = None  # an expression: it has no scope of its own
    return [tuple(f) for f in found]


def indented(text: str) -> list[Function]:
    """Functions of Python, by indentation."""
    found: list[list] = []
    stack: list[tuple[int, int]] = []  # (indent of the def, the function)
    blocks: list[int] = []  # indents of the branches around
    at, told = 1, 0
    for m in _PYTHON.finditer(text):
        indent = len(m["indent"].expandtabs())
        if not m["name"] and m["text"].startswith("#"):
            continue
        while stack and indent <= stack[-1][0]:
            stack.pop()
        while blocks and indent <= blocks[-1]:
            blocks.pop()
        if m["name"]:
            stack.append((indent, len(found)))
            at, told = at + text.count("\n", told, m.start()), m.start()
            found.append([m["name"], at, 1, 0])
            continue
        line = re.sub(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|#.*)""", "", m["text"])
        branches, joins = len(_BRANCH.findall(line)), len(_JOIN.findall(line))
        if stack:
            function = found[stack[-1][1]]
            depth = 1 + sum(b > stack[-1][0] for b in blocks)
            function[2] += branches + joins
            function[3] += branches * depth + joins
        if branches and line.rstrip().endswith(":"):
            blocks.append(indent)
    return [tuple(f) for f in found]


def functions_of(path: str, text: str) -> list[Function]:
    return indented(text) if path.endswith(".py") else braced(text)


@query(None)
def complexity_hotspots(lake: Lake) -> DataFrame:
    """``(repo, path, function, line, cyclomatic, cognitive, risk)`` of every function in every file. Files without a sign
    of code are told in the JVM and never reach a task's Python."""

    names = ["repo", "path", "function", "line", "cyclomatic", "cognitive"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, text in zip(*[c.to_pylist() for c in batch.columns]):
                rows += [(repo, path, *f) for f in functions_of(path, text)]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    code = F.contains("content", F.lit("{")) & F.contains("content", F.lit("(")) | F.contains("content", F.lit("def "))
    found = sources(lake).where(code).mapInArrow(run, "repo string, path string, function string, line int, cyclomatic int, cognitive int")
    n = F.col("cyclomatic")
    return found.withColumn("risk", F.when(n > 20, "critical").when(n > 10, "high").when(n > 5, "medium").otherwise("low"))
