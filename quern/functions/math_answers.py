"""Equality of mathematical answers and checks of arithmetic, which need a parser: Arrow-batched UDFs."""

from __future__ import annotations

import ast
import operator
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def boxed(text: str | None) -> str | None:
    """What stands in the last \\boxed{...}, or \\fbox{...} where there is none, braces balanced. '\\boxed x', with a space, holds what
    stands up to the next dollar sign and goes before the others."""
    text = text or ""
    if "\\boxed " in text:
        return text.rsplit("\\boxed ", 1)[1].split("$")[0]
    at = max(text.rfind("\\boxed{"), -1)
    at = at if at >= 0 else text.rfind("\\fbox{")
    if at < 0:
        return None
    depth, start = 0, text.index("{", at) + 1
    for i in range(start - 1, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start:i]
    return None


def canonical(answer: str | None) -> str | None:
    """Spacing, fractions, units and marks of LaTeX taken to one form."""
    if answer is None:
        return None
    s = re.sub(r"\\(?:left|right|!|,|;|%|\$)|\s|\$|%", "", answer)
    s = re.sub(r"\\text\{.*?\}", "", s).replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac").replace("^\\circ", "")
    s = re.sub(r"\\frac(\w)(\w)", r"\\frac{\1}{\2}", s)
    s = re.sub(r"\\sqrt(\w)", r"\\sqrt{\1}", s)
    s = re.sub(r"^(-?\d+)/(\d+)$", r"\\frac{\1}{\2}", s)
    s = re.sub(r"^\w+=", "", s)
    return "0" + s if s.startswith(".") else s.rstrip(".")


def evaluate(expression: str) -> float | None:
    """Value of numbers with + - * / and parentheses; None for anything else."""

    def walk(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -walk(node.operand)
        raise ValueError

    try:
        return walk(ast.parse(expression, mode="eval"))
    except (ValueError, SyntaxError, ZeroDivisionError, RecursionError, MemoryError, OverflowError):
        return None


def countdown_ok(expression: str | None, numbers: list[int], target: float) -> bool:
    """Whether the expression uses each number once and comes to the target."""
    if expression is None or Counter(map(int, re.findall(r"\d+", expression))) != Counter(numbers):
        return False
    value = evaluate(expression)
    return value is not None and abs(value - target) < 1e-5


@F.pandas_udf(BooleanType())
def math_equal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether two texts' answers (boxed, or all of the text) are the same."""
    for a, b in batches:
        yield pd.Series([canonical(boxed(x) or x) == canonical(boxed(y) or y) for x, y in zip(a, b, strict=True)], dtype="bool")


@F.pandas_udf(BooleanType())
def countdown_equal(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for e, n, t in batches:
        yield pd.Series([countdown_ok(x, list(y), z) for x, y, z in zip(e, n, t, strict=True)], dtype="bool")
