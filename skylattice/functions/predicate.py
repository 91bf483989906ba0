"""String predicates as Column expressions, parsed with a whitelist and never evaluated as code."""

from __future__ import annotations

import ast
import operator
import re
from functools import reduce

from pyspark.sql import Column, functions as F

BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.Pow: lambda a, b: F.pow(a, b)}
COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}


class PredicateError(ValueError):
    """The text is not a predicate of the supported grammar."""


def parse(text: str) -> Column:
    """A filter over columns: comparisons (also chained), ``& | ~ and or not``, arithmetic, ``in``
    lists, numbers, strings, names and backticked names. ``&`` binds as in Python."""
    if "@" in re.sub(r"'[^']*'|\"[^\"]*\"", "", text):
        raise PredicateError("names of local variables (@) are not supported")
    names: dict[str, str] = {}

    def quoted(m: re.Match) -> str:
        names[f"_quoted_{len(names)}"] = m[1]
        return f"_quoted_{len(names) - 1}"

    try:
        tree = ast.parse(re.sub(r"`([^`]+)`", quoted, " ".join(text.split())), mode="eval")
    except SyntaxError as e:
        raise PredicateError(str(e)) from None

    def walk(n: ast.AST) -> Column:
        if isinstance(n, ast.Name):
            return F.col(f"`{names.get(n.id, n.id)}`")
        if isinstance(n, ast.Constant) and (n.value is None or isinstance(n.value, bool | int | float | str)):
            return F.lit(n.value)
        if isinstance(n, ast.BinOp) and type(n.op) in BINARY:
            return BINARY[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.BoolOp):
            return reduce(operator.and_ if isinstance(n.op, ast.And) else operator.or_, map(walk, n.values))
        if isinstance(n, ast.UnaryOp):
            v = walk(n.operand)
            return -v if isinstance(n.op, ast.USub) else v if isinstance(n.op, ast.UAdd) else ~v
        if isinstance(n, ast.Compare):
            left, parts = n.left, []
            for op, right in zip(n.ops, n.comparators, strict=True):
                if isinstance(op, ast.In | ast.NotIn) and isinstance(right, ast.List | ast.Tuple):
                    found = walk(left).isin([ast.literal_eval(x) for x in right.elts])
                    parts.append(found if isinstance(op, ast.In) else ~found)
                elif type(op) in COMPARE:
                    parts.append(COMPARE[type(op)](walk(left), walk(right)))
                else:
                    raise PredicateError(f"comparison {type(op).__name__} is not supported")
                left = right
            return reduce(operator.and_, parts)
        raise PredicateError(f"{type(n).__name__} is not supported")

    return walk(tree.body)
