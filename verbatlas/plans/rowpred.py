"""A small language of row predicates, compiled to Column expressions.

`{{ name }}` stands for the row's cell, as text; unknown columns and nulls are empty text. Literals of
Python, tuples and lists of literals, `not`, `and`, `or`, and chains of `== != < <= > >= in not in` are
allowed, nothing else. Cells are text: they are ordered by code points, and ordering text against a number
is an error when the predicate is compiled, not when a row is read.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_CELL = re.compile(r"\{\{\s*([^}]+?)\s*\}\}")
_ORDER = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


class PredicateError(ValueError):
    """The expression is outside the language."""


class _Value:
    """A cell (column), a constant (value), or a list of those."""

    def __init__(self, column: Column | None = None, value: object = None, items: list[_Value] | None = None):
        self.column, self.value, self.items = column, value, items

    @property
    def kind(self) -> str:
        if self.items is not None:
            return "list"
        if self.column is not None or isinstance(self.value, str):
            return "text"
        return "bool" if isinstance(self.value, bool) else "none" if self.value is None else "number"

    def as_column(self) -> Column:
        return self.column if self.column is not None else F.lit(self.value)

    def truth(self) -> Column:
        if self.items is not None:
            return F.lit(bool(self.items))
        return self.column != "" if self.column is not None else F.lit(bool(self.value))


def compile_predicate(expression: str, columns: Sequence[str]) -> Column:
    """A boolean Column of the expression, for a table with these columns."""
    names: list[str] = []

    def cell(m: re.Match) -> str:
        names.append(m[1])
        return f"_cell_{len(names) - 1}_"

    try:
        tree = ast.parse(_CELL.sub(cell, expression).strip(), mode="eval")
    except SyntaxError as e:
        raise PredicateError(f"cannot be read: {e.msg}") from None
    return _Compiler(names, columns).truth(tree.body)


class _Compiler:
    def __init__(self, names: list[str], columns: Sequence[str]):
        self.names, self.columns = names, set(columns)

    def truth(self, node: ast.expr) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [self.truth(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.truth(node.operand)
        if isinstance(node, ast.Compare):
            out = None
            left = self.value(node.left)
            for op, right_node in zip(node.ops, node.comparators, strict=True):
                right = self.value(right_node)
                one = self.compare(left, op, right)
                out = one if out is None else out & one
                left = right
            return out
        return self.value(node).truth()

    def value(self, node: ast.expr) -> _Value:
        if isinstance(node, ast.Constant) and (node.value is None or isinstance(node.value, (str, bool, int, float))):
            return _Value(value=node.value)
        if isinstance(node, ast.Name) and (m := re.fullmatch(r"_cell_(\d+)_", node.id)):
            name = self.names[int(m[1])]
            known = name in self.columns
            return _Value(column=F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if known else F.lit(""))
        if isinstance(node, (ast.Tuple, ast.List, ast.Set)):
            return _Value(items=[self.value(x) for x in node.elts])
        if isinstance(node, (ast.Compare, ast.BoolOp, ast.UnaryOp)):
            raise PredicateError("a comparison cannot be compared")
        raise PredicateError(f"{type(node).__name__} is not allowed")

    def same(self, a: _Value, b: _Value) -> Column:
        if a.kind == "list" and b.kind == "list":
            if len(a.items) != len(b.items):
                return F.lit(False)
            out = F.lit(True)
            for x, y in zip(a.items, b.items, strict=True):
                out = out & self.same(x, y)
            return out
        if a.kind == b.kind == "text":
            return a.as_column() == b.as_column()
        if a.column is None and b.column is None and "list" not in (a.kind, b.kind):
            return F.lit(a.value == b.value)
        return F.lit(False)  # text is never equal to a number or a list

    def compare(self, a: _Value, op: ast.cmpop, b: _Value) -> Column:
        if isinstance(op, ast.Eq):
            return self.same(a, b)
        if isinstance(op, ast.NotEq):
            return ~self.same(a, b)
        if isinstance(op, (ast.In, ast.NotIn)):
            if b.kind == "list":
                out = F.lit(False)
                for x in b.items:
                    out = out | self.same(a, x)
            elif b.kind == "text" and a.kind == "text":
                out = F.contains(b.as_column(), a.as_column())
            else:
                raise PredicateError("in needs a list, or text in text")
            return ~out if isinstance(op, ast.NotIn) else out
        sign = _ORDER.get(type(op))
        if sign is None:
            raise PredicateError(f"{type(op).__name__} is not allowed")
        if a.kind != b.kind or a.kind not in ("text", "number", "bool"):
            raise PredicateError(f"{a.kind} and {b.kind} have no order")
        x, y = a.as_column(), b.as_column()
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]
