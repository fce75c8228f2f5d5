"""Expressions of derived columns: a small arithmetic and logic language, translated to SQL.

The text is parsed with Python's own grammar and only what is listed here is let through: column names (in backticks if
they are not identifiers), numbers, strings, ``+ - * / // % **``, comparisons (chains too), ``and or not & | ~``,
parentheses and a list of functions. Everything else is a ``ValueError``; nothing is evaluated in Python.
"""

from __future__ import annotations

import ast
import re

FUNCTIONS = {"abs": "abs", "sqrt": "sqrt", "log": "ln", "log10": "log10", "exp": "exp", "sin": "sin", "cos": "cos", "tan": "tan", "floor": "floor", "ceil": "ceil"}
ARITHMETIC = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}
COMPARISON = {ast.Eq: "=", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def translate(expression: str, columns: list[str]) -> str:
    """SQL for an expression over ``columns``."""
    names: dict[str, str] = {}

    def stand_in(match: re.Match) -> str:
        key = f"_column_{len(names)}"
        names[key] = match[1]
        return key

    text = re.sub(r"`([^`]+)`", stand_in, expression.strip())
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {expression!r}") from e

    def sql(node: ast.expr) -> str:
        match node:
            case ast.Name(id=key):
                name = names.get(key, key)
                if name not in columns:
                    raise ValueError(f"unknown column {name!r} in {expression!r}")
                return _quote(name)
            case ast.Constant(value=bool(v)):
                return "true" if v else "false"
            case ast.Constant(value=int() | float() as v):
                return repr(v) if isinstance(v, int) else f"{v!r}D"
            case ast.Constant(value=str(v)):
                return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
            case ast.BinOp(left=a, op=ast.Add(), right=b) if any(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in (a, b)):
                return f"concat({sql(a)}, {sql(b)})"
            case ast.BinOp(left=a, op=op, right=b) if type(op) in ARITHMETIC:
                return f"({sql(a)} {ARITHMETIC[type(op)]} {sql(b)})"
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return f"try_divide({sql(a)}, {sql(b)})"
            case ast.BinOp(left=a, op=ast.FloorDiv(), right=b):
                return f"floor(try_divide({sql(a)}, {sql(b)}))"
            case ast.BinOp(left=a, op=ast.Mod(), right=b):
                return f"pmod({sql(a)}, nullif({sql(b)}, 0))"
            case ast.BinOp(left=a, op=ast.Pow(), right=b):
                return f"pow({sql(a)}, {sql(b)})"
            case ast.BinOp(left=a, op=ast.BitAnd(), right=b):
                return f"({sql(a)} AND {sql(b)})"
            case ast.BinOp(left=a, op=ast.BitOr(), right=b):
                return f"({sql(a)} OR {sql(b)})"
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return f"(-{sql(a)})"
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return sql(a)
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=a):
                return f"(NOT {sql(a)})"
            case ast.BoolOp(op=op, values=values):
                return "(" + (" AND " if isinstance(op, ast.And) else " OR ").join(map(sql, values)) + ")"
            case ast.Compare(left=a, ops=ops, comparators=others) if all(type(o) in COMPARISON for o in ops):
                sides = [a, *others]
                parts = [f"{sql(x)} {COMPARISON[type(o)]} {sql(y)}" for x, o, y in zip(sides, ops, sides[1:])]
                return "(" + " AND ".join(parts) + ")"
            case ast.Call(func=ast.Name(id=fn), args=args, keywords=[]) if fn in FUNCTIONS and len(args) == 1:
                return f"{FUNCTIONS[fn]}({sql(args[0])})"
        raise ValueError(f"not allowed in a derived column: {ast.unparse(node)!r}")

    return sql(tree)
