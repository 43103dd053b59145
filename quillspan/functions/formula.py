"""Formulas: an expression of numbers, parameters, + - * / **, max, min and abs, as a Column and as a number."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_SUMS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
_CALLS = {"max": (max, F.greatest), "min": (min, F.least), "abs": (abs, F.abs)}


def parse(text: str, params: set[str]) -> ast.expr:
    """The expression's tree; ValueError for anything else than the above or for other names than ``params``."""
    if len(text) > 500:
        raise ValueError("longer than 500 characters")
    try:
        tree = ast.parse(text.replace("^", "**"), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"no expression: {e.msg}") from None
    names = set()

    def visit(node: ast.expr) -> None:
        match node:
            case ast.Constant(value=int() | float()) if not isinstance(node.value, bool):
                pass
            case ast.Name(id=name):
                names.add(name)
            case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=inner):
                visit(inner)
            case ast.BinOp(op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div() | ast.Pow(), left=a, right=b):
                visit(a)
                visit(b)
            case ast.Call(func=ast.Name(id="max" | "min" | "abs"), args=[_, *_] as args, keywords=[]):
                for a in args:
                    visit(a)
            case _:
                raise ValueError(f"not allowed: {ast.unparse(node)}")

    visit(tree)
    if names != params:
        raise ValueError(f"parameters {sorted(params)}, names {sorted(names)}")
    return tree


def column(node: ast.expr, params: dict[str, Column]) -> Column:
    """The expression over columns of doubles."""
    match node:
        case ast.Constant(value=v):
            return F.lit(float(v))
        case ast.Name(id=name):
            return params[name]
        case ast.UnaryOp(op=op, operand=inner):
            return -column(inner, params) if isinstance(op, ast.USub) else column(inner, params)
        case ast.BinOp(op=ast.Pow(), left=a, right=b):
            return F.pow(column(a, params), column(b, params))
        case ast.BinOp(op=op, left=a, right=b):
            return _SUMS[type(op)](column(a, params), column(b, params))
        case ast.Call(func=ast.Name(id=name), args=args):
            parts = [column(a, params) for a in args]
            return _CALLS[name][1](*parts) if len(parts) > 1 or name == "abs" else parts[0]
    raise ValueError(ast.unparse(node))


def evaluate(node: ast.expr, params: dict[str, float]) -> float:
    """The expression's value, by plain Python."""
    match node:
        case ast.Constant(value=v):
            return float(v)
        case ast.Name(id=name):
            return params[name]
        case ast.UnaryOp(op=op, operand=inner):
            return -evaluate(inner, params) if isinstance(op, ast.USub) else evaluate(inner, params)
        case ast.BinOp(op=ast.Pow(), left=a, right=b):
            return evaluate(a, params) ** evaluate(b, params)
        case ast.BinOp(op=op, left=a, right=b):
            return _SUMS[type(op)](evaluate(a, params), evaluate(b, params))
        case ast.Call(func=ast.Name(id=name), args=args):
            parts = [evaluate(a, params) for a in args]
            return _CALLS[name][0](*parts) if len(parts) > 1 or name == "abs" else parts[0]
    raise ValueError(ast.unparse(node))
