"""Arithmetic on columns from an expression text, by a whitelist over Python's grammar (never ``eval``).

The functions are numexpr's. Everything is a double; comparisons and logic give 1 and 0 (missing if an
operand is missing), and any number but 0 is true. Division follows IEEE but for 0/0, which is missing.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def divide(a: Column, b: Column) -> Column:
    by_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).otherwise(F.lit(None).cast("double"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def floor_divide(a: Column, b: Column) -> Column:
    q = divide(a, b)
    return F.when(F.abs(q) == INF, q).otherwise(_whole(F.floor, q))


def modulo(a: Column, b: Column) -> Column:
    """With the divisor's sign; by zero it is missing."""
    return F.when(b == 0, None).otherwise(a - b * _whole(F.floor, F.try_divide(a, b)))


def _whole(f: Callable[[Column], Column], v: Column) -> Column:
    big = F.abs(v) >= F.lit(9.0e18)
    return F.when(big, v).otherwise(f(F.when(big, None).otherwise(v)).cast("double"))


def _nan(v: Column) -> Column:
    return F.when(F.isnan(v), None).otherwise(v)


#: numexpr's function names and their columns.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "where": lambda c, a, b: F.when(c != 0, a).when(c == 0, b),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": lambda x: _nan(F.asin(x)),
    "arccos": lambda x: _nan(F.acos(x)),
    "arctan": F.atan,
    "arctan2": F.atan2,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "arcsinh": F.asinh,
    "arccosh": lambda x: _nan(F.acosh(x)),
    "arctanh": lambda x: _nan(F.atanh(x)),
    "log": lambda x: F.when(x == 0, -INF).otherwise(F.ln(x)),
    "log10": lambda x: F.when(x == 0, -INF).otherwise(F.log10(x)),
    "log1p": lambda x: F.when(x == -1, -INF).otherwise(F.log1p(x)),
    "exp": F.exp,
    "expm1": F.expm1,
    "sqrt": lambda x: _nan(F.sqrt(x)),
    "abs": F.abs,
    "floor": lambda x: _whole(F.floor, x),
    "ceil": lambda x: _whole(F.ceil, x),
    "real": lambda x: x,
    "conj": lambda x: x,
    "imag": lambda x: x * 0.0,
    "minimum": F.least,
    "maximum": F.greatest,
}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: divide, ast.FloorDiv: floor_divide, ast.Mod: modulo, ast.Pow: lambda a, b: _nan(F.pow(a, b))}
_BITS = {ast.BitAnd: lambda a, b: (a != 0) & (b != 0), ast.BitOr: lambda a, b: (a != 0) | (b != 0), ast.BitXor: lambda a, b: (a != 0) != (b != 0)}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


class ExpressionError(ValueError):
    pass


def names(text: str) -> set[str]:
    """The input names that an expression uses."""
    tree = ast.parse(text, mode="eval")
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - called - {"pi", "e"}


def column(text: str, inputs: dict[str, Column]) -> Column:
    """The expression over named columns."""
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as bad:
        raise ExpressionError(f"cannot read {text!r}") from bad

    def walk(n: ast.AST) -> Column:
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            if n.id in inputs:
                return inputs[n.id]
            if n.id in ("pi", "e"):
                return F.pi() if n.id == "pi" else F.e()
            raise ExpressionError(f"unknown name {n.id!r} in {text!r}")
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            if type(n.op) in _BINARY:
                return _BINARY[type(n.op)](a, b)
            if type(n.op) in _BITS:
                return _BITS[type(n.op)](a, b).cast("double")
        if isinstance(n, ast.UnaryOp):
            v = walk(n.operand)
            if isinstance(n.op, ast.USub):
                return -v
            if isinstance(n.op, ast.UAdd):
                return v
            if isinstance(n.op, (ast.Invert, ast.Not)):
                return (v == 0).cast("double")
        if isinstance(n, ast.BoolOp):
            parts = [walk(v) != 0 for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(n.op, ast.And) else out | p
            return out.cast("double")
        if isinstance(n, ast.Compare):
            left, out = walk(n.left), None
            for op, right in zip(n.ops, n.comparators, strict=True):
                if type(op) not in _COMPARE:
                    break
                b = walk(right)
                one = _COMPARE[type(op)](left, b)
                out, left = one if out is None else out & one, b
            else:
                return out.cast("double")
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and not n.keywords:
            return FUNCTIONS[n.func.id](*(walk(a) for a in n.args))
        raise ExpressionError(f"{ast.unparse(n)!r} is not allowed in {text!r}")

    return walk(tree)
