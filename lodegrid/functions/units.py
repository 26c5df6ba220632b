"""Units: a small table of factors, and the algebra of products, quotients and powers.

Conversions are multiplicative only, also for temperatures. Mixing operands with and without units in
sums and comparisons is an error; products and quotients are fine.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

#: Factor to the base unit, and base dimensions.
_BASE: dict[str, tuple[float, dict[str, int]]] = {
    "m": (1.0, {"m": 1}), "meter": (1.0, {"m": 1}), "metre": (1.0, {"m": 1}), "km": (1000.0, {"m": 1}), "kilometer": (1000.0, {"m": 1}), "cm": (0.01, {"m": 1}), "mm": (0.001, {"m": 1}),
    "millimeter": (0.001, {"m": 1}), "inch": (0.0254, {"m": 1}), "in": (0.0254, {"m": 1}), "ft": (0.3048, {"m": 1}), "foot": (0.3048, {"m": 1}), "feet": (0.3048, {"m": 1}), "mile": (1609.344, {"m": 1}), "yard": (0.9144, {"m": 1}),
    "s": (1.0, {"s": 1}), "second": (1.0, {"s": 1}), "ms": (0.001, {"s": 1}), "minute": (60.0, {"s": 1}), "min": (60.0, {"s": 1}), "hour": (3600.0, {"s": 1}), "h": (3600.0, {"s": 1}), "day": (86400.0, {"s": 1}), "year": (31557600.0, {"s": 1}),
    "kg": (1.0, {"kg": 1}), "g": (0.001, {"kg": 1}), "gram": (0.001, {"kg": 1}), "tonne": (1000.0, {"kg": 1}), "lb": (0.45359237, {"kg": 1}),
    "K": (1.0, {"K": 1}), "kelvin": (1.0, {"K": 1}), "degC": (1.0, {"K": 1}), "celsius": (1.0, {"K": 1}), "degF": (5 / 9, {"K": 1}),
    "A": (1.0, {"A": 1}), "mol": (1.0, {"mol": 1}), "radian": (1.0, {}), "degree": (0.017453292519943295, {}), "percent": (0.01, {}), "dimensionless": (1.0, {}),
    "N": (1.0, {"kg": 1, "m": 1, "s": -2}), "Pa": (1.0, {"kg": 1, "m": -1, "s": -2}), "hPa": (100.0, {"kg": 1, "m": -1, "s": -2}), "bar": (1e5, {"kg": 1, "m": -1, "s": -2}),
    "J": (1.0, {"kg": 1, "m": 2, "s": -2}), "W": (1.0, {"kg": 1, "m": 2, "s": -3}), "Hz": (1.0, {"s": -1}), "L": (0.001, {"m": 3}), "liter": (0.001, {"m": 3}), "ha": (10000.0, {"m": 2}),
}


class UnitError(ValueError):
    pass


@dataclass(frozen=True)
class Unit:
    factor: float
    dims: tuple[tuple[str, Fraction], ...]

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.factor * other.factor, _sum(self.dims, other.dims, 1))

    def __truediv__(self, other: Unit) -> Unit:
        return Unit(self.factor / other.factor, _sum(self.dims, other.dims, -1))

    def __pow__(self, n: float) -> Unit:
        return Unit(self.factor**n, tuple((d, p * Fraction(n).limit_denominator(1000)) for d, p in self.dims if n))

    def factor_to(self, other: Unit) -> float:
        if self.dims != other.dims:
            raise UnitError("cannot convert between units of different dimensions")
        return self.factor / other.factor

    def __str__(self) -> str:
        body = " * ".join(d if p == 1 else f"{d} ** {p}" for d, p in self.dims) or "dimensionless"
        return body if self.factor == 1 else f"{self.factor!r} {body}"


def _sum(a: tuple, b: tuple, sign: int) -> tuple:
    out = dict(a)
    for d, p in b:
        out[d] = out.get(d, Fraction(0)) + sign * p
    return tuple(sorted((d, p) for d, p in out.items() if p))


def parse(text: str) -> Unit:
    """"m / s ** 2", "kg*m**2", "degC" ..."""
    out, sign = Unit(1.0, ()), 1
    for op, name, power in re.findall(r"([*/]?)\s*([A-Za-z]+)\s*(?:(?:\*\*|\^)\s*(-?\d+(?:\.\d+)?))?", text.replace(" per ", " / ")):
        if name not in _BASE:
            raise UnitError(f"unknown unit {name!r}")
        sign = -1 if op == "/" else 1
        factor, dims = _BASE[name]
        one = Unit(factor, tuple(sorted((d, Fraction(p)) for d, p in dims.items()))) ** (float(power) if power else 1)
        out = out * one if sign > 0 else out / one
    return out


def factor(source: str, target: str) -> float:
    return parse(source).factor_to(parse(target))


def result(op: str, a: str | None, b: str | None) -> tuple[str | None, float]:
    """The unit of ``a op b`` and the factor that b's values take first."""
    if op in ("*", "/", "@"):
        if a is None and b is None:
            return None, 1.0
        x, y = parse(a or "dimensionless"), parse(b or "dimensionless")
        made = x / y if op == "/" else x * y
        if a is not None and b is None:
            return a, 1.0
        return str(made), 1.0
    if (a is None) != (b is None):
        raise UnitError(f"cannot apply {op!r} to data with and without units")
    if a is None:
        return None, 1.0
    return (None if op in ("<", "<=", ">", ">=", "==", "!=") else a), factor(b, a)


def power(a: str | None, n: float) -> str | None:
    return None if a is None else str(parse(a) ** n)
