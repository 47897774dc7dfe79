"""Arithmetic expressions as columns: a fixed grammar is read into a tree and built from Spark's own functions. No text reaches Spark's
or Python's evaluation.

    sum     := product (("+" | "-") product)*
    product := signed (("*" | "/" | "//" | "%") signed)*
    signed  := ("+" | "-") signed | power
    power   := atom ("**" signed)?
    atom    := number | name | name "(" sum ("," sum)* ")" | "(" sum ")"
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSTANTS = {"pi": math.pi, "e": math.e}
_TOKEN = re.compile(r"\s*(?:([0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)|([A-Za-z_][A-Za-z0-9_]*)|(\*\*|//|[-+*/%(),]))")
#: Nesting that is read at most.
DEPTH = 100


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Value:
    """A number, anything where there is none, and the faults that tell where: conditions with their reasons, from the left."""

    number: Column
    faults: tuple[tuple[Column, str], ...] = ()


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _made(number: Callable[..., Column], *checks: tuple[Callable[..., Column], str]) -> Callable[..., Value]:
    """number() of the operands' numbers, with their faults and its own; it must not raise, whatever it is given."""

    def apply(*of: Value) -> Value:
        x = [v.number for v in of]
        own = tuple((bad(*x), why) for bad, why in checks)
        return Value(number(*x), sum((v.faults for v in of), ()) + own)

    return apply


def _endless(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def _down(x: Column) -> Column:
    """The largest whole number that is not above x, as a double; from 2 ** 53 on all doubles are whole."""
    return _once(x, lambda v: F.when((F.abs(v) >= 2.0**53) | F.isnan(v), v).otherwise(F.floor(v).cast("double")))


def _modulo(a: Column, b: Column) -> Column:
    """The sign follows the divisor."""
    return _once(F.struct(a.alias("a"), b.alias("b")), lambda v: v["a"] - v["b"] * _down(F.try_divide(v["a"], v["b"])))


def _whole(x: Column) -> Column:
    return _once(x, lambda v: (v >= 0) & (_down(v) == v))


def _factorial(x: Column) -> Column:
    """As a double, of 0 to 170."""
    upto = lambda v: F.sequence(F.lit(1), F.greatest(F.lit(1), v.cast("int")))
    return _once(x, lambda v: F.when((v >= 0) & (v <= 170), F.aggregate(upto(v), F.lit(1.0), lambda out, k: out * k)))


_ZERO, _LARGE, _NOT_POSITIVE, _BEYOND_ONE = "division by zero", "too large", "not above zero", "not within -1 and 1"
_POWER = _made(F.pow, (lambda a, b: (a == 0) & (b < 0), _ZERO), (lambda a, b: (a < 0) & (_down(b) != b), "not a real number"), (lambda a, b: _endless(F.pow(a, b)), _LARGE))
_DIVIDE = _made(F.try_divide, (lambda a, b: b == 0, _ZERO))
_LN = _made(F.ln, (lambda x: x <= 0, _NOT_POSITIVE))
#: By name: how many arguments at least and at most, and the function.
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Value]]] = {
    "abs": (1, 1, _made(F.abs)),
    "round": (1, 1, _made(F.rint)),
    "min": (2, 99, _made(F.least)),
    "max": (2, 99, _made(F.greatest)),
    "sum": (1, 99, _made(lambda *x: sum(x[1:], x[0]))),
    "pow": (2, 2, _POWER),
    "sqrt": (1, 1, _made(F.sqrt, (lambda x: x < 0, "below zero"))),
    "sin": (1, 1, _made(F.sin)),
    "cos": (1, 1, _made(F.cos)),
    "tan": (1, 1, _made(F.tan)),
    "asin": (1, 1, _made(F.asin, (lambda x: F.abs(x) > 1, _BEYOND_ONE))),
    "acos": (1, 1, _made(F.acos, (lambda x: F.abs(x) > 1, _BEYOND_ONE))),
    "atan": (1, 1, _made(F.atan)),
    "log": (1, 2, lambda x, base=None: _LN(x) if base is None else _DIVIDE(_LN(x), _LN(base))),
    "log10": (1, 1, _made(F.log10, (lambda x: x <= 0, _NOT_POSITIVE))),
    "exp": (1, 1, _made(F.exp, (lambda x: _endless(F.exp(x)), _LARGE))),
    "floor": (1, 1, _made(_down)),
    "ceil": (1, 1, _made(lambda x: -_down(-x))),
    "factorial": (1, 1, _made(_factorial, (lambda x: ~_whole(x), "not a whole number from 0 on"), (lambda x: x > 170, _LARGE))),
}
_OPERATORS: dict[str, Callable[[Value, Value], Value]] = {
    "+": _made(lambda a, b: a + b),
    "-": _made(lambda a, b: a - b),
    "*": _made(lambda a, b: a * b),
    "/": _DIVIDE,
    "//": _made(lambda a, b: _down(F.try_divide(a, b)), (lambda a, b: b == 0, _ZERO)),
    "%": _made(_modulo, (lambda a, b: b == 0, _ZERO)),
    "**": _POWER,
}


class _Reader:
    """Reads tokens from the left; `names` are the columns that an expression may use."""

    def __init__(self, text: str, names: Mapping[str, Column]):
        self.names, self.tokens, at = names, [], 0
        text = text.rstrip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise ExpressionError(f"no expression at {at}: {text[at : at + 20]}")
            self.tokens.append((("number", "name", "sign")[found.lastindex - 1], found.group(found.lastindex)))
            at = found.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def take(self, *signs: str) -> str | None:
        kind, text = self.tokens[self.at]
        if kind == "sign" and text in signs:
            self.at += 1
            return text
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ExpressionError(f"{sign} expected, not {self.tokens[self.at][1] or 'the end'}")

    def chain(self, signs: tuple[str, ...], operand: Callable[[int], Value], depth: int) -> Value:
        out = operand(depth)
        while sign := self.take(*signs):
            out = _OPERATORS[sign](out, operand(depth))
        return out

    def sum(self, depth: int) -> Value:
        if depth > DEPTH:
            raise ExpressionError("nested too deeply")
        return self.chain(("+", "-"), self.product, depth)

    def product(self, depth: int) -> Value:
        return self.chain(("*", "/", "//", "%"), self.signed, depth)

    def signed(self, depth: int) -> Value:
        if depth > DEPTH:
            raise ExpressionError("nested too deeply")
        if sign := self.take("+", "-"):
            of = self.signed(depth + 1)
            return of if sign == "+" else _made(lambda x: -x)(of)
        base = self.atom(depth)
        return _POWER(base, self.signed(depth + 1)) if self.take("**") else base

    def atom(self, depth: int) -> Value:
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Value(F.lit(float(text)))
        if kind == "sign" and text == "(":
            inside = self.sum(depth + 1)
            self.need(")")
            return inside
        if kind != "name":
            raise ExpressionError(f"a number, a name or a bracket expected, not {text or 'the end'}")
        if self.take("("):
            return self.call(text, depth)
        if text in self.names:
            given = self.names[text].cast("double")
            return Value(given, ((given.isNull(), f"{text} is null"),))
        if text in CONSTANTS:
            return Value(F.lit(CONSTANTS[text]))
        raise ExpressionError(f"unknown name: {text}")

    def call(self, name: str, depth: int) -> Value:
        if name not in FUNCTIONS:
            raise ExpressionError(f"unknown function: {name}")
        given = [self.sum(depth + 1)]
        while self.take(","):
            given.append(self.sum(depth + 1))
        self.need(")")
        least, most, build = FUNCTIONS[name]
        if not least <= len(given) <= most:
            raise ExpressionError(f"{name} takes {least if least == most else f'{least} to {most}'} arguments, not {len(given)}")
        return build(*given)


def compiled(text: str, names: Mapping[str, Column] | None = None) -> Column:
    """struct(result, fault) of an expression over the named columns, all as doubles.

    A row for which there is no real, finite number has a null result and the reason; what is no expression at all raises
    ExpressionError before any row is read. // and % round down as their divisor's sign says, round goes to the even neighbour."""
    reader = _Reader(text, names or {})
    out = reader.sum(0)
    if reader.tokens[reader.at][0] != "end":
        raise ExpressionError(f"the end expected, not {reader.tokens[reader.at][1]}")
    faults = [F.when(bad, F.lit(why)) for bad, why in (*out.faults, (_endless(out.number), _LARGE))]
    fault = F.coalesce(*faults)
    return F.struct(F.when(fault.isNull(), out.number).alias("result"), fault.alias("fault"))
