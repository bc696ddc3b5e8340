"""Functions of PDF files: PostScript calculator programs, samples, powers and stitched functions."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"%[^\r\n]*|[{}]|[^\s{}%]+")


class ProgramError(ValueError):
    """A program that cannot be read or run."""


def parse_program(text: str) -> list:
    """A program's instructions: numbers, names, and lists for procedures."""
    stack: list[list] = [[]]
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token.startswith("%"):
            continue
        if token == "{":
            stack.append([])
        elif token == "}":
            if len(stack) < 2:
                raise ProgramError("a brace is closed that was not opened")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(_literal(token))
    if len(stack) != 1:
        raise ProgramError("a brace is not closed")
    top = stack[0]
    return top[0] if len(top) == 1 and isinstance(top[0], list) else top


def _literal(token: str) -> Any:
    try:
        return int(token)
    except ValueError:
        pass
    try:
        return float(token)
    except ValueError:
        return token


def _whole(x: float, like: Any) -> Any:
    return int(x) if isinstance(like, int) else float(x)


def _either(whole: Callable, truth: Callable) -> Callable:
    return lambda a, b: truth(a, b) if isinstance(a, bool) and isinstance(b, bool) else whole(int(a), int(b))


def _divide(a: Any, b: Any) -> int:
    if not b:
        raise ProgramError("division by zero")
    return int(abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)


def _power(a: Any, b: Any) -> float:
    value = float(a) ** b
    if isinstance(value, complex):
        raise ProgramError("a root of less than zero")
    return value


_ONE: dict[str, Callable[[Any], Any]] = {
    "abs": abs, "neg": lambda a: -a, "ceiling": lambda a: _whole(math.ceil(a), a), "floor": lambda a: _whole(math.floor(a), a), "round": lambda a: _whole(math.floor(a + 0.5), a),
    "truncate": lambda a: _whole(math.trunc(a), a), "sqrt": lambda a: math.sqrt(a), "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)),
    "ln": lambda a: math.log(a), "log": lambda a: math.log10(a), "cvi": lambda a: math.trunc(a), "cvr": float, "not": lambda a: not a if isinstance(a, bool) else ~a,
}
_TWO: dict[str, Callable[[Any, Any], Any]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else math.copysign(math.inf, a) if a else math.nan,
    "idiv": _divide, "mod": lambda a, b: a - b * _divide(a, b), "exp": _power, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360,
    "bitshift": lambda a, b: a << b if b >= 0 else a >> -b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "and": _either(lambda a, b: a & b, lambda a, b: a and b), "or": _either(lambda a, b: a | b, lambda a, b: a or b),
    "xor": _either(lambda a, b: a ^ b, lambda a, b: a != b),
}


def run_program(program: list, stack: list) -> list:
    """Run instructions on a stack, in place."""
    for at, token in enumerate(program):
        if not isinstance(token, str):
            stack.append(token)
            continue
        try:
            if token in _ONE:
                stack.append(_ONE[token](stack.pop()))
            elif token in _TWO:
                b, a = stack.pop(), stack.pop()
                stack.append(_TWO[token](a, b))
            elif token in ("true", "false"):
                stack.append(token == "true")
            elif token == "if":
                then, condition = stack.pop(), stack.pop()
                if condition:
                    run_program(then, stack)
            elif token == "ifelse":
                other, then, condition = stack.pop(), stack.pop(), stack.pop()
                run_program(then if condition else other, stack)
            elif token == "pop":
                stack.pop()
            elif token == "dup":
                stack.append(stack[-1])
            elif token == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif token == "copy":
                if n := stack.pop():
                    if n < 0 or n > len(stack):
                        raise IndexError
                    stack.extend(stack[-n:])
            elif token == "index":
                n = stack.pop()
                if n < 0:
                    raise IndexError
                stack.append(stack[-1 - n])
            elif token == "roll":
                j, n = stack.pop(), stack.pop()
                if n < 0 or n > len(stack):
                    raise IndexError
                if n:
                    part = stack[-n:]
                    j %= n
                    stack[-n:] = part[n - j :] + part[: n - j]
            else:
                raise ProgramError(f"unknown operator {token}")
        except (IndexError, TypeError, ValueError, ZeroDivisionError) as problem:
            raise ProgramError(f"{token} at {at}: {problem}") from None
    return stack


def _clip(values: Sequence[float], ranges: Sequence[float] | None) -> list[float]:
    return list(values) if ranges is None else [min(max(v, ranges[2 * i]), ranges[2 * i + 1]) for i, v in enumerate(values)]


def _between(x: float, x0: float, x1: float, y0: float, y1: float) -> float:
    return y0 if x1 == x0 else y0 + (x - x0) * (y1 - y0) / (x1 - x0)


def calculator(text: str, domain: Sequence[float], ranges: Sequence[float]) -> Callable[..., list[float]]:
    """Type 4: a program from its arguments to as many results as ``ranges`` has pairs."""
    program = parse_program(text)

    def function(*args: float) -> list[float]:
        stack = run_program(program, _clip(args, domain))
        count = len(ranges) // 2
        if len(stack) < count:
            raise ProgramError("the program gives too little")
        return _clip([float(v) for v in stack[len(stack) - count :]], ranges)

    return function


def exponential(c0: Sequence[float], c1: Sequence[float], n: float, domain: Sequence[float] = (0.0, 1.0)) -> Callable[[float], list[float]]:
    """Type 2."""
    return lambda x: [a + _clip([x], domain)[0] ** n * (b - a) for a, b in zip(c0, c1)]


def stitching(functions: Sequence[Callable], bounds: Sequence[float], encode: Sequence[float], domain: Sequence[float]) -> Callable[[float], list[float]]:
    """Type 3: one function for each part of the domain."""

    def function(x: float) -> list[float]:
        x = _clip([x], domain)[0]
        k = next((i for i, b in enumerate(bounds) if x < b), len(functions) - 1)
        edges = [domain[0], *bounds, domain[1]]
        return functions[k](_between(x, edges[k], edges[k + 1], encode[2 * k], encode[2 * k + 1]))

    return function


def sampled(samples: np.ndarray, domain: Sequence[float], ranges: Sequence[float], bits: int = 8, encode: Sequence[float] | None = None, decode: Sequence[float] | None = None) -> Callable[..., list[float]]:
    """Type 0: samples on a grid, with straight lines between. ``samples`` has an axis for each argument, and one of results."""
    sizes = samples.shape[:-1]
    encode = encode or [v for s in sizes for v in (0, s - 1)]
    decode = decode or ranges
    top = 2**bits - 1

    def function(*args: float) -> list[float]:
        places = []
        for i, x in enumerate(_clip(args, domain)):
            e = _between(x, domain[2 * i], domain[2 * i + 1], encode[2 * i], encode[2 * i + 1])
            places.append(min(max(e, 0.0), sizes[i] - 1.0))
        low = [min(int(p), s - 2) if s > 1 else 0 for p, s in zip(places, sizes)]
        out = np.zeros(samples.shape[-1])
        for corner in itertools.product((0, 1), repeat=len(sizes)):
            weight = math.prod((p - a) if c else 1 - (p - a) for p, a, c in zip(places, low, corner))
            if weight:
                out += weight * samples[tuple(a + c for a, c in zip(low, corner))]
        return _clip([_between(v, 0, top, decode[2 * j], decode[2 * j + 1]) for j, v in enumerate(out)], ranges)

    return function


def applied(function: Callable[..., list[float]], *columns: Column) -> Column:
    """A column of the function's results; null where an argument is null or the function fails."""

    @F.pandas_udf("array<double>")
    def run(*args: pd.Series) -> pd.Series:
        def one(row: tuple) -> list[float] | None:
            if any(v is None or v != v for v in row):
                return None
            try:
                return function(*row)
            except ProgramError:
                return None

        return pd.Series([one(row) for row in zip(*args)], dtype=object)

    return run(*[c.cast("double") for c in columns])


def exponential_column(x: Column, c0: float, c1: float, n: float) -> Column:
    """Type 2 by built-in functions."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.lit(c0) + F.pow(t, F.lit(n)) * F.lit(c1 - c0)


# as columns -------------------------------------------------------------------

_REAL, _WHOLE_KIND, _TRUTH = "real", "whole", "truth"


class _Item:
    """A value on the stack of a program that is being compiled: a column, or a number that is known already."""

    def __init__(self, kind: str, column: Column, constant: Any = None):
        self.kind, self.column, self.constant = kind, column, constant


def _known_item(value: Any) -> _Item:
    kind = _TRUTH if isinstance(value, bool) else _WHOLE_KIND if isinstance(value, int) else _REAL
    return _Item(kind, F.lit(value).cast({_TRUTH: "boolean", _WHOLE_KIND: "bigint", _REAL: "double"}[kind]), value)


def _same_kind(a: _Item, c: Column) -> _Item:
    return _Item(a.kind, c.cast("bigint") if a.kind == _WHOLE_KIND else c.cast("double"))


def _quotient(a: Column, b: Column) -> Column:
    """Whole division towards zero; null by zero, as a program fails there."""
    a, b = a.cast("double"), b.cast("double")
    q = F.floor(F.abs(a) / F.abs(F.when(b != 0, b)))
    return F.when((a < 0) == (b < 0), q).otherwise(-q).cast("bigint")


_ONE_COLUMN: dict[str, Callable[[_Item], _Item]] = {
    "abs": lambda a: _same_kind(a, F.abs(a.column)), "neg": lambda a: _same_kind(a, -a.column), "ceiling": lambda a: _same_kind(a, F.ceil(a.column)), "floor": lambda a: _same_kind(a, F.floor(a.column)),
    "round": lambda a: _same_kind(a, F.floor(a.column + 0.5)), "truncate": lambda a: _same_kind(a, F.when(a.column < 0, F.ceil(a.column)).otherwise(F.floor(a.column))),
    "sqrt": lambda a: _Item(_REAL, F.sqrt(F.when(a.column >= 0, a.column))), "sin": lambda a: _Item(_REAL, F.sin(F.radians(a.column))), "cos": lambda a: _Item(_REAL, F.cos(F.radians(a.column))),
    "ln": lambda a: _Item(_REAL, F.log(a.column)), "log": lambda a: _Item(_REAL, F.log10(a.column)), "cvi": lambda a: _Item(_WHOLE_KIND, a.column.cast("bigint")), "cvr": lambda a: _Item(_REAL, a.column.cast("double")),
    "not": lambda a: _Item(_TRUTH, ~a.column) if a.kind == _TRUTH else _Item(_WHOLE_KIND, F.bitwise_not(a.column)),
}


def _numeric(a: _Item, b: _Item, c: Column) -> _Item:
    return _Item(_WHOLE_KIND, c.cast("bigint")) if a.kind == b.kind == _WHOLE_KIND else _Item(_REAL, c.cast("double"))


def _bits(a: _Item, b: _Item, whole: Callable[[Column, Column], Column], truth: Callable[[Column, Column], Column]) -> _Item:
    return _Item(_TRUTH, truth(a.column, b.column)) if a.kind == b.kind == _TRUTH else _Item(_WHOLE_KIND, whole(a.column.cast("bigint"), b.column.cast("bigint")))


def _shifted(a: _Item, b: _Item) -> _Item:
    if b.constant is None:
        raise ProgramError("a shift that is not known beforehand")
    return _Item(_WHOLE_KIND, F.shiftleft(a.column, b.constant) if b.constant >= 0 else F.shiftright(a.column, -b.constant))


_TWO_COLUMNS: dict[str, Callable[[_Item, _Item], _Item]] = {
    "add": lambda a, b: _numeric(a, b, a.column + b.column), "sub": lambda a, b: _numeric(a, b, a.column - b.column), "mul": lambda a, b: _numeric(a, b, a.column * b.column),
    "div": lambda a, b: _Item(_REAL, F.when(b.column != 0, a.column / F.when(b.column != 0, b.column)).when(a.column > 0, F.lit(math.inf)).when(a.column < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))),
    "idiv": lambda a, b: _Item(_WHOLE_KIND, _quotient(a.column, b.column)), "mod": lambda a, b: _numeric(a, b, a.column - b.column * _quotient(a.column, b.column)),
    "exp": lambda a, b: _Item(_REAL, F.pow(a.column, b.column)), "atan": lambda a, b: _Item(_REAL, F.pmod(F.degrees(F.atan2(a.column, b.column)), F.lit(360.0))), "bitshift": _shifted,
    "eq": lambda a, b: _Item(_TRUTH, a.column == b.column), "ne": lambda a, b: _Item(_TRUTH, a.column != b.column), "gt": lambda a, b: _Item(_TRUTH, a.column > b.column), "ge": lambda a, b: _Item(_TRUTH, a.column >= b.column),
    "lt": lambda a, b: _Item(_TRUTH, a.column < b.column), "le": lambda a, b: _Item(_TRUTH, a.column <= b.column),
    "and": lambda a, b: _bits(a, b, lambda x, y: x.bitwiseAND(y), lambda x, y: x & y), "or": lambda a, b: _bits(a, b, lambda x, y: x.bitwiseOR(y), lambda x, y: x | y),
    "xor": lambda a, b: _bits(a, b, lambda x, y: x.bitwiseXOR(y), lambda x, y: x != y),
}


def _compile(program: list, stack: list[_Item]) -> list[_Item]:
    """The stack that a program leaves, its values as columns. Both ways of a condition must leave as many values."""

    def count() -> int:
        n = stack.pop().constant
        if not isinstance(n, int):
            raise ProgramError("a count that is not known beforehand")
        return n

    for token in program:
        if not isinstance(token, str):
            stack.append(token if isinstance(token, list) else _known_item(token))
        elif token in _ONE_COLUMN:
            a = stack.pop()
            stack.append(_known_item(_ONE[token](a.constant)) if a.constant is not None else _ONE_COLUMN[token](a))
        elif token in _TWO_COLUMNS:
            b, a = stack.pop(), stack.pop()
            stack.append(_TWO_COLUMNS[token](a, b))
        elif token in ("true", "false"):
            stack.append(_known_item(token == "true"))
        elif token in ("if", "ifelse"):
            other = stack.pop() if token == "ifelse" else []
            then, condition = stack.pop(), stack.pop()
            yes, no = _compile(then, list(stack)), _compile(other, list(stack))
            if len(yes) != len(no):
                raise ProgramError("the ways of a condition leave different numbers of values")
            joined = []
            for a, b in zip(yes, no):
                kind = a.kind if a.kind == b.kind else _REAL
                joined.append(a if a is b else _Item(kind, F.when(condition.column, a.column).when(~condition.column, b.column)))
            stack[:] = joined
        elif token == "pop":
            stack.pop()
        elif token == "dup":
            stack.append(stack[-1])
        elif token == "exch":
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif token == "copy":
            if n := count():
                stack.extend(stack[-n:])
        elif token == "index":
            n = count()
            stack.append(stack[-1 - n])
        elif token == "roll":
            j, n = count(), count()
            if n:
                part, j = stack[-n:], j % n
                stack[-n:] = part[n - j :] + part[: n - j]
        else:
            raise ProgramError(f"unknown operator {token}")
    return stack


def _clipped(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, F.lit(float(low))).when(c > high, F.lit(float(high))).otherwise(c)


def calculator_columns(text: str, domain: Sequence[float], ranges: Sequence[float], *columns: Column) -> list[Column]:
    """Type 4 by built-in functions: the program is known when the query is planned, so it becomes an expression.

    A null argument gives nulls, and so does what the program fails for, a root
    of less than zero or a whole division by zero. A program whose counts or
    whose number of results depend on its arguments cannot be compiled and
    raises `ProgramError`; `applied` runs any program.
    """
    stack = [_Item(_REAL, _clipped(c.cast("double"), domain[2 * i], domain[2 * i + 1])) for i, c in enumerate(columns)]
    try:
        left = _compile(parse_program(text), stack)
    except IndexError:
        raise ProgramError("the program takes more than it has") from None
    n = len(ranges) // 2
    if len(left) < n:
        raise ProgramError("the program gives too little")
    return [_clipped(item.column.cast("double"), ranges[2 * i], ranges[2 * i + 1]) for i, item in enumerate(left[len(left) - n :])]


def stitched_column(x: Column, functions: Sequence[Callable[[Column], Column]], bounds: Sequence[float], encode: Sequence[float], domain: Sequence[float]) -> Column:
    """Type 3 by built-in functions, of functions on columns."""
    x = _clipped(x, domain[0], domain[1])
    edges, out = [domain[0], *bounds, domain[1]], None
    for k in reversed(range(len(functions))):
        low, high = edges[k], edges[k + 1]
        inner = F.lit(float(encode[2 * k])) if low == high else F.lit(float(encode[2 * k])) + (x - low) * float(encode[2 * k + 1] - encode[2 * k]) / (high - low)
        value = functions[k](inner)
        out = value if out is None else F.when(x < edges[k + 1], value).otherwise(out)
    return out


def sampled_column(x: Column, samples: Sequence[float], domain: Sequence[float], ranges: Sequence[float], bits: int = 8) -> Column:
    """Type 0 of one argument and one result by built-in functions."""
    last = len(samples) - 1
    place = _clipped((_clipped(x, domain[0], domain[1]) - domain[0]) * float(last) / (domain[1] - domain[0]), 0.0, float(last))
    low = F.least(F.floor(place), F.lit(max(last - 1, 0))).cast("int")
    table = F.array(*(F.lit(float(v)) for v in samples))
    value = table[low] + (place - low) * (table[F.least(low + 1, F.lit(last))] - table[low])
    return _clipped(F.lit(float(ranges[0])) + value * float(ranges[1] - ranges[0]) / (2**bits - 1), ranges[0], ranges[1])
