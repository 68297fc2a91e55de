"""The k-th string of a regular expression, as one expression of the row index.

A pattern is a sequence of places. A place has an alphabet and a range of repeats, so it
counts like a digit of a mixed-radix number: shorter repeats first, the rightmost place
fastest. Nothing is enumerated; every row decodes its own index.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from re import _parser as regex_parser

from pyspark.sql import Column, functions as F

OPEN_REPEAT = 16  # fixed value: longest repeat produced for an open-ended quantifier
LONG_MAX = 2**63 - 1

# fixed values: the characters a class stands for, in the order of string.printable
_CLASSES = {
    "CATEGORY_SPACE": r"\s",
    "CATEGORY_NOT_SPACE": r"\S",
    "CATEGORY_DIGIT": r"\d",
    "CATEGORY_NOT_DIGIT": r"\D",
    "CATEGORY_WORD": r"\w",
    "CATEGORY_NOT_WORD": r"\W",
}


@dataclass(frozen=True)
class Place:
    alphabet: str
    low: int = 1
    high: int = 1

    @property
    def radix(self) -> int:
        return sum(len(self.alphabet) ** r for r in range(self.low, self.high + 1))


def _alphabet(op, arg) -> str:
    name = str(op)
    if name == "LITERAL":
        return chr(arg)
    if name == "RANGE":
        return "".join(map(chr, range(arg[0], arg[1] + 1)))
    if name == "ANY":
        return string.printable
    if name == "CATEGORY":
        keep = re.compile(_CLASSES[str(arg)])
        return "".join(c for c in string.printable if keep.match(c))
    if name == "IN":
        return "".join(_alphabet(o, a) for o, a in arg)
    raise ValueError(f"cannot generate strings for the pattern element {name}")


def places(pattern: str) -> list[Place]:
    """Places of ``pattern`` from left to right; groups, alternation and negation are refused."""
    found = []
    for op, arg in regex_parser.parse(pattern):
        if str(op) == "AT":
            continue
        if str(op) == "MAX_REPEAT":
            low, high, body = arg
            high = OPEN_REPEAT if high == regex_parser.MAXREPEAT else high
            if len(body) != 1:
                raise ValueError("only single elements can be repeated")
            found.append(Place(_alphabet(*body[0]), low, high))
        else:
            found.append(Place(_alphabet(op, arg)))
    return found


def capacity(pattern: str) -> int:
    """How many strings the pattern yields."""
    total = 1
    for place in places(pattern):
        total *= place.radix
    return total


def _digit(index: Column, step: int, radix: int) -> Column:
    if step > LONG_MAX:
        return F.lit(0).cast("bigint")
    shifted = index if step == 1 else _div(index, step)
    return shifted if radix > LONG_MAX else shifted % F.lit(radix).cast("bigint")


def _div(index: Column, step: int) -> Column:
    """Whole-number division of non-negative longs without going through doubles."""
    return F.call_function("div", index, F.lit(step).cast("bigint"))


def _spell(number: Column, alphabet: str, length: int) -> Column:
    if length == 0:
        return F.lit("")
    size = len(alphabet)
    chars = [
        F.substr(F.lit(alphabet), (_digit(number, size ** (length - 1 - j), size) + 1).cast("int"), F.lit(1))
        for j in range(length)
    ]
    return F.concat(*chars)


def _place_text(digit: Column, place: Place) -> Column:
    size, text, start = len(place.alphabet), None, 0
    options = []
    for length in range(place.low, place.high + 1):
        if start > LONG_MAX:
            break
        options.append((start, length))
        start += size**length
    for start, length in options:
        spelled = _spell(digit - F.lit(start).cast("bigint"), place.alphabet, length)
        text = spelled if text is None else F.when(digit >= F.lit(start).cast("bigint"), spelled).otherwise(text)
    return text


def kth_string(index: Column, pattern: str) -> Column:
    """String number ``index`` (0-based) of the pattern."""
    index = index.cast("bigint")
    step, parts = 1, []
    for place in reversed(places(pattern)):
        parts.append(_place_text(_digit(index, step, place.radix), place))
        step *= place.radix
    return F.concat(*reversed(parts)) if parts else F.lit("")
