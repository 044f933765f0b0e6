"""String functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def title(c: Column) -> Column:
    return F.initcap(c)


def swapcase(c: Column) -> Column:
    return F.translate(c, LETTERS + LETTERS.upper(), LETTERS.upper() + LETTERS)


def contains(c: Column, pattern: str, case: bool = True, regex: bool = True) -> Column:
    pattern = pattern if regex else re.escape(pattern)
    return c.rlike(pattern if case else f"(?i){pattern}")


def slice_(c: Column, start: int, stop: int) -> Column:
    """Code points [start, stop), counted from 0."""
    return F.substring(c, start + 1, max(stop - start, 0))


def pad(c: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    """Padded to the width; longer strings stay whole."""
    padded = {"left": lambda: F.lpad(c, width, fill), "right": lambda: F.rpad(c, width, fill), "both": lambda: center(c, width, fill)}[side]()
    return F.when(F.length(c) >= width, c).otherwise(padded)


def center(c: Column, width: int, fill: str = " ") -> Column:
    """An odd fill goes to the right."""
    room = F.lit(width) - F.length(c)
    left = F.floor(room / 2).cast("int")
    return F.when(room <= 0, c).otherwise(F.concat(F.expr(f"repeat('{fill}', 1)") if False else F.repeat(F.lit(fill), left), c, F.repeat(F.lit(fill), room - left)))


def zfill(c: Column, width: int) -> Column:
    """Zeros behind a sign."""
    sign = F.regexp_extract(c, "^[+-]", 0)
    body = F.regexp_replace(c, "^[+-]", "")
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(c), F.lit(0)))
    return F.concat(sign, zeros, body)


def isalpha(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def isdigit(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}+$")


def isalnum(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{Nd}]+$")


def isspace(c: Column) -> Column:
    return c.rlike(r"^\s+$")


def islower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def isupper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def join(c: Column, separator: str) -> Column:
    return F.array_join(c, separator)


def cat(*columns: Column, sep: str = "") -> Column:
    """NULL if a part is NULL."""
    parts: list[Column] = []
    for k, c in enumerate(columns):
        parts += [F.lit(sep), c] if k and sep else [c]
    return F.concat(*parts)
