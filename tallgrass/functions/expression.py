"""A small expression language over columns: comparison, logic, arithmetic, functions, and @variables.

    or, ||, |   and, &&, &   not, !   == != < <= > >=  in   + -   * / %   ** (right to left)   unary -

An expression is parsed to a Spark column, so Catalyst sees it whole and pushes filters to the scan. Division by zero
raises, as in ANSI SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<tick>`[^`]+`)|(?P<var>@\w+)|(?P<name>[^\W\d]\w*)|(?P<op>\*\*|==|!=|<=|>=|&&|\|\||[-+*/%<>()!,&|\[\]=]))")

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "log": F.ln, "ln": F.ln, "log10": F.log10, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double"), "round": F.round, "pow": F.pow, "power": F.pow,
    "min": lambda *c: F.least(*c), "max": lambda *c: F.greatest(*c), "lower": F.lower, "upper": F.upper, "len": F.length,
    "isnull": F.isnull, "notnull": F.isnotnull,
}


class _Parser:
    def __init__(self, text: str, df: DataFrame, variables: Mapping[str, object]):
        self.df, self.variables = df, variables
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:].strip()[0]!r} in {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        if self.at >= len(self.tokens):
            return None
        kind, value = self.tokens[self.at]
        return value.lower() if kind == "name" and value.lower() in ("and", "or", "not", "in", "true", "false", "null") else value if kind == "op" else None

    def take(self, *options: str) -> str | None:
        if self.peek() in options:
            self.at += 1
            return self.tokens[self.at - 1][1].lower()
        return None

    def expect(self, what: str) -> None:
        if not self.take(what):
            raise ValueError(f"expected {what!r}")

    def whole(self) -> Column:
        out = self.disjunction()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def disjunction(self) -> Column:
        out = self.conjunction()
        while self.take("or", "||", "|"):
            out = out | self.conjunction()
        return out

    def conjunction(self) -> Column:
        out = self.negation()
        while self.take("and", "&&", "&"):
            out = out & self.negation()
        return out

    def negation(self) -> Column:
        return ~self.negation() if self.take("not", "!") else self.comparison()

    def comparison(self) -> Column:
        out = self.sum()
        chain = None
        while op := self.take("==", "=", "!=", "<", "<=", ">", ">=", "in", "not"):
            if op in ("in", "not"):
                if op == "not":
                    self.expect("in")
                close = "]" if self.take("[") else self.expect("(") or ")"
                options = [self.sum()]
                while self.take(","):
                    options.append(self.sum())
                self.expect(close)
                part = out.isin(*options)
                part = ~part if op == "not" else part
            else:
                right = self.sum()
                part = {"==": out.__eq__, "=": out.__eq__, "!=": out.__ne__, "<": out.__lt__, "<=": out.__le__, ">": out.__gt__, ">=": out.__ge__}[op](right)
                out = right
            chain = part if chain is None else chain & part
        return out if chain is None else chain

    def sum(self) -> Column:
        out = self.product()
        while op := self.take("+", "-"):
            right = self.product()
            out = out + right if op == "+" else out - right
        return out

    def product(self) -> Column:
        out = self.unary()
        while op := self.take("*", "/", "%"):
            right = self.unary()
            out = out * right if op == "*" else out / right if op == "/" else out % right
        return out

    def unary(self) -> Column:
        if self.take("-"):
            return -self.unary()
        self.take("+")
        return self.power()

    def power(self) -> Column:
        base = self.atom()
        return F.pow(base, self.unary()) if self.take("**") else base

    def atom(self) -> Column:
        if self.take("("):
            out = self.disjunction()
            self.expect(")")
            return out
        if self.at >= len(self.tokens):
            raise ValueError("unexpected end")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return F.lit(float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "str":
            return F.lit(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "tick":
            return self.df[value[1:-1]]
        if kind == "var":
            return F.lit(self.variables[value[1:]])
        if kind == "name":
            low = value.lower()
            if low in ("true", "false", "null") and value not in self.df.columns:
                return F.lit({"true": True, "false": False, "null": None}[low])
            if self.take("("):
                if low not in FUNCTIONS:
                    raise ValueError(f"no function {value!r}")
                args = []
                if not self.take(")"):
                    args.append(self.disjunction())
                    while self.take(","):
                        args.append(self.disjunction())
                    self.expect(")")
                return FUNCTIONS[low](*args)
            return self.df[value]
        raise ValueError(f"unexpected {value!r}")


def evaluate(df: DataFrame, expression: str, variables: Mapping[str, object] | None = None) -> Column:
    return _Parser(expression, df, variables or {}).whole()


def query_filter(df: DataFrame, expression: str, variables: Mapping[str, object] | None = None) -> DataFrame:
    return df.where(evaluate(df, expression, variables))
