"""Composing Spark SQL expressions as text.

A vendor mapping has some thousand function calls.  As ``Column`` objects each
call costs several round trips between Python and the JVM, half a minute for all
vendors; as text a whole record is handed over by one ``F.expr`` and parsed by
Spark in milliseconds.  ``Sql`` holds the text and its operators; ``F`` (here)
turns any Spark SQL function name into a call, so code reads as with ``Column``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as spark_functions
from pyspark.sql import types as T

_names = itertools.count()


def quote(value: object) -> str:
    """SQL literal of a Python value."""
    if isinstance(value, Sql):
        return value.text
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


class Sql:
    """A Spark SQL expression as text, with the operators of ``Column``.

    ``tests`` lists cheap conditions of which one holds exactly when the value is
    not NULL.  A record collapses on the tests of its leaves, so a nested value is
    not written, or computed, again at every level around it.
    """

    __slots__ = ("text", "name", "tests")

    def __init__(self, text: str, name: str | None = None, tests: tuple[str, ...] = ()):
        self.text = text
        self.name = name
        self.tests = tests

    def __repr__(self) -> str:
        return self.text

    __hash__ = None

    def column(self) -> Column:
        col = spark_functions.expr(self.text)
        return col.alias(self.name) if self.name else col

    def alias(self, name: str) -> Sql:
        return Sql(self.text, name, self.tests)

    def present(self) -> tuple[str, ...]:
        return self.tests or (f"{self.text} IS NOT NULL",)

    def _binary(self, op: str, other: object) -> Sql:
        return Sql(f"({self.text} {op} {quote(other)})")

    def __eq__(self, other):  # type: ignore[override]
        return self._binary("=", other)

    def __ne__(self, other):  # type: ignore[override]
        return self._binary("!=", other)

    def __lt__(self, other):
        return self._binary("<", other)

    def __le__(self, other):
        return self._binary("<=", other)

    def __gt__(self, other):
        return self._binary(">", other)

    def __ge__(self, other):
        return self._binary(">=", other)

    def __and__(self, other):
        return self._binary("AND", other)

    def __or__(self, other):
        return self._binary("OR", other)

    def __invert__(self):
        return Sql(f"(NOT {self.text})")

    def __add__(self, other):
        return self._binary("+", other)

    def __sub__(self, other):
        return self._binary("-", other)

    def __mul__(self, other):
        return self._binary("*", other)

    def __truediv__(self, other):
        return self._binary("/", other)

    def __rsub__(self, other):
        return Sql(f"({quote(other)} - {self.text})")

    def __getitem__(self, field: str | int) -> Sql:
        if isinstance(field, int):
            return Sql(f"get({self.text}, {field})")
        return Sql(f"{self.text}.`{field}`")

    getField = __getitem__

    def isNull(self) -> Sql:
        return Sql(f"({self.text} IS NULL)")

    def isNotNull(self) -> Sql:
        return any_test(self.present())

    def isin(self, *values: object) -> Sql:
        return Sql(f"({self.text} IN ({', '.join(map(quote, values))}))")

    def between(self, low: object, high: object) -> Sql:
        return Sql(f"({self.text} BETWEEN {quote(low)} AND {quote(high)})")

    def rlike(self, pattern: str) -> Sql:
        return Sql(f"rlike({self.text}, {quote(pattern)})")

    def startswith(self, head: object) -> Sql:
        return Sql(f"startswith({self.text}, {quote(head)})")

    def endswith(self, tail: object) -> Sql:
        return Sql(f"endswith({self.text}, {quote(tail)})")

    def contains(self, part: object) -> Sql:
        return Sql(f"contains({self.text}, {quote(part)})")

    def cast(self, dtype: str | T.DataType) -> Sql:
        return Sql(f"CAST({self.text} AS {type_text(dtype)})")

    def try_cast(self, dtype: str | T.DataType) -> Sql:
        return Sql(f"try_cast({self.text} AS {type_text(dtype)})")


def any_test(tests: tuple[str, ...]) -> Sql:
    return Sql(f"({' OR '.join(dict.fromkeys(tests))})")


class Case(Sql):
    """A CASE being built: ``when(...).when(...).otherwise(...)``."""

    __slots__ = ("_branches",)

    def __init__(self, branches: list[tuple[str, str]]):
        self._branches = branches
        super().__init__(self._render())

    def _render(self, default: str | None = None) -> str:
        arms = " ".join(f"WHEN {c} THEN {v}" for c, v in self._branches)
        tail = f" ELSE {default}" if default is not None else ""
        return f"CASE {arms}{tail} END"

    def when(self, condition: Sql, value: object) -> Case:
        return Case([*self._branches, (condition.text, quote(value))])

    def otherwise(self, value: object) -> Sql:
        return Sql(self._render(quote(value)))


@lru_cache(maxsize=None)
def type_text(dtype: str | T.DataType) -> str:
    """DDL text; field names are quoted because some are SQL words (``from``, ``time``)."""
    if isinstance(dtype, str):
        return dtype
    if isinstance(dtype, T.StructType):
        return f"struct<{','.join(f'`{f.name}`:{type_text(f.dataType)}' for f in dtype.fields)}>"
    if isinstance(dtype, T.ArrayType):
        return f"array<{type_text(dtype.elementType)}>"
    return dtype.simpleString()


class _Functions:
    """``F.name(a, b)`` is the text ``name(a, b)``; Python callables become lambdas."""

    def __getattr__(self, name: str) -> Callable[..., Sql]:
        return lambda *args: Sql(f"{name}({', '.join(self._argument(a) for a in args)})")

    @staticmethod
    def _argument(value: object) -> str:
        if callable(value) and not isinstance(value, Sql):
            names = [f"v{next(_names)}" for _ in range(value.__code__.co_argcount)]
            body = quote(value(*[Sql(n) for n in names]))
            head = names[0] if len(names) == 1 else f"({', '.join(names)})"
            return f"{head} -> {body}"
        return quote(value)

    @staticmethod
    def lit(value: object) -> Sql:
        return Sql(quote(value))

    @staticmethod
    def col(name: str) -> Sql:
        return Sql(".".join(f"`{part}`" for part in name.split(".")))

    @staticmethod
    def when(condition: Sql, value: object) -> Case:
        return Case([(condition.text, quote(value))])

    @staticmethod
    def struct(*fields: Sql) -> Sql:
        inner = ", ".join(f"'{f.name}', {f.text}" for f in fields)
        return Sql(f"named_struct({inner})")

    @staticmethod
    def expr(text: str) -> Sql:
        return Sql(text)


F = _Functions()


def columns(**named: Sql) -> list[Column]:
    """Spark columns of named expressions, for ``select``."""
    return [spark_functions.expr(s.text).alias(n) for n, s in named.items()]
