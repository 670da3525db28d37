"""Building nested records that hold no null, "", [] or {} at any level.

``obj`` and ``arr`` collapse to NULL when nothing is in them, so emptiness moves
up without a recursive clean-up pass, and ``to_json`` leaves NULL fields out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from alertloom import schemas as S
from alertloom.functions.sql import F, Sql, any_test
from alertloom.functions.variants import let


_NIL = "_nil"
_nested_types: list[T.DataType] = []


def _collect(dtype: T.DataType) -> None:
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)) and dtype not in _nested_types:
        _nested_types.append(dtype)
        if isinstance(dtype, T.StructType):
            for field in dtype.fields:
                _collect(field.dataType)
        elif isinstance(dtype, T.ArrayType):
            _collect(dtype.elementType)


_collect(S.FINDING)


def with_nils(df: DataFrame) -> DataFrame:
    """Adds a NULL column per nested type of the finding, for ``record`` and ``always``.

    Writing out each missing nested field as a cast to its full type makes the
    expression text ten times as long.  Spark folds these columns into literals.
    """
    nils = [F.lit(None).cast(t).alias(f"{_NIL}{i}").column() for i, t in enumerate(_nested_types)]
    return df.select("*", *nils)


def conform(value: Sql | None, dtype: T.DataType) -> Sql:
    if value is None and dtype in _nested_types:
        return F.col(f"{_NIL}{_nested_types.index(dtype)}")
    if value is None:
        return F.lit(None).cast(dtype)
    return value.cast(dtype) if isinstance(dtype, (T.LongType, T.DoubleType)) else value


def record(schema: T.StructType, **fields: Sql | None) -> Sql:
    """A struct of ``schema`` (order and types), missing fields NULL; NULL when all are."""
    unknown = set(fields) - set(schema.names)
    if unknown:
        raise ValueError(f"fields not in schema: {sorted(unknown)}")
    given = [c for c in fields.values() if c is not None]
    if not given:
        return conform(None, schema)
    tests = tuple(t for c in given for t in c.present())
    return Sql(F.when(any_test(tests), always(schema, **fields)).text, tests=tests)


def always(schema: T.StructType, **fields: Sql | None) -> Sql:
    """As ``record`` without the collapse, for structs with constant fields."""
    return F.struct(*[conform(fields.get(f.name), f.dataType).alias(f.name) for f in schema.fields])


def arr(*elements: Sql) -> Sql:
    """Array of the non-NULL elements, NULL when none is left."""
    tests = tuple(t for e in elements for t in e.present())
    body = F.array(*elements) if len(elements) == 1 else list_of(*elements)
    return Sql(F.when(any_test(tests), body).text, tests=tests)


def list_of(*elements: Sql) -> Sql:
    """Array of the non-NULL elements.

    Joined from one-element arrays: ``array_compact`` takes a lambda, and what is
    inside a lambda call is interpreted instead of compiled.
    """
    return F.concat(*[F.when(any_test(e.present()), F.array(e)).otherwise(F.array()) for e in elements])


def nonempty_array(a: Sql) -> Sql:
    return let(a, lambda x: F.when(F.size(x) > 0, x))


def joined(*arrays: Sql) -> Sql:
    """All arrays one after the other, NULL arrays left out."""
    return F.concat(*[F.coalesce(a, F.array()) for a in arrays])


def some_text(c: Sql) -> Sql:
    """NULL instead of an empty text; blanks stay, as the reference keeps them."""
    return F.nullif(c, F.lit(""))


def free_map(**entries: Sql | None) -> Sql:
    """``map<string,variant>`` of the non-NULL entries, NULL when none is left."""
    pairs = []
    for key, value in entries.items():
        if value is not None:
            entry = F.struct(F.lit(key).alias("key"), value.cast("variant").alias("value"))
            pairs.append(Sql(entry.text, tests=value.present()))
    tests = tuple(t for p in pairs for t in p.tests)
    return Sql(F.when(any_test(tests), F.map_from_entries(list_of(*pairs))).text, tests=tests)


def first_per_key(list_: Sql, key: Callable[[Sql], Sql]) -> Sql:
    """First element per key, in first-seen order, in O(n log n) for any list length."""
    tagged = F.transform(
        list_, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))
    )
    firsts = let(
        F.array_sort(tagged),
        lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"])),
    )
    back = F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(back, lambda e: e["x"])
