"""Reading untyped JSON held in a VARIANT column.

An alert is parsed once (``parse``); every later read is a path lookup in the
binary VARIANT value.  ``text`` is the cheap probe: it is NULL for a missing key
and for JSON null, so the costlier ``kind`` is evaluated only for the few texts
whose meaning depends on the JSON type.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from alertloom.functions.sql import F, Sql

_PLAIN_KEY = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
_STRICT_END = "#end-of-text#"
# Texts that may be an empty or zero JSON value, or a non-empty JSON string.
_AMBIGUOUS = ("0", "0.0", "-0.0", "-0", "false", "[]", "{}")
_EMPTY_CONTAINERS = ("[]", "{}")


def path(*keys: str) -> str:
    """JSON path of nested object keys; keys may hold dots, ``@`` or ``$``."""
    return "$" + "".join(f".{k}" if _PLAIN_KEY.match(k) else f'["{k}"]' for k in keys)


def parse(json_text: Sql) -> Sql:
    """VARIANT of a JSON text, NULL when it does not parse."""
    return F.try_parse_json(json_text)


def parse_strict(json_text: Sql) -> Sql:
    """Like ``parse`` but text after the JSON value is an error.

    ``try_parse_json`` stops after the first complete value.  Wrapping the text
    as the first of two array elements makes left-over text show up.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), json_text, F.lit(f',"{_STRICT_END}"]')))

    def first(w: Sql) -> Sql:
        whole = F.try_variant_get(w, "$[1]", "string") == _STRICT_END
        return F.when(whole & F.try_variant_get(w, "$[2]", "variant").isNull(), F.try_variant_get(w, "$[0]", "variant"))

    # Parsed once, inside conditional expressions and lambdas too, where Spark does not share equal expressions.
    return let(wrapped, first)


class Doc(Sql):
    """A VARIANT object whose wanted keys are read together.

    Asking a VARIANT for a missing key is costly, and most vendor keys are
    missing in most alerts.  A ``Doc`` notes the keys asked of it; ``opened`` then
    reads them all in one pass as a struct, with NULL for the missing ones.
    """

    __slots__ = ("alias_", "children", "level")

    def __init__(self, text: str, alias: str, level: int = 0):
        super().__init__(text)
        self.alias_ = alias
        self.children: dict[str, Doc] = {}
        self.level = level

    def child(self, key: str) -> Doc:
        if key not in self.children:
            alias = f"{self.alias_}_{len(self.children)}"
            self.children[key] = Doc(f"{self.alias_}.`{key}`", alias, self.level + 1)
        return self.children[key]

    def opened(self) -> Sql:
        fields = ",".join(f"`{k}`:variant" for k in self.children)
        return Sql(f"try_variant_get({self.text}, '$', 'struct<{fields}>')")

    def tree(self) -> list[Doc]:
        """This object and all objects in it of which keys are wanted, parents first."""
        inner = [d for c in self.children.values() for d in c.tree()]
        return [self, *inner] if self.children else []


def get(v: Sql, *keys: str) -> Sql:
    """The VARIANT under nested keys, NULL when missing."""
    if isinstance(v, Doc):
        for k in keys:
            v = v.child(k)
        return v
    return F.try_variant_get(v, path(*keys), "variant") if keys else v


def text(v: Sql, *keys: str) -> Sql:
    """Scalar as text, container as JSON text, NULL when missing or JSON null."""
    return F.try_variant_get(get(v, *keys), "$", "string")


def integer(v: Sql, *keys: str) -> Sql:
    """Integer cast or NULL: 12.9 gives 12, "12" gives 12, "12.9" gives NULL."""
    return F.try_variant_get(get(v, *keys), "$", "long")


def items(v: Sql, *keys: str) -> Sql:
    """``array<variant>`` of a JSON list, NULL for anything else."""
    return F.try_variant_get(get(v, *keys), "$", "array<variant>")


_over = itertools.count()


def over(list_: Sql, body: Callable[..., Sql]) -> Sql:
    """``body`` for each object of an ``array<variant>``; other elements read as empty objects.

    The wanted keys are opened level by level, as for a whole alert.  A body of
    two arguments also gets the position of the element.
    """
    n = next(_over)
    root, index = f"o{n}", f"i{n}"
    element = Doc(f"e{n}", root)
    wants_index = body.__code__.co_argcount == 2
    result = body(element, Sql(f"w{n}.{index}")) if wants_index else body(element)
    docs = element.tree()
    whole = f"e{n}"
    names = re.compile(rf"(?<![\w.])({root}(?:_\d+)*(?=\.)|{whole}\b)")
    inside = lambda text: names.sub(rf"w{n}.\1", text)
    start = f"'{root}', {docs[0].opened()}, '{index}', {index}, '{whole}', {whole}"
    steps = f"transform({list_}, ({whole}, {index}) -> named_struct({start}))"
    known = [root, index, whole]
    for level in range(1, max(d.level for d in docs) + 1):
        new = [d for d in docs if d.level == level]
        kept = ", ".join(f"'{k}', w{n}.{k}" for k in known)
        added = ", ".join(f"'{d.alias_}', {inside(d.opened().text)}" for d in new)
        steps = f"transform({steps}, w{n} -> named_struct({kept}, {added}))"
        known += [d.alias_ for d in new]
    return Sql(f"transform({steps}, w{n} -> {inside(result.text)})")


def kind(v: Sql) -> Sql:
    """First word of the JSON type: VOID, STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE, ARRAY, OBJECT."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_text(v: Sql, *keys: str) -> Sql:
    return Sql(f"({F.schema_of_variant(get(v, *keys))} <=> 'STRING')")


def is_object(v: Sql, *keys: str) -> Sql:
    """A look at the outermost value; its schema would be that of all values inside."""
    return Sql(f"(try_variant_get({get(v, *keys).text}, '$', 'struct<>') IS NOT NULL)")


def given(v: Sql, *keys: str) -> Sql:
    """Neither missing nor JSON null, as a text that is not NULL, without writing that text."""
    x = get(v, *keys)
    return Sql(f"({x.text} IS NOT NULL AND NOT is_variant_null({x.text}))")


def is_list(v: Sql, *keys: str) -> Sql:
    return items(v, *keys).isNotNull()


def truthy(v: Sql, *keys: str) -> Sql:
    """Text of the value, NULL when missing, null, "", 0, false, [] or {}."""
    t = text(v, *keys)
    return F.when(t.isin("", *_AMBIGUOUS) & ((t == "") | ~is_text(v, *keys)), None).otherwise(t)


def nonempty(v: Sql, *keys: str) -> Sql:
    """Text of the value, NULL when missing, null, "", [] or {} (0 and false stay)."""
    t = text(v, *keys)
    empty = t.isin("", *_EMPTY_CONTAINERS) & ((t == "") | ~is_text(v, *keys))
    return F.when(empty, None).otherwise(t)


def truthy_value(v: Sql, *keys: str) -> Sql:
    """The VARIANT itself when truthy, to keep its JSON type."""
    return F.when(truthy(v, *keys).isNotNull(), get(v, *keys))


def nonempty_value(v: Sql, *keys: str) -> Sql:
    """The VARIANT itself unless missing, null, "", [] or {}."""
    return F.when(nonempty(v, *keys).isNotNull(), get(v, *keys))


def first_truthy(v: Sql, *names: str) -> Sql:
    return F.coalesce(*[truthy(v, n) for n in names])


def truthy_items(v: Sql, *keys: str) -> Sql:
    """Texts of the truthy elements of a list, NULL when there are none."""
    texts = F.filter(F.transform(items(v, *keys), lambda e: truthy(e)), lambda t: t.isNotNull())
    return let(texts, lambda t: F.when(F.size(t) > 0, t))


def truthy_not_text(v: Sql, *keys: str) -> Sql:
    """True when a text was expected and something else, not empty, is there."""
    return truthy(v, *keys).isNotNull() & ~is_text(v, *keys)


def truthy_not_object(v: Sql, *keys: str) -> Sql:
    return truthy(v, *keys).isNotNull() & ~is_object(v, *keys)


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def head(list_: Sql) -> Sql:
    """First non-NULL element."""
    return F.get(F.array_compact(list_), 0)


def pick_first(list_: Sql, value: Callable[[Sql], Sql]) -> Sql:
    """First non-NULL ``value`` over the elements."""
    return F.try_element_at(_hits(list_, value), F.lit(1))


def pick_last(list_: Sql, value: Callable[[Sql], Sql]) -> Sql:
    """Last non-NULL ``value`` over the elements."""
    return F.try_element_at(_hits(list_, value), F.lit(-1))


def _hits(list_: Sql, value: Callable[[Sql], Sql]) -> Sql:
    return F.filter(F.transform(list_, value), lambda x: x.isNotNull())
