"""Validators: the label check on any JSON, and the model schema check that also cleans."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as SF

from alertloom import schemas as S
from alertloom.functions import build as B
from alertloom.functions import variants as V
from alertloom.functions.sql import F, Sql, columns
from alertloom.functions.stage import once
from alertloom.functions.text import MAY_HOLD_EMPTIES

# --- fixed values of the label check ----------------------------------------
REQUIRED = (
    "activity_id", "category_uid", "category_name", "class_uid", "class_name", "finding_info",
    "metadata", "severity_id", "severity", "time", "type_uid",
)
FORBIDDEN = (
    "attacks", "process", "src_endpoint", "dst_endpoint", "user", "actor", "connection_info", "email",
)
LABEL_SEVERITIES = (0, 1, 2, 3, 4, 5, 99)
LABEL_ACTIVITIES = (0, 1, 2, 3, 99)


def check_labels(df: DataFrame, finding: str = "ocsf") -> DataFrame:
    """Adds ``errors``, the label check's messages for a finding's JSON text (empty when valid)."""
    doc = V.Doc("_doc", "_doc_0")
    errors = _label_errors(doc)
    parsed = df.withColumn("_doc", V.parse_strict(F.col(finding)).column())
    for level in range(max(d.level for d in doc.tree()) + 1):
        parsed = parsed.select(
            "*", *columns(**{d.alias_: d.opened() for d in doc.tree() if d.level == level})
        )
    every = F.concat(B.list_of(*errors), empty_fields(F.col("_doc")))
    return once(parsed, df.columns, errors=F.when(F.col("_doc").isNull(), F.array("not valid JSON")).otherwise(every))


def _when(bad: Sql, message: object) -> Sql:
    return Sql(F.when(bad, message).text, tests=(bad.text,))


def _label_errors(doc: V.Doc) -> list[Sql]:
    errors = [_when(V.get(doc, k).isNull(), f"Missing required field: {k}") for k in REQUIRED]
    errors += [
        _when(V.get(doc, k).isNotNull(), f"Forbidden key at event root: '{k}' — use finding_info.attacks or evidences[] instead")
        for k in FORBIDDEN
    ]

    def dict_or(doc_: V.Doc, name: str, inner: list[Sql]) -> list[Sql]:
        fits = doc_.isNull() | V.is_object(doc_)
        return [
            *[_when(fits & Sql(f"({' OR '.join(e.tests)})"), e) for e in inner],
            _when(~fits, f"{name} must be a dict"),
        ]

    info, meta = V.get(doc, "finding_info"), V.get(doc, "metadata")
    product = V.get(meta, "product")
    empty = lambda d, k, p: _when(V.truthy(d, k).isNull(), f"Missing or empty {p}.{k}")
    errors += dict_or(info, "finding_info", [empty(info, k, "finding_info") for k in ("title", "uid")])
    in_product = dict_or(
        product, "metadata.product", [empty(product, k, "metadata.product") for k in ("name", "vendor_name")]
    )
    version = ~F.coalesce((V.text(meta, "version") == S.LABEL_VERSION) & V.is_text(meta, "version"), False)
    errors += dict_or(meta, "metadata", [_when(version, f"metadata.version must be '{S.LABEL_VERSION}'"), *in_product])

    number = lambda k: F.try_variant_get(V.get(doc, k), "$", "double")
    for key, allowed in (("severity_id", LABEL_SEVERITIES), ("activity_id", LABEL_ACTIVITIES)):
        given = V.text(doc, key).isNotNull()
        fits = F.coalesce(number(key).isin(*allowed) & ~V.is_text(doc, key), False)
        errors.append(_when(given & ~fits, F.concat(f"{key} ", V.text(doc, key), " not allowed")))
    expected = number("class_uid") * 100 + number("activity_id")
    errors.append(
        _when(
            V.get(doc, "type_uid").isNotNull() & (number("type_uid") != expected),
            F.concat("type_uid ", V.text(doc, "type_uid"), " != class_uid*100+activity_id"),
        )
    )
    fits = V.is_text(doc, "time") & (V.text(doc, "time") != "")
    errors.append(_when(~F.coalesce(fits, False), "time must be a non-empty string"))
    return errors


def empty_fields(v: Sql) -> Sql:
    """Messages for every null, "", [] or {} inside, depth first, with its path, at any depth.

    One pass over the brackets, keys, commas and empty values of the JSON text, where it holds an empty value at all.
    ``kind, path, place`` are those of the innermost open object or list, ``stack`` has those of the ones around it.
    """
    at = """CASE s.kind WHEN '' THEN '' WHEN '[' THEN concat(s.path, '[', s.place, ']') ELSE CASE WHEN s.path = '' THEN s.key ELSE concat(s.path, '.', s.key) END END"""
    note = f"transform(array({at}), p -> concat(CASE WHEN endswith(p, ']') THEN 'Null/empty item found: ' ELSE 'Null/empty field found: ' END, p))"
    name = "CASE WHEN instr(t, '\\\\') = 0 THEN substr(t, 2, length(t) - 3) ELSE from_json(concat('[', left(t, length(t) - 1), ']'), 'array<string>')[0] END"

    def state(kind: str = "s.kind", path: str = "s.path", place: str = "s.place", key: str = "s.key", stack: str = "s.stack", out: str = "s.out") -> str:
        return f"named_struct('kind', {kind}, 'path', {path}, 'place', {place}, 'key', {key}, 'stack', {stack}, 'out', {out})"

    around = "named_struct('kind', s.kind, 'path', s.path, 'place', s.place)"
    last = "element_at(s.stack, -1)"
    step = f"""CASE
        WHEN endswith(t, ':') THEN {state(key=name)}
        WHEN t = ',' THEN CASE WHEN s.kind = '[' THEN {state(place="s.place + 1")} ELSE s END
        WHEN t IN ('{{', '[') THEN {state("t", at, "0", stack=f"concat(s.stack, array({around}))")}
        WHEN t IN ('}}', ']') THEN {state(f"{last}.kind", f"{last}.path", f"{last}.place", stack="slice(s.stack, 1, size(s.stack) - 1)")}
        WHEN s.kind = '' THEN s
        ELSE {state(out=f"concat(s.out, {note})")} END"""
    start = "named_struct('kind', '', 'path', '', 'place', 0, 'key', '', 'stack', cast(array() AS array<struct<kind:string,path:string,place:int>>), 'out', cast(array() AS array<string>))"
    fold = lambda text: f"aggregate(regexp_extract_all({text}, r'{_EMPTY_MARKS}', 1), {start}, (s, t) -> {step}, s -> s.out)"
    none = "cast(array() AS array<string>)"
    return V.let(F.to_json(v), lambda text: Sql(f"CASE WHEN NOT rlike({text.text}, r'{MAY_HOLD_EMPTIES}') THEN {none} ELSE {fold(text.text)} END"))


# Keys with their colon, brackets, commas and empty values of compact JSON, one after the other; other values are passed over.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_EMPTY_MARKS = rf'(?:(?!""){_STRING}(?!:)|(?!null)[^\s"\[\]{{}},:]++)*+({_STRING}:|""|null|\[\]|\{{\}}|[\[\]{{}},])'


# --- model schema -----------------------------------------------------------

_INTEGER = r"^\s*[+-]?\d+(\.0*)?\s*$"
_MESSAGES = {
    "text": "Input should be a valid string",
    "int": "Input should be a valid integer",
    "float": "Input should be a valid number",
    "bool": "Input should be a valid boolean",
    "map": "Input should be a valid dictionary",
    "obj": "Input should be a valid dictionary",
    "chain": "Input should be a valid dictionary",
    "objs": "Input should be a valid list",
    "texts": "Input should be a valid list",
    "ints": "Input should be a valid list",
}
_TRUE, _FALSE = ("true", "1", "yes", "on", "t", "y"), ("false", "0", "no", "off", "f", "n")


def check_model(df: DataFrame, doc: str) -> DataFrame:
    """Adds ``cleaned`` (finding struct), ``errors`` and ``stripped`` for a VARIANT column.

    ``cleaned`` is NULL when there are errors; then ``stripped`` is empty, since
    cleaning did not happen.
    """
    root = V.Doc(f"`{doc}`", "_m")
    lists = _Apart()
    value, errors = _object(S.FINDING_FIELDS, root, [], lists)
    tree = root.tree()
    opened = df
    for level in range(max(d.level for d in tree) + 1):
        opened = opened.select("*", *columns(**{d.alias_: d.opened() for d in tree if d.level == level}))
    # Lists of objects are checked first, once, and then used for values and messages.
    listed = once(
        opened, [*df.columns, *[d.alias_ for d in tree]], **lists.named
    )
    found = once(listed, df.columns, _errors=_joined(errors), _value=value)
    is_object = V.is_object(F.col(doc))
    all_errors = (
        F.when(~is_object, F.array("Expected dict"))
        .when(F.col("_errors") == "", F.array().cast("array<string>"))
        .otherwise(F.split(F.col("_errors"), "\n"))
    )
    good = is_object & (F.col("_errors") == "")
    return once(
        found,
        df.columns,
        cleaned=F.when(good, F.col("_value")),
        errors=all_errors,
        stripped=F.when(good, stripped_fields(F.col(doc), S.FINDING_FIELDS)).otherwise(F.array().cast("array<string>")),
    )


def _joined(errors: list[Sql]) -> Sql:
    """All messages in one text, NULL ones skipped; unlike an array filter this is compiled."""
    return F.concat_ws("\n", *errors)


def _loc(loc: list, message: str) -> Sql:
    """Place and message; literal pieces are joined here, so most places are one literal."""
    parts: list[object] = ["("]
    for i, step in enumerate(loc):
        parts[-1] += ", " if i else ""
        if isinstance(step, Sql):
            parts += [step.cast("string"), ""]
        else:
            parts[-1] += f"'{step}'"
    parts[-1] += ("," if len(loc) == 1 else "") + f"): {message}"
    return F.concat(*parts) if len(parts) > 1 else F.lit(parts[0])


class _Apart:
    """Checked lists that are used for values and for messages: each is computed once, under a name of its own, ahead of both."""

    def __init__(self, holder: str = ""):
        self.holder = holder
        self.named: dict[str, Sql] = {}

    def put(self, checked: Sql) -> Sql:
        name = f"_list{len(self.named)}"
        self.named[name] = checked
        return Sql(f"{self.holder}{name}")


_holders = itertools.count()


def _element(fields: dict[str, S.Field], e: V.Doc, place: list) -> Sql:
    """Value ``v`` and messages ``e`` of one object of a list."""
    holder = f"u{next(_holders)}"
    apart = _Apart(f"{holder}.")
    inner, found = _object(fields, e, place, apart, inner=True)
    not_object = F.when(~V.is_object(e), _loc(place, _MESSAGES["obj"]))
    body = F.struct(inner.alias("v"), _joined([not_object, *found]).alias("e"))
    if not apart.named:
        return body
    lists = F.struct(*[c.alias(n) for n, c in apart.named.items()])
    return Sql(f"element_at(transform(array({lists.text}), {holder} -> {body.text}), 1)")


def _object(
    fields: dict[str, S.Field], doc: V.Doc, loc: list, lists: _Apart, inner: bool = False
) -> tuple[Sql, list[Sql]]:
    """Struct of the fields' values, and their messages.  ``lists`` takes the lists of objects and the chains, to be
    checked ahead; ``inner``: inside a list, where nothing is compiled."""
    values, errors = [], []
    inside = V.is_object(doc) if loc else None
    for name, field in fields.items():
        value, found = _field(field, V.get(doc, name), [*loc, name], inside, lists, inner)
        values.append(value.alias(name))
        errors += found
    return F.struct(*values), errors


def _field(
    field: S.Field, x: V.Doc, loc: list, inside: Sql | None, lists: _Apart, inner: bool
) -> tuple[Sql, list[Sql]]:
    t = V.text(x)
    given = V.given(x)
    optional = not field.required and field.default is None
    errors: list[Sql] = []
    if field.required:
        absent = x.isNull() if inside is None else inside & x.isNull()
        errors.append(F.when(absent, _loc(loc, "Field required")))
    if not optional:
        errors.append(F.when(x.isNotNull() & ~given, _loc(loc, _MESSAGES[field.kind])))
    wrong = lambda ok: F.when(given & ~F.coalesce(ok, False), _loc(loc, _MESSAGES[field.kind]))

    if field.kind == "text":
        value, bad = F.when(V.is_text(x), t), [wrong(V.is_text(x))]
    elif field.kind == "int":
        value, ok = _integer(x, t)
        bad = [wrong(ok)]
        if field.allowed:
            out = value.isNotNull() & ~value.isin(*field.allowed)
            bad.append(F.when(out, _loc(loc, f"Input should be one of {len(field.allowed)} allowed values")))
    elif field.kind == "float":
        value = F.try_variant_get(x, "$", "double")
        bad = [wrong(value.isNotNull())]
    elif field.kind == "bool":
        value = F.when(F.lower(t).isin(*_TRUE), True).when(F.lower(t).isin(*_FALSE), False)
        bad = [wrong(value.isNotNull())]
    elif field.kind == "map":
        value = F.try_variant_get(x, "$", "map<string,variant>")
        bad = [wrong(V.is_object(x))]
    elif field.kind in ("texts", "ints"):
        value, bad = _scalar_list(field, x, loc, wrong)
    elif field.kind == "chain":
        value, bad = _chain(field, x, given, loc, lists)
    elif field.kind == "obj":
        fields, bad = _object(field.fields, x, loc, lists, inner)
        value = F.when(V.is_object(x), fields)
        if inner:
            # Most objects are missing; what is in them is then not looked at.
            bad = [F.when(V.is_object(x), F.nullif(_joined(bad), ""))]
        bad = [wrong(V.is_object(x)), *bad]
    else:
        checked = lists.put(V.over(V.items(x), lambda e, i: _element(field.fields, e, [*loc, i])))
        value = F.transform(checked, lambda c: c["v"])
        messages = F.filter(F.transform(checked, lambda c: c["e"]), lambda m: m != "")
        bad = [wrong(V.is_list(x)), F.nullif(F.array_join(messages, "\n"), "")]
    if field.default is not None:
        value = F.coalesce(value, F.lit(field.default))
    return value, [*errors, *bad]


def _chain(field: S.Field, x: V.Doc, given: Sql, loc: list, lists: _Apart) -> tuple[Sql, list[Sql]]:
    """An object and all those above it, checked as one list, however long the chain is, and put together again."""
    above = f"try_variant_get(element_at(c, -1), '$.{S.PARENT}', 'variant')"
    # The key's count in the text is the most links there can be.
    most = f"size(split({V.text(x)}, '\"{S.PARENT}\":'))"
    links = F.filter(Sql(f"aggregate(sequence(1, {most}), array({x}), (c, i) -> concat(c, array({above})))"), lambda e: V.given(e))

    def element(e: V.Doc, i: Sql) -> Sql:
        place = [*loc[:-1], Sql(f"concat(\"'{loc[-1]}'\", repeat(\", '{S.PARENT}'\", {i}))")]
        return _element(field.fields, e, place)

    checked = lists.put(F.when(given, V.over(links, element)))

    def typed(c: Sql, level: int) -> Sql:
        if level == field.levels:
            return _rest(c, level)
        own = [c[level]["v"][n].alias(n) for n in field.fields]
        return F.when(F.size(c) > level, F.struct(*own, typed(c, level + 1).alias(S.PARENT)))

    value = F.when(given, V.let(checked, lambda c: typed(c, 0)))
    messages = F.filter(F.transform(checked, lambda c: c["e"]), lambda m: m != "")
    return value, [F.when(given, F.nullif(F.array_join(messages, "\n"), ""))]


def _rest(c: Sql, level: int) -> Sql:
    """The checked objects from ``level`` on as nested JSON, each in the one below it."""
    texts = f"transform(slice({c}, {level + 1}, greatest(size({c}) - {level}, 0)), e -> to_json(e.v))"
    nested = f"""aggregate(reverse({texts}), CAST(NULL AS string),
        (a, j) -> CASE WHEN a IS NULL THEN j ELSE concat(left(j, length(j) - 1), CASE WHEN j = '{{}}' THEN '' ELSE ',' END, '"{S.PARENT}":', a, '}}') END)"""
    return F.when(F.size(c) > level, F.parse_json(Sql(nested)))


def _integer(x: Sql, t: Sql) -> tuple[Sql, Sql]:
    """Whole numbers, booleans and texts of whole numbers count as integers."""
    ok = t.rlike(_INTEGER) | (F.schema_of_variant(x) == "BOOLEAN")
    value = F.coalesce(V.integer(x), t.try_cast("double").try_cast("bigint"))
    return F.when(ok, value), ok


def _scalar_list(field: S.Field, x: V.Doc, loc: list, wrong) -> tuple[Sql, list[Sql]]:
    if field.kind == "texts":
        read = lambda e: F.when(V.is_text(e), V.text(e))
        message = _MESSAGES["text"]
    else:
        read = lambda e: V.let(_integer(e, V.text(e))[0], lambda n: F.when(n.isin(*field.allowed), n))
        message = _MESSAGES["int"]
    value = F.transform(V.items(x), read)
    bad = F.filter(F.transform(value, lambda e, i: F.when(e.isNull(), _loc([*loc, i], message))), lambda m: m.isNotNull())
    return value, [wrong(V.is_list(x)), F.nullif(F.array_join(bad, "\n"), "")]


def stripped_fields(v: Sql, fields: dict[str, S.Field], prefix: str = "") -> Sql:
    """Keys that cleaning takes away: unknown ones and nulls; objects are searched, lists are not."""
    entries = F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.array())
    gone = F.filter(entries, lambda e: ~e["key"].isin(*fields) | V.text(e["value"]).isNull())
    here = F.transform(gone, lambda e: F.concat(prefix, e["key"]))
    inner = [
        stripped_fields(F.try_variant_get(v, V.path(n), "variant"), f.fields, f"{prefix}{n}.")
        for n, f in fields.items()
        if f.kind == "obj"
    ]
    return F.concat(here, *inner)


def validation_summary(checked: DataFrame) -> DataFrame:
    """Records, how many passed and how many failed; a line that is no JSON fails without counting as a record."""
    failed, broken = SF.size("errors") > 0, SF.array_contains("errors", "not valid JSON")
    counts = checked.agg(
        SF.sum((~broken).cast("long")).alias("total"), SF.sum(failed.cast("long")).alias("failed")
    )
    return counts.select("total", (SF.col("total") - SF.col("failed")).alias("passed"), "failed")
