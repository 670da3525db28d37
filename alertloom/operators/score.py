"""Confidence of a finding: schema, coverage and consistency, and the decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from alertloom import schemas as S
from alertloom.functions import variants as V
from alertloom.functions.sql import F, Sql, columns
from alertloom.functions.stage import deal, once
from alertloom.functions.text import JSON_KEY, JSON_TOKEN, found_json
from alertloom.operators import validate

# --- fixed values -----------------------------------------------------------
SCHEMA_FIELDS = (
    "class_uid", "class_name", "activity_id", "severity_id", "time", "type_uid", "finding_info", "metadata",
    "finding_info.title", "finding_info.uid", "metadata.product", "metadata.product.name",
    "metadata.product.vendor_name",
)
REQUIRED_FIELDS = (
    "activity_id", "category_uid", "class_uid", "class_name", "type_uid", "finding_info", "finding_info.title",
    "finding_info.uid", "metadata", "metadata.product", "metadata.product.name", "metadata.product.vendor_name",
    "severity_id", "time",
)
RECOMMENDED_FIELDS = (
    "finding_info.desc", "finding_info.created_time", "finding_info.attacks", "finding_info.analytic",
    "finding_info.src_url", "activity_name", "severity", "status", "is_alert",
)
RICHNESS_FIELDS = (
    "device", "device.hostname", "device.ip", "device.uid", "device.owner", "device.os", "evidences", "observables",
    "resources", "enrichments", "malware", "start_time", "end_time", "unmapped", "risk_score", "risk_level_id",
    "confidence_score", "impact_score", "message", "type_name",
)
TIERS = ((0.5, REQUIRED_FIELDS), (0.3, RECOMMENDED_FIELDS), (0.2, RICHNESS_FIELDS))
WEIGHTS = {"schema": 0.4, "coverage": 0.3, "consistency": 0.3}
ACCEPT_FROM, REVIEW_FROM = 0.85, 0.60
CONSTANT_TEXTS = ("Findings", "Detection Finding", "Create", "1.1.0")
CONSTANT_NUMBERS = (2004, 200401)
LEAF_DEPTH, LEAF_LIMIT = 5, 50


def score(
    df: DataFrame, raw: str, doc: str, cleaned: str = "cleaned", errors: str = "errors", warnings: str = "stripped",
    accept_from: float = ACCEPT_FROM, review_from: float = REVIEW_FROM, source: Sql | None = None, parity: bool = True,
) -> DataFrame:
    """Adds ``schema_validity, field_coverage, value_consistency, confidence, decision``.

    ``raw`` is the alert as VARIANT; the scored finding is ``cleaned`` where it is
    not NULL, else the VARIANT ``doc``; ``source`` is the text that was parsed to it, whose
    order of keys a VARIANT does not keep.  With ``parity`` leaves are looked for in the ASCII-escaped alert, as the
    reference does, without it in the alert as it is written.  The decision uses the unrounded score.
    """
    keep = df.columns
    # A cleaned finding is looked at as a struct, another one as the VARIANT it came as.
    is_clean = F.col(cleaned).isNotNull()
    final = F.when(F.col(cleaned).isNull(), F.col(doc))
    with_final = df.select("*", *columns(_final=final, _raw_text=F.to_json(F.col(raw))))
    f = V.Doc("_final", "_f")

    def both(path: str, test: Callable[[Sql], Sql]) -> Sql:
        typed = F.col(cleaned)
        for name in path.split("."):
            typed = typed[name]
        return F.when(is_clean, typed.isNotNull()).otherwise(test(V.get(f, *path.split("."))))

    present = {p: both(p, lambda v: v.isNotNull()) for p in SCHEMA_FIELDS}
    # A key holding null counts as absent here.
    filled = {p: both(p, lambda v: V.text(v).isNotNull()) for _, fields in TIERS for p in fields}
    schema = _schema(present, F.size(F.col(errors)), F.size(F.col(warnings)))
    coverage = _sum([_share(filled, fields) * weight for weight, fields in TIERS])
    leaves = F.when(is_clean, _typed_leaves(F.col(cleaned))).otherwise(_any_leaves(F.col("_final")) if source is None else _source_leaves(source))
    opened = with_final
    for level in range(max(d.level for d in f.tree()) + 1):
        opened = opened.select("*", *columns(**{d.alias_: d.opened() for d in f.tree() if d.level == level}))
    signals = once(
        opened, [*keep, "_raw_text"], _schema=schema, _coverage=coverage, _leaves=F.slice(leaves, 1, LEAF_LIMIT)
    )
    found = F.size(F.filter(F.col("_leaves"), lambda v: _occurs(v, F.col("_raw_text"), parity)))
    consistency = F.when(F.size(F.col("_leaves")) > 0, found / F.size(F.col("_leaves"))).otherwise(0.5)
    counted = once(signals, [*keep, "_schema", "_coverage"], _consistency=consistency)
    s, c, k = F.col("_schema"), F.col("_coverage"), F.col("_consistency")
    total = _sum([s * WEIGHTS["schema"], c * WEIGHTS["coverage"], k * WEIGHTS["consistency"]])
    return counted.select(
        *keep,
        *columns(
            schema_validity=F.round(s, 3),
            field_coverage=F.round(c, 3),
            value_consistency=F.round(k, 3),
            confidence=F.greatest(0.0, F.least(1.0, F.round(total, 3))),
            decision=decide(total, accept_from, review_from),
        ),
    )


def decide(total: Sql, accept_from: float = ACCEPT_FROM, review_from: float = REVIEW_FROM) -> Sql:
    return F.when(total >= accept_from, "accept").when(total >= review_from, "review").otherwise("reject")


def _sum(terms: list[Sql]) -> Sql:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _count(conditions: list[Sql]) -> Sql:
    return _sum([c.cast("int") for c in conditions])


def _schema(present: dict[str, Sql], n_errors: Sql, n_warnings: Sql) -> Sql:
    """Share of the required keys, less 0.05 per error (0.4 at most) and 0.02 per warning (0.2 at most)."""
    base = _count([present[p] for p in SCHEMA_FIELDS]) / float(len(SCHEMA_FIELDS))
    return F.greatest(0.0, base - F.least(n_errors * 0.05, 0.4) - F.least(n_warnings * 0.02, 0.2))


def _share(filled: dict[str, Sql], fields: tuple[str, ...]) -> Sql:
    return _count([filled[p] for p in fields]) / float(len(fields))


def _text_leaf(t: Sql) -> Sql:
    return F.when((F.length(t) >= 4) & ~t.isin(*CONSTANT_TEXTS), t)


def _number_leaf(n: Sql, as_text: Sql) -> Sql:
    return F.when(~n.between(-100, 100) & ~n.isin(*CONSTANT_NUMBERS), as_text)


def _typed_leaves(finding: Sql) -> Sql:
    """Leaf texts of a cleaned finding in declared order."""
    return F.filter(F.concat(*_struct_leaves(S.FINDING_FIELDS, finding, 1)), lambda t: t.isNotNull())


def _struct_leaves(fields: dict[str, S.Field], value: Sql, depth: int) -> list[Sql]:
    """Arrays to be joined; ``depth`` is that of the fields' values."""
    out: list[Sql] = []
    if depth > LEAF_DEPTH:
        return [F.array().cast("array<string>")]
    for name, f in fields.items():
        x = value[name]
        if f.kind == "text":
            out.append(F.array(_text_leaf(x)))
        elif f.kind in ("int", "float"):
            out.append(F.array(_number_leaf(x, x.cast("string"))))
        elif f.kind == "obj":
            out += _struct_leaves(f.fields, x, depth + 1)
        elif f.kind == "chain":
            # What is above the typed levels lies deeper than leaves are read.
            for level in range(f.levels):
                out += _struct_leaves(f.fields, x, depth + 1 + level)
                x = x[S.PARENT]
        elif f.kind == "objs" and depth + 2 <= LEAF_DEPTH:
            inner = lambda e, f=f: F.concat(*_struct_leaves(f.fields, e, depth + 2))
            out.append(_flat(F.transform(x, _one(inner))))
        elif f.kind == "texts" and depth + 1 <= LEAF_DEPTH:
            out.append(F.coalesce(F.transform(x, lambda t: _text_leaf(t)), F.array()))
        elif f.kind == "map" and depth + 1 <= LEAF_DEPTH:
            out.append(_flat(F.transform(F.map_values(x), _one(lambda e: _walk(e, depth + 1)))))
    return out


def _one(fn):
    return lambda e: fn(e)


def _flat(nested: Sql) -> Sql:
    return F.coalesce(F.flatten(nested), F.array())


def _any_leaves(v: Sql) -> Sql:
    """Leaf texts of any JSON value; object keys come in the VARIANT's (sorted) order."""
    return F.filter(_walk(v, 0), lambda t: t.isNotNull())


def _source_leaves(text: Sql) -> Sql:
    """The first leaf texts of a JSON text in its own order: one pass over the tokens with the number of open brackets."""
    string = "CASE WHEN instr(t, '\\\\') = 0 THEN substr(t, 2, length(t) - 2) ELSE from_json(concat('[', t, ']'), 'array<string>')[0] END"
    number = "try_variant_get(try_parse_json(t), '$', 'string')"
    as_text, as_number = Sql(string), Sql(number)
    leaf = f"CASE WHEN startswith(t, '\"') THEN {V.let(as_text, _text_leaf)} WHEN t NOT IN ('true', 'false', 'null') THEN {V.let(as_number, lambda n: _number_leaf(n.cast('double'), n))} END"
    state = lambda depth="s.depth", out="s.out": f"named_struct('depth', {depth}, 'out', {out})"
    step = f"""CASE WHEN size(s.out) >= {LEAF_LIMIT} THEN s WHEN t IN ('{{', '[') THEN {state("s.depth + 1")} WHEN t IN ('}}', ']') THEN {state("s.depth - 1")}
        WHEN s.depth > {LEAF_DEPTH} THEN s
        ELSE {state(out=f"concat(s.out, array_compact(array({leaf})))")} END"""
    start = "named_struct('depth', 0, 'out', CAST(array() AS array<string>))"
    return Sql(f"aggregate(regexp_extract_all({text}, r'(?:{JSON_KEY}|[,:\\s])*+({JSON_TOKEN})', 1), {start}, (s, t) -> {step}, s -> s.out)")


def _walk(v: Sql, depth: int) -> Sql:
    kind = F.schema_of_variant(v)
    t = V.text(v)
    number = F.try_variant_get(v, "$", "double")
    scalar = F.when(kind == "STRING", _text_leaf(t)).when(kind != "BOOLEAN", _number_leaf(number, t))
    leaf = F.array(scalar)
    if depth == LEAF_DEPTH:
        return F.when(V.items(v).isNotNull() | F.startswith(kind, "OBJECT"), F.array().cast("array<string>")).otherwise(leaf)
    children = F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), V.items(v))
    return V.let(
        children,
        lambda c: F.when(c.isNull(), leaf).otherwise(F.flatten(F.transform(c, _one(lambda e: _walk(e, depth + 1))))),
    )


def _occurs(leaf: Sql, raw_text: Sql, parity: bool) -> Sql:
    """Whether the leaf is in the alert's compact JSON, written as it would be there.

    With ``parity`` it is looked for in ASCII-escaped JSON, so one with quotes, backslashes or other letters never occurs.
    """
    if not parity:
        written = F.to_json(F.array(leaf))
        return F.contains(raw_text, F.substr(written, 3, F.length(written) - 4))
    return leaf.rlike(r'^[\x20\x21\x23-\x5b\x5d-\x7e]*$') & F.contains(raw_text, leaf)


def normalize(df: DataFrame, raw_log: str = "raw_log", answer: str = "model_output", partitions: int | None = None, parity: bool = True) -> DataFrame:
    """Model answers to responses: extract, validate, clean, score, decide.

    ``partitions``: see ``label.map_alerts``; ``parity``: see ``score``.

    Adds ``ocsf`` (JSON text), ``confidence, decision, schema_validity, field_coverage,
    value_consistency, validation_errors`` and ``error``.
    """
    raw = V.let(
        V.parse_strict(F.col(raw_log)),
        lambda p: F.when(F.startswith(F.coalesce(F.schema_of_variant(p), ""), "OBJECT"), p).otherwise(
            F.parse_json(F.to_json(F.struct(F.col(raw_log).alias("raw"))))
        ),
    )
    read = once(deal(df, partitions), df.columns, _found=found_json(F.col(answer)), _raw=raw)
    read = read.select(*df.columns, *columns(_doc=F.col("_found.doc"), _source=F.col("_found.text")), "_raw")
    checked = validate.check_model(read, "_doc")
    scored = score(checked, "_raw", "_doc", source=F.col("_source"), parity=parity)
    doc, is_object = F.col("_doc"), V.is_object(F.col("_doc"))
    error = F.when(doc.isNull(), "JSON extraction failed").when(~is_object, "not_object")
    ok = F.col("error").isNull()
    messages = F.concat(F.col("errors"), F.col("stripped"))
    text = F.coalesce(F.to_json(F.col("cleaned")), F.to_json(doc))
    parts = ("schema_validity", "field_coverage", "value_consistency")
    return scored.select("*", *columns(error=error)).select(
        *df.columns,
        *columns(
            ocsf=F.when(ok, text),
            confidence=F.when(ok, F.col("confidence")).otherwise(0.0),
            decision=F.when(ok, F.col("decision")).otherwise("reject"),
            **{p: F.when(ok, F.col(p)) for p in parts},
            validation_errors=F.when(ok & (F.size(messages) > 0), messages),
            n_errors=F.when(ok, F.size(F.col("errors")).cast("bigint")),
            n_warnings=F.when(ok, F.size(F.col("stripped")).cast("bigint")),
        ),
        "error",
    )
