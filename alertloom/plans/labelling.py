"""Queries on the vendor mappings and the labelling job, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import build as B
from alertloom.functions import scalars as sc
from alertloom.functions import variants as V
from alertloom.functions.sql import F as X
from alertloom.functions.sql import Sql
from alertloom.functions.stage import once
from alertloom.operators import label, validate
from alertloom.operators.vendors import BUILT_IN
from alertloom.operators.vendors.common import Leaves, Vendor, any_of, info, metadata
from alertloom.plans import alerts
from alertloom.plans import bindings as bind
from alertloom.session import scratch
from alertloom.sources import files


def _map_query(vendor: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = alerts.alert_texts(spark, sf_dir, vendor)
        return alerts.flat(label.map_alerts(texts, as_of=bind.AS_OF_SQL, only=vendor))

    return run


def _mixed(s, d):
    return label.map_alerts(alerts.mixed_texts(s, d), as_of=bind.AS_OF_SQL)


def _dry_run(s, d):
    first = label.dry_run(label.dispatch(alerts.mixed_texts(s, d)), [F.col("id")])
    mapped = label.map_dispatched(first, as_of=bind.AS_OF_SQL)
    return mapped.select("id", "source", F.coalesce("skip_reason", F.lit("ok")).alias("outcome"))


# An element of an array file; now and then one is broken, and in every third file one is left open.
_ELEMENT = r"""CASE WHEN id % 777 = 5 THEN concat('{"id":', id, ', bad}') WHEN id % 3000 = 1500 THEN '{"open": [1'
    ELSE concat('{"_id":1,"source":"s","alert":{"id":', id, ',"t":"}],[{\\"x"}}') END"""


def _json_arrays(s, d):
    """Files of a thousand elements each, read in ranges: the elements, and which of them are broken."""
    root = scratch(s, "arrays")
    rows = once(bind.view(s, d, bind.EVENT), ["id"], element=Sql(_ELEMENT)).withColumn("part", F.floor(F.col("id") / 1000))
    listed = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("id", "element"))).alias("l"))
    # A row is a file; all lie in one folder, so that listing them takes no job.
    listed.select(F.concat(F.lit("[\n"), F.array_join("l.element", ",\n"), F.lit("\n]")).alias("value")).write.option("maxRecordsPerFile", 1).text(root)
    read = files.read_json_array(s, root)
    return read.select(F.when(~F.col("bad_json"), F.get_json_object("raw_log", "$.alert.id").cast("bigint")).alias("id"), "bad_json", F.contains("raw_log", F.lit('"_id"')).alias("with_id"))


def _alert_lines(s, d):
    """Alert lines with broken and blank ones between them, as a file would hold them, read back."""
    root = scratch(s, "lines")
    line = r"""CASE WHEN id % 10 = 3 THEN concat('{"id":', id, ',}') WHEN id % 10 = 6 THEN '  ' WHEN id % 10 = 7 THEN concat('{"id":', id, '} x')
        ELSE concat(' {"_id":{"$oid":"x"},"source":"', ty, '","alert":{"id":', id, '}}') END"""
    once(bind.view(s, d, bind.EVENT), ["id"], value=Sql(line)).select("value").write.text(root)
    read = files.read_jsonl(s, root)
    return read.select(F.when(~F.col("bad_json"), F.get_json_object("raw_log", "$.alert.id").cast("bigint")).alias("id"), "bad_json", F.contains("raw_log", F.lit('"_id"')).alias("with_id"))


def _pair_files(s, d):
    """Labelled pairs written as lines and read back, with lines that are no JSON among them."""
    root = scratch(s, "pairs")
    rows = bind.view(s, d, bind.EVENT).selectExpr("concat('p', id) AS id", "ty AS source", "props AS raw_log", "concat('{\"class_uid\":2004,\"n\":[', k, ',null]}') AS ocsf")
    files.write_pairs(rows, f"{root}/good")
    bind.view(s, d, bind.EVENT).filter("id % 50 = 0").selectExpr("concat('{cut ', id) AS value").write.text(f"{root}/bad")
    return files.read_pairs(s, f"{root}/*")


def _acme_leaves(a: Sql) -> dict[str, Sql]:
    return {"title": V.truthy(a, "headline"), "uid": V.truthy(a, "key"), "time": sc.time_text(a, "when"), "level": V.text(a, "level"), "bad_type": any_of(V.truthy_not_text(a, "level"))}


def _acme_build(x: Leaves) -> dict[str, Sql]:
    return {"finding_info": info(x), "metadata": metadata("Acme Watch", "Acme"), "time": x.time, "severity_id": X.when(x.level == "bad", 4).otherwise(2), "unmapped": B.free_map(level=x.level)}


ACME = Vendor("acme", _acme_leaves, _acme_build, aliases=("acme-watch",))


def _custom_vendor(s, d):
    """A vendor of the user's own beside the built-in ones, under its name and an alias."""
    text = """to_json(named_struct('source', CASE id % 3 WHEN 0 THEN 'acme' WHEN 1 THEN 'Acme-Watch' ELSE 'acme watch' END, 'alert', named_struct('headline', CASE WHEN id % 5 > 0 THEN concat('h', k) END,
        'key', id, 'when', concat(iso, 'Z'), 'level', CASE id % 4 WHEN 0 THEN 'bad' WHEN 1 THEN 'fine' END)))"""
    rows = once(bind.dealt(s, d, bind.EVENT), ["id"], raw_log=Sql(text))
    mapped = label.map_alerts(rows, as_of=bind.AS_OF_SQL, vendors=(*BUILT_IN, ACME))
    f = "finding"
    return mapped.selectExpr("id", "vendor", "skip_reason", f"{f}.finding_info.title AS title", f"{f}.finding_info.uid AS uid", f"{f}.severity_id AS severity_id",
                             f"{f}.time AS event_time", f"{f}.metadata.product.name AS product", f"to_json({f}.unmapped) AS unmapped")


def _label_valid(s, d):
    """The label check on mapped findings."""
    mapped = _mixed(s, d).filter("skip_reason IS NULL").select("id", F.to_json("finding").alias("ocsf"))
    return validate.check_labels(mapped).select("id", F.array_join("errors", ";").alias("errors"))


def _null_paths(s, d):
    """Empty values at various depths, with their paths."""
    core = """'{"x":null,"y":[1,{}],"z":""}'"""
    text = f"""concat('{{"m":', repeat('[{{"k":', id % 20), {core}, repeat('}}]', id % 20), '}}')"""
    made = once(bind.dealt(s, d, bind.EVENT), ["id"], v=Sql(f"parse_json({text})"))
    return once(made, ["id"], found=X.concat_ws(";", validate.empty_fields(X.col("v"))))


QUERIES = {
    **{f"map_{v}": _map_query(v) for v in alerts.ALERTS},
    "label_all": lambda s, d: alerts.flat(_mixed(s, d)),
    "label_summary": lambda s, d: label.label_summary(_mixed(s, d)),
    "label_dry_run": _dry_run,
    "label_valid": _label_valid,
    "custom_vendor": _custom_vendor,
    "null_paths": _null_paths,
    "read_json_arrays": _json_arrays,
    "read_alert_lines": _alert_lines,
    "pair_files": _pair_files,
    "label_ids": lambda s, d: label.labelled_pairs(
        _mixed(s, d), "id", scratch(s, "pairs"), keep_order=True
    ).select(F.col("id").alias("label_id"), F.col("ord").alias("id"), "source"),
}

_SOURCES = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(alerts.MIX) if n)
_REASONS = " ".join(
    f"WHEN {i} THEN {alerts.EXPECTED[n]['skip_reason'] if n in alerts.EXPECTED else repr('unknown_source' if n else 'missing_source')}"
    for i, n in enumerate(alerts.MIX)
)
_MIX = f"""{bind.duck('e', bind.EVENT)}, x AS (SELECT id, CASE id % {len(alerts.MIX)} {_SOURCES} END AS source,
    CASE id % {len(alerts.MIX)} {_REASONS} END AS reason FROM e)"""

ORACLES = {
    **{f"map_{v}": alerts.expected(v) for v in alerts.ALERTS},
    "label_all": alerts.expected_mix(),
    "label_summary": f"""WITH {_MIX} SELECT coalesce(source, '_unknown') AS source,
        sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) AS labeled, sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) AS skipped FROM x GROUP BY 1""",
    "label_dry_run": f"""WITH {_MIX} SELECT id, source, coalesce(reason, 'ok') AS outcome FROM x WHERE source <> 'acme'
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 3""",
    "label_valid": f"WITH {_MIX} SELECT id, '' AS errors FROM x WHERE reason IS NULL",
    "custom_vendor": f"""WITH {bind.duck('e', bind.EVENT)}, a AS (SELECT *, CASE WHEN id % 3 = 2 THEN 'unknown_source' WHEN id % 5 = 0 THEN 'missing_required' END AS reason FROM e)
        SELECT id, CASE WHEN id % 3 < 2 THEN 'acme' END AS vendor, reason AS skip_reason, CASE WHEN reason IS NULL THEN concat('h', cast(k AS varchar)) END AS title,
        CASE WHEN reason IS NULL THEN cast(id AS varchar) END AS uid, CASE WHEN reason IS NULL THEN CASE WHEN id % 4 = 0 THEN 4 ELSE 2 END END AS severity_id,
        CASE WHEN reason IS NULL THEN concat(iso, 'Z') END AS event_time, CASE WHEN reason IS NULL THEN 'Acme Watch' END AS product,
        CASE WHEN reason IS NULL AND id % 4 < 2 THEN concat('{{"level":"', CASE WHEN id % 4 = 0 THEN 'bad' ELSE 'fine' END, '"}}') END AS unmapped FROM a""",
    "null_paths": f"""WITH {bind.duck('e', bind.EVENT)}, p AS (SELECT id, concat('m', repeat('[0].k', cast(id % 20 AS integer))) AS p FROM e)
        SELECT id, concat('Null/empty field found: ', p, '.x;Null/empty item found: ', p, '.y[1];Null/empty field found: ', p, '.z') AS found FROM p""",
    "read_json_arrays": f"""WITH {bind.duck('e', bind.EVENT)}, b AS (SELECT id, id % 777 = 5 OR id % 3000 = 1500 AS bad FROM e)
        SELECT CASE WHEN NOT bad THEN id END AS id, bad AS bad_json, false AS with_id FROM b""",
    "read_alert_lines": f"""WITH {bind.duck('e', bind.EVENT)} SELECT CASE WHEN id % 10 IN (3, 7) THEN NULL ELSE id END AS id, id % 10 IN (3, 7) AS bad_json, false AS with_id FROM e WHERE id % 10 <> 6""",
    "pair_files": f"""WITH {bind.duck('e', bind.EVENT)} SELECT concat('p', cast(id AS varchar)) AS id, ty AS source, replace(props, ': ', ':') AS raw_log,
        concat('{{"class_uid":2004,"n":[', cast(k AS varchar), ',null]}}') AS ocsf, false AS bad_json FROM e UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM e WHERE id % 50 = 0""",
    "label_ids": f"""WITH {_MIX} SELECT id, source, concat('label_', CASE WHEN n < 10000 THEN lpad(cast(n AS varchar), 4, '0') ELSE cast(n AS varchar) END) AS label_id
        FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM x WHERE reason IS NULL) y""",
}
