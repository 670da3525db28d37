"""Labelling: raw records -> findings, with skip reasons, label ids and summaries.

One pass over the input.  Each record's JSON is parsed once; the vendor decides
which leaf struct is filled, and the finding is built from that struct.  There
is no shuffle and no scan per vendor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions import build as B
from alertloom.functions import scalars as sc
from alertloom.functions import variants as V
from alertloom.functions.sql import F as X
from alertloom.functions.sql import Sql, columns
from alertloom.functions.stage import deal, once
from alertloom.functions.text import MAY_HOLD_EMPTIES, strip, without_empties
from alertloom.operators.vendors import BUILT_IN, registry
from alertloom.operators.vendors.common import Leaves, Vendor, finding

DRY_RUN_LIMIT = 3
UNKNOWN_SOURCE = "_unknown"
NOW = "current_timestamp()"


def dispatch(df: DataFrame, raw_log: str = "raw_log", vendors: tuple[Vendor, ...] = BUILT_IN) -> DataFrame:
    """Adds ``source`` (cleaned, NULL when missing), ``vendor`` (NULL when unlisted), ``alert``, ``bad_json``."""
    keep = [c for c in df.columns if c != "source"]
    raw = V.Doc("_raw", "_record")
    source, alert = V.get(raw, "source"), V.get(raw, "alert")
    named = (
        df.withColumn("_raw", V.parse(X.col(raw_log)).column())
        .select(*keep, "_raw", *columns(_record=raw.opened()))
        .select(*keep, "_raw", "_record", *columns(source=B.some_text(strip(X.lower(V.truthy(source))))))
    )
    return once(
        named,
        keep,
        source=X.col("source"),
        vendor=sc.lookup(registry(vendors), X.col("source")),
        alert=alert,
        bad_json=X.col("_raw").isNull(),
    )


def map_alerts(
    df: DataFrame,
    as_of: str = NOW,
    raw_log: str = "raw_log",
    vendors: tuple[Vendor, ...] = BUILT_IN,
    only: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``source, vendor, skip_reason, finding, time_defaulted``.

    ``finding`` is NULL exactly when ``skip_reason`` is set: ``bad_json``,
    ``missing_source``, ``unknown_source``, ``missing_required`` or ``bad_type``.
    ``only`` maps the alerts of one vendor and leaves the others out.  ``as_of``
    is the SQL timestamp used for a finding whose time cannot be read.  Mapping takes most of a millisecond an alert, so a
    table of few large splits is better dealt into ``partitions``: then the raw texts are shuffled, whatever their number.
    """
    routed = dispatch(deal(df, partitions), raw_log, vendors)
    if only is not None:
        routed = routed.filter(F.col("vendor") == only)
    return map_dispatched(routed, as_of, tuple(v for v in vendors if only in (None, v.name)))


def map_dispatched(routed: DataFrame, as_of: str = NOW, vendors: tuple[Vendor, ...] = BUILT_IN) -> DataFrame:
    """``map_alerts`` for records that went through ``dispatch``."""
    keep = [c for c in routed.columns if c not in ("alert", "bad_json")]
    docs = {v: V.Doc("alert", f"_doc_{v.name}") for v in vendors}
    leaves = {f"_{v.name}": _leaf_struct(v, doc) for v, doc in docs.items()}
    read = once(B.with_nils(_open(routed, docs)), [*keep, "bad_json"], **leaves)
    now = Sql(as_of)
    by_vendor = {v: Leaves(X.col(f"_{v.name}"), now) for v in vendors}
    reason = (
        X.when(X.col("bad_json"), "bad_json")
        .when(X.col("source").isNull(), "missing_source")
        .when(X.col("vendor").isNull(), "unknown_source")
        .when(_case({v: _missing(v, x) for v, x in by_vendor.items()}), "missing_required")
        .when(_case({v: x.bad_type for v, x in by_vendor.items()}), "bad_type")
    )
    parts = {v: v.build(x) for v, x in by_vendor.items()}
    raw = {v: p.pop("observables") for v, p in parts.items() if "observables" in p}
    observed = _case(raw) if raw else X.lit(None).cast("array<struct<name:string,type:string,value:string>>")
    reasoned = B.with_nils(
        read.select("*", *columns(skip_reason=reason, _observed=observed))
    )
    ok = X.col("skip_reason").isNull()
    by_value = X.col("vendor").isin(*[v.name for v in vendors if v.distinct_values] or [""])
    observables = sc.observables(X.col("_observed"), by_value)
    for v in raw:
        parts[v]["observables"] = observables
    mapped = once(
        reasoned,
        [*keep, "skip_reason"],
        finding=X.when(ok, _case({v: finding(parts[v], now) for v in vendors})),
        time_defaulted=X.when(
            ok, _case({v: sc.parse_time(parts[v]["time"]).isNull() for v in vendors})
        ),
    )
    return mapped.withColumn("finding", _without_empties())


def _without_empties() -> Column:
    """The finding; empty values inside the raw values of ``unmapped``, where there are any, are taken out."""
    text = "to_json(finding.unmapped)"
    kept = V.let(without_empties(Sql(text)), lambda t: X.when(t != "{}", X.try_variant_get(X.parse_json(t), "$", "map<string,variant>"))).column()
    holds = F.coalesce(F.expr(text).rlike(MAY_HOLD_EMPTIES), F.lit(False))
    return F.when(holds, F.col("finding").withField("unmapped", kept)).otherwise(F.col("finding"))


def _open(routed: DataFrame, docs: dict[Vendor, V.Doc]) -> DataFrame:
    """The wanted keys of each alert as struct columns, one projection per nesting level."""
    levels: dict[int, dict[str, Sql]] = {}
    for vendor, doc in docs.items():
        for d in doc.tree():
            value = d.opened()
            if d.level == 0:
                value = X.when(X.col("vendor") == vendor.name, value)
            levels.setdefault(d.level, {})[d.alias_] = value
    for level in sorted(levels):
        routed = routed.select("*", *columns(**levels[level]))
    return routed


def _leaf_struct(vendor: Vendor, alert: V.Doc) -> Sql:
    fields = vendor.leaves(alert)
    return X.when(
        X.col("vendor") == vendor.name, X.struct(*[c.alias(n) for n, c in fields.items()])
    )


def _missing(vendor: Vendor, x: Leaves) -> Sql:
    first, second = vendor.required
    return getattr(x, first).isNull() | getattr(x, second).isNull()


def _case(branches: dict[Vendor, Sql]) -> Sql:
    chained = None
    for vendor, value in branches.items():
        hit = X.col("vendor") == vendor.name
        chained = X.when(hit, value) if chained is None else chained.when(hit, value)
    return chained


def label_summary(mapped: DataFrame) -> DataFrame:
    """Labelled and skipped counts per source; records without one are ``_unknown``."""
    ok = F.col("skip_reason").isNull().cast("long")
    return (
        mapped.groupBy(F.coalesce("source", F.lit(UNKNOWN_SOURCE)).alias("source"))
        .agg(F.sum(ok).alias("labeled"), F.sum(1 - ok).alias("skipped"))
    )


def dry_run(df: DataFrame, order: list[Column], limit: int = DRY_RUN_LIMIT) -> DataFrame:
    """First ``limit`` records of each listed source, counted before mapping.

    Spark keeps only ``limit`` rows per source and task ahead of the shuffle
    (window group limit), so a source holding most rows does not become one big group.
    """
    ranked = df.filter(F.col("vendor").isNotNull()).withColumn(
        "_rank", F.row_number().over(W.partitionBy("source").orderBy(*order))
    )
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def with_ordinal(df: DataFrame, order: str, table: str, name: str = "ordinal") -> DataFrame:
    """1-based position of each row by the unique column ``order``.

    Rows are written to ``table`` once, then dealt into ranges of about equal size, however the values of ``order``
    lie, and written with their range to ``table``, a new folder all executors see: from
    then on ranges are fixed, and a recomputed task gives the same positions.  A row's
    position is its place in its range plus the rows of the ranges before; only
    one count per range meets in a single task.
    """
    # Ranges are found by a look at all rows ahead of dealing them: what computes the rows would run twice.
    df.write.mode("errorifexists").parquet(f"{table}/given")
    made = df.sparkSession.read.schema(df.schema).parquet(f"{table}/given")
    dealt = made.repartitionByRange(order).withColumn("_slice", F.spark_partition_id())
    dealt.write.mode("errorifexists").parquet(f"{table}/dealt")
    sliced = df.sparkSession.read.schema(dealt.schema).parquet(f"{table}/dealt")
    counts = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = sliced.withColumn("_place", F.row_number().over(W.partitionBy("_slice").orderBy(order)))
    return (
        placed.join(before, "_slice")
        .withColumn(name, F.col("_place") + F.col("_before"))
        .drop("_slice", "_place", "_before")
    )


def label_id(ordinal: Column) -> Column:
    return F.format_string("label_%04d", ordinal)


def labelled_pairs(mapped: DataFrame, order: str, table: str, raw_log: str = "raw_log", keep_order: bool = False) -> DataFrame:
    """``id, source, raw_log, ocsf`` of the records that were mapped, ids by ``order``.

    ``table`` is a new folder all executors see; the mapped pairs are written there once (see ``with_ordinal``).
    ``keep_order`` also gives the ordering column, as ``ord``.
    """
    pairs = mapped.filter(F.col("skip_reason").isNull()).select(
        F.col(order).alias("ord"), "source", F.col(raw_log).alias("raw_log"), F.to_json("finding").alias("ocsf")
    )
    extra = ["ord"] if keep_order else []
    return with_ordinal(pairs, "ord", table).select(
        label_id(F.col("ordinal")).alias("id"), *extra, "source", "raw_log", "ocsf"
    )
