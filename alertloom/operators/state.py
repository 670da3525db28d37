"""Rows that change: work queues, corrections and current state on append-only tables.

Nothing is updated in place.  A change is a new row with a higher version, and
``latest`` gives the current one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STUCK_MINUTES = 10
DEFAULT_BATCH = 10
PUBLISHABLE = ("ACCEPT", "CORRECTED")


def latest(log: DataFrame, key: str, version: str) -> DataFrame:
    """Current row per key; versions of a key are distinct.

    Only key and version are aggregated, by hash and before the shuffle; the rows
    themselves are met once, in the join with the winners.
    """
    return _winners(log, key, F.max(version), version)


def _winners(rows: DataFrame, key: str, best: Column, order: str) -> DataFrame:
    chosen = rows.groupBy(F.col(key).alias("_key")).agg(best.alias("_best"))
    return rows.join(chosen, F.col(key).eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_best")), "left_semi")


def reprocess_candidates(raw_logs: DataFrame, as_of: Column, limit: int | None = DEFAULT_BATCH) -> DataFrame:
    """PENDING rows, and IN_PROGRESS ones received over ten minutes ago; oldest first."""
    stuck = (F.col("status") == "IN_PROGRESS") & (
        F.col("received_at") < as_of - F.expr(f"INTERVAL {STUCK_MINUTES} MINUTES")
    )
    due = raw_logs.filter((F.col("status") == "PENDING") | stuck)
    return due if limit is None else due.orderBy("received_at", "id").limit(limit)


def claim(raw_logs: DataFrame, claimed: DataFrame, status: str = "IN_PROGRESS", key: str = "id") -> DataFrame:
    """State rows that set ``status`` on the claimed ids; handing back is the same with PENDING."""
    return raw_logs.join(claimed.select(key), key, "left_semi").withColumn("status", F.lit(status))


def apply_claim(raw_logs: DataFrame, claimed: DataFrame, status: str = "IN_PROGRESS", key: str = "id") -> DataFrame:
    """All rows, the claimed ones with the new status."""
    mark = claimed.select(key).distinct().withColumn("_claimed", F.lit(True))
    return raw_logs.join(mark, key, "left").withColumn(
        "status", F.when(F.col("_claimed"), status).otherwise(F.col("status"))
    ).drop("_claimed")


def retry_candidates(findings: DataFrame, limit: int | None = DEFAULT_BATCH) -> DataFrame:
    """Unpublished findings that should have been published."""
    due = findings.filter(~F.col("published") & F.col("decision").isin(*PUBLISHABLE))
    return due if limit is None else due.orderBy("normalized_at", "id").limit(limit)


def message_id(raw_log_id: Column, payload: Column) -> Column:
    """Deterministic, so that publishing again gives the same id."""
    return F.sha2(F.concat_ws("\u0001", raw_log_id.cast("string"), payload), 256)


def outbox(findings: DataFrame, payload: Column, delivered: DataFrame | None = None) -> DataFrame:
    """Messages to send: ``message_id, raw_log_id, value``, without those already delivered."""
    rows = findings.select("raw_log_id", payload.alias("value")).withColumn(
        "message_id", message_id(F.col("raw_log_id"), F.col("value"))
    )
    return rows if delivered is None else rows.join(delivered.select("message_id"), "message_id", "left_anti")


def correction_gate(corrections: DataFrame, reviews: DataFrame, valid: Column, order: str = "submitted", table: str | None = None) -> DataFrame:
    """Corrections with ``reject_reason`` (NULL when accepted), first failure only.

    ``corrections``: review_id, corrected (JSON text), reviewer and ``order``, in which
    they came.  ``valid`` says whether the corrected finding passes the model
    schema.  Of several good corrections of a review the first is accepted.  The corrections are used
    twice; where ``valid`` is costly, ``table``, a new folder all executors see, keeps them between.
    """
    known = reviews.select(
        F.col("id").alias("review_id"), "raw_log_id", F.col("reviewed_at"), F.lit(True).alias("_known")
    )
    joined = corrections.join(known, "review_id", "left")
    reason = (
        F.when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "blank_reviewer")
        .when(F.try_parse_json("corrected").isNull(), "bad_json")
        .when(~F.coalesce(valid, F.lit(False)), "invalid")
        .when(F.col("_known").isNull(), "not_found")
        .when(F.col("reviewed_at").isNotNull(), "already_reviewed")
    )
    tested = joined.withColumn("reject_reason", reason).drop("_known")
    if table is not None:
        tested.write.mode("errorifexists").parquet(table)
        tested = corrections.sparkSession.read.schema(tested.schema).parquet(table)
    first = tested.filter(F.col("reject_reason").isNull()).groupBy("review_id").agg(F.min(order).alias("_first"))
    late = F.col("reject_reason").isNull() & (F.col(order) > F.col("_first"))
    return tested.join(first, "review_id", "left").withColumn(
        "reject_reason", F.when(late, "already_reviewed").otherwise(F.col("reject_reason"))
    ).drop("_first")


def last_corrections(accepted: DataFrame, order: str = "submitted") -> DataFrame:
    """One accepted correction per raw log, the last; reviews of one raw log may be several."""
    return _winners(accepted, "raw_log_id", F.max(order), order)


def upsert_corrections(findings: DataFrame, corrections: DataFrame, at: Column) -> DataFrame:
    """Findings after corrections (at most one per raw log), with all their columns.

    An existing row takes the corrected JSON, confidence 1 and decision CORRECTED and
    goes back to unpublished, without message id; its other columns stay as they were.
    A new row takes class, activity and severity from the correction, processing time 0 and ``at``.
    """
    new = corrections.select("raw_log_id", F.col("corrected").alias("_json"), F.lit(True).alias("_hit"))
    merged = findings.withColumn("_old", F.lit(True)).join(new, "raw_log_id", "full_outer")
    types = {f.name: f.dataType for f in findings.schema}
    part = lambda k: F.get_json_object("_json", f"$.{k}")
    changed = {"ocsf_json": F.col("_json"), "confidence": F.lit(1.0), "decision": F.lit("CORRECTED"), "published": F.lit(False), "message_id": F.lit(None)}
    inserted = {k: part(k) for k in ("class_uid", "class_name", "activity_id", "activity_name", "severity_id")}
    inserted |= {"processing_time": F.lit(0), "normalized_at": at}
    columns = []
    for name in findings.columns:
        kept = F.col(name)
        if name in changed:
            kept = F.when(F.col("_hit"), changed[name].cast(types[name])).otherwise(kept)
        elif name in inserted:
            kept = F.when(F.col("_old"), kept).otherwise(inserted[name].cast(types[name]))
        columns.append(kept.alias(name))
    return merged.select(columns)


def reviewed(reviews: DataFrame, accepted: DataFrame, at: Column) -> DataFrame:
    """All reviews, those with an accepted correction closed: ``corrected, reviewed_by, reviewed_at`` set."""
    given = accepted.select(F.col("review_id").alias("id"), F.col("corrected").alias("_corrected"), F.col("reviewer").alias("_reviewer"))
    joined = reviews.join(given, "id", "left")
    hit = F.col("_corrected").isNotNull()
    kept = lambda name: F.col(name) if name in reviews.columns else F.lit(None).cast("string")
    return joined.withColumns({
        "corrected": F.when(hit, F.col("_corrected")).otherwise(kept("corrected")),
        "reviewed_by": F.when(hit, F.col("_reviewer")).otherwise(kept("reviewed_by")),
        "reviewed_at": F.when(hit, at).otherwise(F.col("reviewed_at")),
    }).drop("_corrected", "_reviewer")


def processed(raw_logs: DataFrame, accepted: DataFrame, at: Column) -> DataFrame:
    """All raw logs, the corrected ones PROCESSED at ``at``."""
    mark = accepted.select(F.col("raw_log_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    joined = raw_logs.join(mark, "id", "left")
    before = F.col("processed_at") if "processed_at" in raw_logs.columns else F.lit(None).cast("timestamp")
    return joined.withColumns({
        "status": F.when(F.col("_hit"), "PROCESSED").otherwise(F.col("status")),
        "processed_at": F.when(F.col("_hit"), at).otherwise(before),
    }).drop("_hit")


def mark_exported(reviews: DataFrame, exported: DataFrame) -> DataFrame:
    """All reviews, those in ``exported`` (id) flagged as taken into training data."""
    mark = exported.select("id").distinct().withColumn("_hit", F.lit(True))
    return reviews.join(mark, "id", "left").withColumn(
        "exported_for_training", F.coalesce("_hit", F.col("exported_for_training"))
    ).drop("_hit")


def orphans(rows: DataFrame, raw_logs: DataFrame) -> DataFrame:
    """Rows whose raw log does not exist."""
    return rows.join(raw_logs.select(F.col("id").alias("raw_log_id")), "raw_log_id", "left_anti")


def first_per_raw_log(findings: DataFrame, order: str, existing: DataFrame | None = None) -> DataFrame:
    """The first result per raw log wins, also over one that is already stored; ``order`` differs between a raw log's results."""
    kept = _winners(findings, "raw_log_id", F.min(order), order)
    return kept if existing is None else kept.join(existing.select("raw_log_id"), "raw_log_id", "left_anti")
