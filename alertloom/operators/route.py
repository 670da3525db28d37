"""Routing of responses: what is stored, what is reviewed and what is published.

``responses``: id, source, ocsf (JSON text or NULL), confidence, decision,
latency_ms, error, and for reviews breakdown and validation_errors (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.state import message_id

DEFAULT_ERROR = "No OCSF output produced"


def stored_decision(decision: Column) -> Column:
    """Stored name of a decision; anything unknown is a rejection."""
    return F.when(decision.isin("accept", "review", "reject"), F.upper(decision)).otherwise("REJECT")


def _json_int(key: str) -> Column:
    return F.get_json_object("ocsf", f"$.{key}").try_cast("int").alias(key)


def _digest(kind: str, batch: str) -> Column:
    """An id that is the same whenever the batch is written again."""
    return F.sha2(F.concat_ws("\u0001", F.lit(kind), F.col("id").cast("string"), *([F.lit(batch)] if batch else [])), 256)


def finding_rows(responses: DataFrame, at: Column) -> DataFrame:
    """One finding per response that has one; a raw log has one, so its id names it."""
    return responses.filter(F.col("ocsf").isNotNull()).select(
        _digest("finding", "").alias("id"),
        F.col("id").alias("raw_log_id"),
        _json_int("class_uid"),
        F.get_json_object("ocsf", "$.class_name").alias("class_name"),
        _json_int("activity_id"),
        F.get_json_object("ocsf", "$.activity_name").alias("activity_name"),
        _json_int("severity_id"),
        F.col("ocsf").alias("ocsf_json"),
        "confidence",
        stored_decision(F.col("decision")).alias("decision"),
        F.col("latency_ms").alias("processing_time"),
        at.alias("normalized_at"),
        F.lit(False).alias("published"),
        F.lit(None).cast("string").alias("message_id"),
    )


def metric_rows(responses: DataFrame, at: Column) -> DataFrame:
    return responses.select(
        F.col("id").alias("raw_log_id"),
        at.alias("timestamp"),
        "source",
        "confidence",
        stored_decision(F.col("decision")).alias("decision"),
        "latency_ms",
        (F.col("decision") == "accept").alias("success"),
    )


def status_rows(responses: DataFrame, at: Column) -> DataFrame:
    """New state of the raw logs: FAILED with the error where no finding came out."""
    found = F.col("ocsf").isNotNull()
    return responses.select(
        "id",
        F.when(found, "PROCESSED").otherwise("FAILED").alias("status"),
        at.alias("processed_at"),
        F.when(~found, F.coalesce(F.nullif("error", F.lit("")), F.lit(DEFAULT_ERROR))).alias("error_message"),
    )


def review_rows(responses: DataFrame, at: Column, batch: str = "") -> DataFrame:
    """Everything not accepted: ``review`` at normal priority, the rest high.

    One review for each result of a raw log: its id is made of the raw log's and of the ``batch`` the result came in.
    """
    queued = responses.filter(F.coalesce(F.col("decision"), F.lit("")) != "accept")
    return queued.select(
        _digest("review", batch).alias("id"),
        F.col("id").alias("raw_log_id"),
        "source",
        F.col("ocsf").alias("model_output"),
        "confidence",
        "breakdown",
        "validation_errors",
        F.when(F.col("decision") == "review", "NORMAL").otherwise("HIGH").alias("priority"),
        at.alias("queued_at"),
        F.lit(None).cast("string").alias("corrected"),
        F.lit(None).cast("string").alias("reviewed_by"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
        F.lit(False).alias("exported_for_training"),
    )


def outbox_rows(responses: DataFrame) -> DataFrame:
    """Messages of the accepted findings; the id is the same on every attempt."""
    return responses.filter(F.col("decision") == "accept").select(
        message_id(F.col("id"), F.col("ocsf")).alias("message_id"),
        F.col("id").alias("raw_log_id"),
        F.col("ocsf").alias("value"),
    )
