"""Ingest and request contracts: good rows keep a NULL ``reject_reason``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import schemas as S
from alertloom.functions.sql import F as X
from alertloom.functions.text import strip

SOURCE_PATTERN = r"^[a-z0-9][a-z0-9\-]*[a-z0-9]$|^[a-z0-9]$"
SINGLE_KEYS = ("source", "rawContent")
BATCH_KEYS = ("source", "alerts")


def check_single(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``source, raw_content, reject_reason`` for bodies ``{source, rawContent}``."""
    return _check(bodies, body, SINGLE_KEYS, "rawContent", "OBJECT").withColumnRenamed("_content", "raw_content")


def check_batch(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``source, alerts, reject_reason`` for bodies ``{source, alerts: [...]}``."""
    return _check(bodies, body, BATCH_KEYS, "alerts", "ARRAY").withColumnRenamed("_content", "alerts")


def _check(bodies: DataFrame, body: str, keys: tuple[str, ...], content: str, kind: str) -> DataFrame:
    read = bodies.withColumn("_v", F.try_parse_json(body)).select(
        *bodies.columns,
        F.try_variant_get("_v", "$", f"struct<source:variant,{content}:variant>").alias("_o"),
        F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>")).alias("_keys"),
    )
    source, value = F.col("_o.source"), F.col(f"_o.{content}")
    shape = F.schema_of_variant(value)
    empty = F.try_variant_get(value, "$", "string").isin("{}", "[]")
    reason = (
        F.when(F.col("_keys").isNull(), "not_an_object")
        .when(F.size(F.array_except("_keys", F.array(*map(F.lit, keys)))) > 0, "unknown_key")
        .when(F.coalesce(F.schema_of_variant(source) != "STRING", F.lit(True)), "bad_source")
        .when(F.try_variant_get(source, "$", "string") == "", "bad_source")
        .when(~F.coalesce(F.startswith(shape, F.lit(kind)), F.lit(False)) | empty, "bad_content")
    )
    return read.select(
        *bodies.columns,
        F.try_variant_get(source, "$", "string").alias("source"),
        value.alias("_content"),
        reason.alias("reject_reason"),
    )


def explode_batch(checked: DataFrame) -> DataFrame:
    """One row per alert of the accepted batches, with its position in the batch."""
    good = checked.filter(F.col("reject_reason").isNull())
    alerts = F.posexplode(F.try_variant_get("alerts", "$", "array<variant>"))
    keep = [c for c in good.columns if c not in ("alerts", "reject_reason")]
    return good.select(*keep, alerts.alias("position", "_alert")).select(
        *keep, "position", F.to_json("_alert").alias("raw_content")
    )


def new_raw_logs(rows: DataFrame, received_at: Column, key: Column) -> DataFrame:
    """Accepted rows as PENDING raw logs.

    ``key`` tells deliveries of the same content apart (a batch and position, say); the id is
    a digest of it and the content, so a recomputed task and a repeated run give the same ids.
    """
    return rows.select(
        F.sha2(F.concat_ws("\u0001", key.cast("string"), "source", "raw_content"), 256).alias("id"),
        "source",
        F.lit(None).cast("string").alias("format"),
        "raw_content",
        received_at.alias("received_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
        F.lit("PENDING").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def check_request(requests: DataFrame) -> DataFrame:
    """Cleans ``raw_log, source, format`` and adds ``reject_reason``; a NULL format is ``unknown``."""
    cleaned = requests.withColumns(
        {
            "raw_log": strip(X.col("raw_log")).column(),
            "source": X.lower(strip(X.col("source"))).column(),
            "format": X.lower(strip(X.coalesce(X.col("format"), "unknown"))).column(),
        }
    )
    reason = (
        F.when(F.coalesce("raw_log", F.lit("")) == "", "empty_raw_log")
        .when(F.coalesce("source", F.lit("")) == "", "empty_source")
        .when(~F.col("source").rlike(SOURCE_PATTERN), "unsafe_source")
        .when(~F.col("format").isin(*S.LOG_FORMATS), "unknown_format")
    )
    return cleaned.withColumn("reject_reason", reason)


def build_request(raw_logs: DataFrame) -> DataFrame:
    """Request of a stored raw log; the format defaults to json."""
    return raw_logs.select(
        "id",
        F.col("raw_content").alias("raw_log"),
        "source",
        F.coalesce(F.nullif("format", F.lit("")), F.lit("json")).alias("format"),
    )
