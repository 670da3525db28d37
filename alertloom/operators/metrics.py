"""Operational metrics and review-queue reports over the metric and review tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_DAYS = 7
MOST_ASKED = 2_000
DEFAULT_LIMIT = 20


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def overview(metrics: DataFrame) -> DataFrame:
    """Totals in one pass; everything that is not a success counts as review."""
    total, good = F.count(F.lit(1)), F.sum(F.col("success").cast("long"))
    sums = metrics.agg(
        total.alias("total_logs"),
        _or_zero(F.avg("confidence")).alias("avg_confidence"),
        _or_zero(F.avg("latency_ms")).alias("avg_latency_ms"),
        F.coalesce(good, F.lit(0)).alias("_good"),
    )
    n = F.col("total_logs")
    return sums.select(
        "total_logs",
        "avg_confidence",
        "avg_latency_ms",
        _percent(F.col("_good"), n).alias("success_rate"),
        _percent(n - F.col("_good"), n).alias("review_rate"),
    )


def by_source(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("source").agg(
        F.count(F.lit(1)).alias("count"),
        _or_zero(F.avg("confidence")).alias("avg_confidence"),
        _or_zero(F.avg("latency_ms")).alias("avg_latency_ms"),
    )


def by_decision(metrics: DataFrame) -> DataFrame:
    """Count and share per decision, a missing decision being a group of its own.

    The window runs over the grouped rows, at most one per decision.
    """
    counts = metrics.groupBy("decision").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(W.partitionBy())
    return counts.select("decision", "count", _percent(F.col("count"), total).alias("percentage"))


def timeline(metrics: DataFrame, as_of: Column, days: int = DEFAULT_DAYS, ts: str = "ts") -> DataFrame:
    """Per hour of the last ``days`` days, oldest first."""
    recent = metrics.filter(F.col(ts) > as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    return (
        recent.groupBy(F.date_trunc("hour", ts).alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            _or_zero(F.avg("confidence")).alias("avg_confidence"),
            F.coalesce(F.round(F.avg("latency_ms")).cast("int"), F.lit(0)).alias("avg_latency_ms"),
        )
        .orderBy("bucket")
    )


def timeline_labels(buckets: DataFrame) -> DataFrame:
    """Day label of each timeline bucket, as charts print it."""
    return buckets.withColumn("day", F.date_format("bucket", "MMM d"))


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, floored."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(60_000_000))


def review_queue(reviews: DataFrame, as_of: Column) -> DataFrame:
    """Pending reviews: how many, the oldest, and its age in whole minutes (0 when none)."""
    waiting = pending(reviews).agg(
        F.count(F.lit(1)).alias("pending_count"), F.min("queued_at").alias("oldest_queued_at")
    )
    age = minutes_between(F.col("oldest_queued_at"), as_of)
    return waiting.withColumn("oldest_minutes", F.coalesce(age, F.lit(0)))


def pending(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("reviewed_at").isNull())


def priority_rank(priority: Column) -> Column:
    """HIGH above NORMAL; sorting the texts would put NORMAL first."""
    return F.when(priority == "HIGH", 1).otherwise(0)


def pending_top(reviews: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Next reviews to look at: HIGH first, then lowest confidence; ties by id."""
    return (
        pending(reviews)
        .orderBy(priority_rank(F.col("priority")).desc(), F.col("confidence").asc(), F.col("id").asc())
        .limit(limit)
    )


def pending_with_raw(reviews: DataFrame, raw_logs: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``pending_top`` of the reviews whose raw log exists, with the raw log.

    The top rows are taken first and their raw logs looked up by id; while too few of them exist, twice as many rows are taken.
    Ids of at most ``MOST_ASKED`` rows reach the driver; from there on reviews without raw log are left out by a join.
    """
    raw = raw_logs.select(F.col("id").alias("raw_log_id"), "raw_content", "received_at")
    asked = 2 * limit
    while asked <= MOST_ASKED:
        top = pending_top(reviews, asked)
        ids = [r.raw_log_id for r in top.select("raw_log_id").collect()]
        found = raw.filter(F.col("raw_log_id").isin(list(set(ids)))) if ids else raw.limit(0)
        live = {r.raw_log_id for r in found.select("raw_log_id").collect()}
        if len(ids) < asked or sum(i in live for i in ids) >= limit:
            return found.join(pending_top(top.filter(F.col("raw_log_id").isin(list(live))), limit) if live else top.limit(0), "raw_log_id")
        asked *= 2
    top = pending_top(reviews.join(raw.select("raw_log_id"), "raw_log_id", "left_semi"), limit)
    return raw.join(top, "raw_log_id")


def with_priority(reviews: DataFrame, priority: str) -> DataFrame:
    return pending(reviews).filter(F.col("priority") == priority)


def sources_by_confidence(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.col("avg_confidence").desc(), "source")


def sources_by_latency(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.col("avg_latency_ms").asc(), "source")


def health_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "Healthy").otherwise("Low")


def source_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.88, "green").when(confidence >= 0.83, "teal").otherwise("amber")


def review_band(confidence: Column) -> Column:
    return F.when(confidence < 0.6, "red").when(confidence < 0.85, "amber").otherwise("green")


def time_ago(start: Column, as_of: Column) -> Column:
    mins = minutes_between(start, as_of)
    hours = F.floor(mins / 60)
    return (
        F.when(mins < 1, "just now")
        .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def format_minutes(mins: Column) -> Column:
    hours = F.concat(F.floor(mins / 60).cast("string"), F.lit("h "), (mins % 60).cast("string"), F.lit("m"))
    return (
        F.when(mins.isNull() | (mins == 0), "none")
        .when(mins < 60, F.concat(mins.cast("string"), F.lit("m")))
        .otherwise(hours)
    )


def alert_title(finding_json: Column) -> Column:
    """Title of a finding's JSON text, with the default shown when there is none."""
    title = F.get_json_object(finding_json, "$.finding_info.title")
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Unknown alert"))


def presented(sources: DataFrame) -> DataFrame:
    """By-source metrics as the dashboards print them."""
    return sources.select(
        "source",
        "count",
        F.format_string("%.2f", "avg_confidence").alias("confidence"),
        F.concat(F.round("avg_latency_ms").cast("long").cast("string"), F.lit("ms")).alias("latency"),
        source_band(F.col("avg_confidence")).alias("band"),
    )


def presented_overview(overview: DataFrame) -> DataFrame:
    """The overview as the dashboard prints it: confidence to two places, latency to none, rates to one."""
    rate = lambda c: F.concat(F.format_string("%.1f", c), F.lit("%"))
    return overview.select(
        "total_logs",
        F.format_string("%.2f", "avg_confidence").alias("confidence"),
        health_band(F.col("avg_confidence")).alias("health"),
        F.concat(F.round("avg_latency_ms").cast("long").cast("string"), F.lit("ms")).alias("latency"),
        rate("success_rate").alias("success"),
        rate("review_rate").alias("review"),
    )


def parse_rate(responses: DataFrame, parsed: Column, score: Column) -> DataFrame:
    """Share of answers that held JSON, and the mean score of those."""
    return responses.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(parsed.cast("long")).alias("parsed"),
        (F.avg(parsed.cast("double")) * 100).alias("parse_rate"),
        F.avg(F.when(parsed, score)).alias("avg_confidence"),
    )
