"""Continuous ingest, scoring and routing, scheduled runs, and the live hourly timeline.

The per-row work is the batch code; tables are those of ``store``.  Ingest and reprocess runs hand their answers
to an inbox; one routing stream takes them from there and writes findings, reviews,
metrics and states.  It keeps the ids of the raw logs that have a finding as state, by
key, so that a raw log has one finding whoever answered it, and a batch costs what it holds and not
what came before.  Messages go last.  Where they cannot be sent the batch is
committed all the same, and they wait in a queue for the retry run.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom.operators import ingest, route, state, training
from alertloom.sources import files
from alertloom.streaming import store
from alertloom.streaming.store import put, read

_LOG = logging.getLogger(__name__)
TABLES = ("finding_event", "processing_metric", "raw_log_state", "manual_review", "outbox")
OPEN = ("PENDING", "IN_PROGRESS")
LEASE_MINUTES = 5
Respond = Callable[[DataFrame], DataFrame]
Send = Callable[[DataFrame], None]


def read_bodies(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Ingest bodies, one JSON object per line, as they arrive in a folder."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "body")
    )


def accepted(bodies: DataFrame) -> DataFrame:
    """Bodies that keep the ingest contract, with ``raw_content``."""
    good = ingest.check_single(bodies).filter(F.col("reject_reason").isNull())
    return good.withColumn("raw_content", F.to_json("raw_content"))


# --- states of raw logs -----------------------------------------------------


def _state_rows(rows: DataFrame, status: Column, changed_at: Column) -> DataFrame:
    """Rows of ``raw_log_state``; of equal times the later step counts."""
    step = F.array_position(F.array(*map(F.lit, (*OPEN, "FAILED", "PROCESSED"))), status)
    given = lambda name, kind: F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    return rows.select(
        "id", status.alias("status"), given("processed_at", "timestamp").alias("processed_at"), given("error_message", "string").alias("error_message"),
        given("received_at", "timestamp").alias("received_at"), given("raw_batch", "long").alias("raw_batch"),
        F.struct(changed_at.alias("at"), step.alias("step")).alias("version"),
    )


def raw_log_states(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of each raw log."""
    return store.newest(spark, root, "raw_log_state", "id", "version")


def compact_states(spark: SparkSession, root: str) -> int:
    """Snapshot of the newest states, open ones apart, so that claims read those and the batches since."""
    return store.compact(spark, root, "raw_log_state", "id", "version", by="status")


# --- routing ----------------------------------------------------------------


def findings(spark: SparkSession, root: str) -> DataFrame:
    """Findings with ``published`` and ``message_id`` as the delivery rows say."""
    sent = read(spark, root, "published").groupBy("raw_log_id").agg(F.max("message_id").alias("_sent"))
    rows = read(spark, root, "finding_event").join(sent, "raw_log_id", "left")
    return rows.withColumns(
        {"published": F.col("published") | F.col("_sent").isNotNull(), "message_id": F.coalesce("_sent", "message_id")}
    ).drop("_sent")


def _sent(messages: DataFrame, send: Send | None) -> bool:
    """Sends messages; a failure is logged."""
    try:
        if send is not None:
            send(messages)
    except Exception:  # whatever the queue raises: the messages wait for the retry run
        _LOG.exception("messages were not sent")
        return False
    return True


def _note(messages: DataFrame, root: str, producer: str, batch_id: int, sent: bool) -> None:
    """Messages that were sent, and those that wait."""
    none = messages.limit(0)
    put(messages if sent else none, root, "outbox", producer, batch_id)
    put((messages if sent else none).select("raw_log_id", "message_id"), root, "published", producer, batch_id)
    put(none if sent else messages, root, "queue", producer, batch_id)


def route_batch(root: str, at: Column | None = None, producer: str = "stream", send: Send | None = None) -> Callable[[DataFrame, int], None]:
    """Sink of one micro-batch of responses (see ``route``); ``send`` hands messages on to a queue.  A committed batch is not written again."""

    def write(responses: DataFrame, batch_id: int) -> None:
        spark = responses.sparkSession
        if store.committed(spark, root, producer, batch_id):
            return
        when = at if at is not None else F.current_timestamp()
        # The responses are costly and feed five tables: written once, then read back.
        rows = put(responses, root, "responses", producer, batch_id)
        states = route.status_rows(rows, when)
        for table, made in (
            ("finding_event", route.finding_rows(rows, when)),
            ("processing_metric", route.metric_rows(rows, when)),
            ("raw_log_state", _state_rows(states, F.col("status"), when)),
            ("manual_review", route.review_rows(rows, when, f"{producer} {batch_id}")),
        ):
            put(made, root, table, producer, batch_id)
        messages = route.outbox_rows(rows)
        _note(messages, root, producer, batch_id, _sent(messages, send))
        store.commit(spark, root, producer, batch_id)

    return write


def _started(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def submit(responses: DataFrame, root: str, producer: str, batch_id: int) -> None:
    """Hands a producer's responses to the routing stream; a batch that is there already is left as it is."""
    path = f"{root}/inbox/{producer}/{batch_id}"
    if not store.exists(responses.sparkSession, f"{path}/_SUCCESS"):
        told = responses.withColumns({"producer": F.lit(producer), "batch_id": F.lit(batch_id).cast("long")})
        told.write.mode("overwrite").parquet(path)


def inbox(spark: SparkSession, root: str, responses: str) -> DataFrame:
    """The stream of handed-over responses; ``responses`` is their schema."""
    schema = f"{responses}, producer string, batch_id long"
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/inbox")


def first_results(responses: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Of the results of a raw log that have a finding the first, over all producers and batches; those without one, once an attempt.

    What was seen is streaming state by key, kept for ever, or with ``event_time`` for ``delay``; the
    RocksDB state store keeps it on disk.
    """
    told = [c for c in ("producer", "batch_id") if c in responses.columns]
    attempt = F.concat_ws(" ", *told) if told else F.sha2(F.to_json(F.struct(*responses.columns)), 256)
    keyed = responses.withColumn("_attempt", F.when(F.col("ocsf").isNotNull(), "").otherwise(attempt))
    if event_time is None:
        return keyed.dropDuplicates(["id", "_attempt"]).drop("_attempt")
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["id", "_attempt"]).drop("_attempt")


def run_routing(
    responses: DataFrame, root: str, checkpoint: str, at: Column | None = None, available_now: bool = False,
    event_time: str | None = None, delay: str = "1 hour", send: Send | None = None,
) -> StreamingQuery:
    """Routes a stream of responses, that of ``inbox`` or another, first results only."""
    first = first_results(responses, event_time, delay).drop("producer", "batch_id")
    return _started(first, route_batch(root, at, send=send), checkpoint, available_now)


def run_ingest(
    bodies: DataFrame, respond: Respond, root: str, checkpoint: str, key: Column, at: Column | None = None, available_now: bool = False,
) -> StreamingQuery:
    """Bodies to raw logs and answers: accepted bodies are stored as PENDING raw logs, answered by ``respond`` and handed to the routing stream."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        when = at if at is not None else F.current_timestamp()
        raw = put(ingest.new_raw_logs(accepted(batch), when, key), root, "raw_log", "ingest", batch_id)
        states = raw.withColumn("raw_batch", F.lit(batch_id).cast("long"))
        put(_state_rows(states, F.col("status"), F.col("received_at")), root, "raw_log_state", "ingest", batch_id)
        store.commit(batch.sparkSession, root, "ingest", batch_id)
        submit(respond(ingest.build_request(raw)), root, "ingest", batch_id)

    return _started(bodies, sink, checkpoint, available_now)


# --- scheduled runs ---------------------------------------------------------


def due_logs(spark: SparkSession, root: str, as_of: Column, limit: int | None = state.DEFAULT_BATCH) -> DataFrame:
    """States of raw logs to be answered (see ``reprocess_candidates``), without those that another run has claimed and may be working on."""
    open_logs = store.newest(spark, root, "raw_log_state", "id", "version", keep=F.col("status").isin(*OPEN))
    claimed = (F.col("status") == "IN_PROGRESS") & (F.col("version.at") >= as_of - F.expr(f"INTERVAL {state.STUCK_MINUTES} MINUTES"))
    return state.reprocess_candidates(open_logs.filter(~claimed), as_of, limit)


def reprocess(
    spark: SparkSession, respond: Respond, root: str, batch_id: int, as_of: Column,
    limit: int | None = state.DEFAULT_BATCH, healthy: bool = True, minutes: float = LEASE_MINUTES,
) -> DataFrame | None:
    """One scheduled run: claims due raw logs, then answers them and hands the answers to the routing stream.

    While it chooses and claims, a run holds a lease; without it (another run is choosing) nothing is done and None returned.
    The claim is committed before the work, so the next run takes other logs.  When the model is
    down the logs are handed back as PENDING.  Returns the last state rows written for the claimed logs.
    """
    if not store.committed(spark, root, "claim", batch_id):
        with store.lease(spark, root, "reprocess", minutes) as mine:
            if not mine:
                return None
            claimed = _state_rows(due_logs(spark, root, as_of, limit), F.lit("IN_PROGRESS"), as_of)
            put(claimed, root, "raw_log_state", "claim", batch_id)
            store.commit(spark, root, "claim", batch_id)
    claimed = store.got(spark, root, "raw_log_state", "claim", batch_id)
    if not healthy:
        back = _state_rows(claimed, F.lit("PENDING"), as_of + F.expr("INTERVAL 1 MICROSECOND"))
        back = put(back, root, "raw_log_state", "hand_back", batch_id)
        store.commit(spark, root, "hand_back", batch_id)
        return back
    logs = spark.read.parquet(f"{root}/raw_log").filter("producer = 'ingest'")
    if limit is not None:
        # Of the stored logs only the batches are read that hold claimed ones, ``limit`` of them at most.
        logs = logs.filter(F.col("batch_id").isin([r.raw_batch for r in claimed.select("raw_batch").distinct().collect()]))
    raw = logs.join(claimed.select("id"), "id", "left_semi")
    submit(respond(ingest.build_request(raw)), root, "reprocess", batch_id)
    return claimed


def enqueue(due: DataFrame, root: str, producer: str, batch_id: int) -> None:
    """Puts findings that are to be published, corrected ones for one, in the queue of the retry run."""
    messages = state.outbox(state.retry_candidates(due, None), F.col("ocsf_json"))
    put(messages.select("message_id", "raw_log_id", "value"), root, "queue", producer, batch_id)
    store.commit(due.sparkSession, root, producer, batch_id)


def waiting(spark: SparkSession, root: str, batch_id: int) -> tuple[DataFrame, store.Marks]:
    """Messages of a retry run: what the run before it left, and what was queued since, up to the marks; no more than that is read."""
    before = [int(n.removeprefix("batch_id=")) for n in store.listed(spark, f"{root}/retry_mark/producer=retry")]
    last = max((n for n in before if n < batch_id and store.committed(spark, root, "retry", n)), default=None)
    held = {} if last is None else {r.name: r.mark for r in store.got(spark, root, "retry_mark", "retry", last).collect()}
    upto = {p: m for p, m in store.marks(spark, root, held).items() if p != "retry"}
    new = read(spark, root, "queue", held).filter(F.col("producer") != "retry").filter(store._upto(upto)).select("message_id", "raw_log_id", "value")
    return (new if last is None else new.unionByName(store.got(spark, root, "queue", "retry", last))), upto


def retry_outbox(spark: SparkSession, root: str, batch_id: int, limit: int | None = None, send: Send | None = None) -> None:
    """One scheduled run: sends waiting messages, with ``limit`` so many of them, and notes which; the others are left for the next run."""
    if store.committed(spark, root, "retry", batch_id):
        return
    found, upto = waiting(spark, root, batch_id)
    found = put(found, root, "due", "retry", batch_id)
    due = found if limit is None else found.orderBy("message_id").limit(limit)
    sent = _sent(due, send)
    _note(due, root, "retry", batch_id, sent)
    if sent:
        put(found.join(due.select("message_id"), "message_id", "left_anti") if limit is not None else found.limit(0), root, "queue", "retry", batch_id)
    else:
        put(found, root, "queue", "retry", batch_id)
    put(spark.createDataFrame(sorted(upto.items()), "name string, mark long").coalesce(1), root, "retry_mark", "retry", batch_id)
    store.commit(spark, root, "retry", batch_id)


def export_chats(reviews: DataFrame, raw_logs: DataFrame, root: str, batch_id: int, dry_run: bool = False) -> DataFrame:
    """One run: writes reviewed corrections as chat lines, in the order of review ids, and the ids as exported; returns the run's counts.

    Lines (``{root}/chats/<run>``) and marks count together, once the run is committed; what an earlier run
    exported is left out.  A dry run writes the lines and marks nothing.
    """
    spark = reviews.sparkSession
    due = reviews
    if store.exists(spark, f"{root}/exported"):
        due = reviews.join(read(spark, root, "exported").filter(~(F.col("batch_id") == batch_id)).select("id"), "id", "left_anti")
    checked = training.exportable(due, raw_logs)
    kept = put(checked.select("id", "source", "raw_content", "corrected", "skip_reason"), root, "export", "export", batch_id)
    chats = training.export_chats(kept)
    files.write_chat_ordered(chats, "id", f"{root}/chats/{batch_id}")
    if not dry_run:
        put(chats.select("id"), root, "exported", "export", batch_id)
        store.commit(spark, root, "export", batch_id)
    return training.export_summary(kept)


# --- timeline ---------------------------------------------------------------


def live_timeline(metrics: DataFrame, ts: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    """The hourly timeline as a windowed aggregate over a stream."""
    return (
        metrics.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 hour").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
            F.coalesce(F.round(F.avg("latency_ms")).cast("int"), F.lit(0)).alias("avg_latency_ms"),
        )
        .select(F.col("w.start").alias("bucket"), "count", "avg_confidence", "avg_latency_ms")
    )


def run_timeline(metrics: DataFrame, root: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keeps the timeline in update mode: a batch writes only the hours it changed, and old hours leave the state."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        put(batch.withColumn("version", F.lit(batch_id)), root, "timeline", "timeline", batch_id)
        store.commit(batch.sparkSession, root, "timeline", batch_id)

    return _started(live_timeline(metrics), sink, checkpoint, available_now, "update")


def compact_timeline(spark: SparkSession, root: str) -> int:
    return store.compact(spark, root, "timeline", "bucket", "version")


def timeline(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of each hour: the last snapshot and the batches since."""
    return store.newest(spark, root, "timeline", "bucket", "version").drop("version")
