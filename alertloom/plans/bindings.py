"""Driver tables read as the operational tables.

The views below are plain SELECTs that both Spark and the checking engine run
as they are, so a query and its oracle start from the same rows.  Alert texts
(JSON) are made by Spark only; the oracles work out the expected columns from
``events`` without parsing any JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertloom.functions.stage import deal

AS_OF = "2024-01-31 00:00:00"
AS_OF_ISO = "2024-01-31T00:00:00Z"
AS_OF_SQL = f"timestamp'{AS_OF}'"

EVENT = """
SELECT event_id AS id, ts, user_id AS u, event_type AS ty, value, props,
       cast(regexp_extract(props, '[0-9]+', 0) AS int) AS k,
       replace(substr(cast(ts AS string), 1, 19), ' ', 'T') AS iso
FROM events
"""

SOURCE = """CASE event_type WHEN 'click' THEN 'crowdstrike' WHEN 'view' THEN 'splunk'
    WHEN 'purchase' THEN 'paloalto' WHEN 'signup' THEN 'microsoft' ELSE 'sentinel' END"""

RAW_LOG = f"""
SELECT event_id AS id, {SOURCE} AS source, props AS raw_content, ts AS received_at,
       CASE event_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS'
            WHEN 2 THEN 'PROCESSED' ELSE 'FAILED' END AS status
FROM events
"""

METRIC = f"""
SELECT id, ts, source, confidence, latency_ms,
       CASE WHEN confidence >= 0.85 THEN 'ACCEPT' WHEN confidence >= 0.60 THEN 'REVIEW'
            WHEN confidence IS NOT NULL THEN 'REJECT' END AS decision,
       coalesce(confidence >= 0.85, false) AS success
FROM (SELECT event_id AS id, ts, {SOURCE} AS source,
             CASE WHEN event_id % 10 = 0 THEN NULL
                  ELSE cast(event_id % 101 AS double) / 100 END AS confidence,
             cast(floor(value) AS int) AS latency_ms
      FROM events) m
"""

FINDING = f"""
SELECT id, id AS raw_log_id, 2004 AS class_uid, source, confidence, decision, latency_ms,
       ts AS normalized_at, id % 3 = 0 AS published
FROM ({METRIC}) x WHERE decision IS NOT NULL
"""

# A few reviews point at raw logs that do not exist.
REVIEW = f"""
SELECT id, CASE WHEN id % 29 = 0 THEN -1 - id ELSE id END AS raw_log_id, source, confidence,
       CASE WHEN decision = 'REJECT' THEN 'HIGH' ELSE 'NORMAL' END AS priority,
       ts AS queued_at,
       CASE WHEN id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS reviewed_at,
       CASE WHEN id % 3 = 0 AND id % 15 <> 0 THEN
            CASE WHEN id % 7 = 0 THEN '[1]' WHEN id % 11 = 0 THEN '{{bad'
                 WHEN id % 13 = 0 THEN '{{"class_uid":1}}'
                 ELSE concat('{{"class_uid":2004,"n":', cast(id AS string), '}}') END END AS corrected,
       id % 6 = 0 AS exported_for_training
FROM ({METRIC}) x WHERE decision <> 'ACCEPT'
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A binding SELECT over the driver's ``events``."""
    return of(read_table(spark, sf_dir, "events"), sql)


def dealt(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``view`` for costly work on each row: the rows are dealt into as many partitions as the session shuffles into."""
    return of(deal(read_table(spark, sf_dir, "events"), int(spark.conf.get("spark.sql.shuffle.partitions"))), sql)


def of(events: DataFrame, sql: str) -> DataFrame:
    """A binding SELECT over any frame of ``events`` rows, a stream too."""
    text = sql.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    return events.sparkSession.sql(text, events=events)


def duck(name: str, sql: str) -> str:
    """The binding as a WITH entry for an oracle; interval and time spelling need no change."""
    return f"{name} AS ({sql})"
