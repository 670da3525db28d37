"""Alert, pair, chat and split files.  Nothing is inferred: every reader has its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom import schemas as S
from alertloom.functions import variants as V
from alertloom.functions.sql import F as X
from alertloom.session import scratch
from alertloom.sources import arrays

# The key the reference drops from every record it loads.
DROPPED_KEY = "_id"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Alert lines: ``raw_log`` (without ``_id``), ``bad_json``.  Blank lines are left out; splittable."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter(F.col("line") != "")
    return _records(lines, "line")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of files that each hold one JSON array: ``pos``, ``raw_log``, ``bad_json``.

    A file is read in ranges by many tasks (see ``arrays``), and its elements are parsed one by one, so only a single alert
    meets the size limit of a parsed value.  A broken element is one row with ``bad_json``, and so is a file that is no array; ``pos`` is
    the place in the file.  Scanned pieces are written to the shared folder.
    """
    items = arrays.elements(spark, path, scratch(spark, "pieces"))
    return _records(items.select("pos", F.col("text").alias("line")), "line")


def _records(df: DataFrame, line: str) -> DataFrame:
    parsed = V.parse_strict(X.col(line)).column()
    has_id = F.get_json_object(line, f"$.{DROPPED_KEY}").isNotNull()
    entries = F.map_filter(
        F.try_variant_get(parsed, "$", "map<string,variant>"), lambda k, v: k != DROPPED_KEY
    )
    text = F.when(has_id, F.to_json(entries)).otherwise(F.col(line))
    keep = [c for c in df.columns if c != line]
    return df.select(*keep, text.alias("raw_log"), parsed.isNull().alias("bad_json"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Labelled pairs as lines ``{id, source, raw_log, ocsf}`` with nested JSON objects."""
    nested = F.struct(
        "id", "source", F.parse_json("raw_log").alias("raw_log"), F.parse_json("ocsf").alias("ocsf")
    )
    pairs.select(F.to_json(nested).alias("value")).write.mode("errorifexists").text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs back as text columns, a line that does not parse with ``bad_json``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    v = F.try_parse_json("value")
    part = lambda k: F.try_variant_get(v, f"$.{k}", "string").alias(k)
    return lines.select(*[part(k) for k in ("id", "source", "raw_log", "ocsf")], v.isNull().alias("bad_json"))


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Chat lines as ``line, messages, bad_line``; JSON of another shape has NULL messages, a line that is no JSON is a ``bad_line``."""
    lines = spark.read.text(path).withColumnRenamed("value", "line").filter(F.trim("line") != "")
    return lines.withColumns({"messages": F.from_json("line", S.CHAT)["messages"], "bad_line": F.try_parse_json("line").isNull()})


def read_chat_strict(spark: SparkSession, path: str) -> DataFrame:
    """Chat lines; a bad line fails the job."""
    return spark.read.schema(S.CHAT).option("mode", "FAILFAST").json(path)


def write_chat(chats: DataFrame, path: str, compression: str = "none") -> None:
    """Chat lines.  Compressed files take little room, as all lines share the system prompt, but each is read by one task."""
    chats.select("messages").write.mode("errorifexists").json(path, compression=compression)


def write_chat_ordered(chats: DataFrame, order: str, path: str) -> None:
    """Chat lines in the order of a column: ranges of it are written at a time, and files by name, lines by place, follow it."""
    chats.repartitionByRange(order).sortWithinPartitions(order).select("messages").write.mode("overwrite").json(path)


def read_lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """``line, place`` of a folder of lines; ``place`` grows by file and line."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    return lines.select("line", F.concat_ws(" ", "_file", pad("_block"), pad("_at")).alias("place"))


def write_splits(splits: DataFrame, path: str, compression: str = "none") -> None:
    """One folder per split; ``compression``: see ``write_chat``."""
    splits.select("messages", "split").write.mode("errorifexists").partitionBy("split").json(path, compression=compression)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.schema(f"{S.CHAT}, split string").json(path).filter(F.col("split") == split)


def write_rejected(rejected: DataFrame, path: str, compression: str = "none") -> None:
    """Rejected lines as objects: their own keys, or ``_raw`` where the line is no JSON object, and ``_reject_reason``; ``compression``: see ``write_chat``."""
    own = F.map_filter(F.try_variant_get(F.try_parse_json("line"), "$", "map<string,variant>"), lambda k, v: k != "_reject_reason")
    raw = F.create_map(F.lit("_raw"), F.col("line").cast("variant"))
    reason = F.create_map(F.lit("_reject_reason"), F.col("reject_reason").cast("variant"))
    rejected.select(F.to_json(F.map_concat(F.coalesce(own, raw), reason)).alias("value")).write.mode("errorifexists").text(path, compression=compression)


def write_digests(digests: DataFrame, path: str) -> None:
    digests.select("digest").write.mode("errorifexists").text(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A live store's table; give ``partitionColumn``, bounds and ``numPartitions`` for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
