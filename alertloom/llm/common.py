"""Shared folder, written stages and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, as in tests, a local one, if the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="alertloom-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder and read again: computed once, safe from lost executors, no lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or something like it, that no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank``, the place of a row (from 0, by ``order``, nulls first) among those of equal ``group``, and ``n``, their number.

    Rows are dealt into ranges and written in order, so ranks stay the same when a task is computed again, and a
    group that holds most rows lies in many ranges; only a count for each range and group is summed up.
    """
    keys = [*group, *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(ordered.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy("_range", *group).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    of = Window.partitionBy(*group)
    earlier = of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_range", *group, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")).alias("_add"), F.sum("_n").over(of).alias("n"))
    runs = written(runs.toDF("_r", *[f"_g{i}" for i in range(len(group))], "_add", "n"), f"{name}-runs")
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(runs, same).select(*df.columns, (F.col("_at") + F.col("_add")).alias("rank"), "n")


_model: dict[str, tuple] = {}


def worker_model(name: str, key: object, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks of one operator; only one operator's model is kept, since workers live on for other operators."""
    if _model.get(name, (None,))[0] != key:
        _model.clear()
        _model[name] = (key, make())
    return _model[name][1]


def tidy(keep: str = "") -> None:
    """At the start or end of a task: other operators' models go, and memory that Arrow holds in reserve is given back."""
    for name in [n for n in _model if n != keep]:
        del _model[name]
    pa.default_memory_pool().release_unused()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long): rows ``node, comp``, comp the smallest node reachable.

    Every node takes the smallest label among its neighbours and then the label of
    that label, until no label changes; the rounds grow with the logarithm of the
    longest chain.  Labels are written after each round.  Sums per node are combined
    before they are shuffled; the joins are plain ones whose hot side Spark can split.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.toDF("b", "c"), "b").groupBy("a").agg(F.min("c").alias("c"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        jump = written(lower.join(lower.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp").select("node", "was", F.col("next").alias("comp")), "labels")
        labels = jump.select("node", "comp")
        if jump.filter(F.col("was") != F.col("comp")).isEmpty():
            return labels
