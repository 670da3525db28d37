"""Tables of batches under one folder: whole batches only, snapshots of newest rows, leases.

A table holds a folder for each ``producer`` and ``batch_id``.  A batch that is written again replaces itself and
nothing else; it counts once its row in ``committed`` is there.  A producer
commits its batches in order, so all it has written up to some time is one number, its mark.  File names are compared and
created by Hadoop's file system, whatever that is; a file is created by one caller only where that system says so (HDFS does).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from time import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators import state

Marks = dict[str, int]


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file(spark, path)
    return fs.exists(target)


def listed(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder, with their time of change in milliseconds; none where there is no such folder."""
    fs, target = _file(spark, path)
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(target)} if fs.exists(target) else {}


def create(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; False where it is there already."""
    fs, target = _file(spark, path)
    fs.mkdirs(target.getParent())
    return fs.createNewFile(target)


def put(df: DataFrame, root: str, table: str, producer: str, batch_id: int) -> DataFrame:
    """Writes a producer's batch of a table anew, and reads it back."""
    path = f"{root}/{table}/producer={producer}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def got(spark: SparkSession, root: str, table: str, producer: str, batch_id: int) -> DataFrame:
    """One batch, committed or not."""
    return spark.read.parquet(f"{root}/{table}/producer={producer}/batch_id={batch_id}")


def commit(spark: SparkSession, root: str, producer: str, batch_id: int) -> None:
    put(spark.range(1).select(F.lit(True).alias("done")).coalesce(1), root, "committed", producer, batch_id)


def committed(spark: SparkSession, root: str, producer: str, batch_id: int) -> bool:
    return exists(spark, f"{root}/committed/producer={producer}/batch_id={batch_id}/_SUCCESS")


def _later(marks: Marks) -> Column:
    """Batches after the marks; of a producer without one, all.  On partition columns, so older folders are not read."""
    later = ~F.col("producer").isin(*marks)
    for producer, mark in marks.items():
        later = later | ((F.col("producer") == producer) & (F.col("batch_id") > mark))
    return later


def _batches(spark: SparkSession, root: str, marks: Marks | None) -> DataFrame:
    done = spark.read.parquet(f"{root}/committed")
    return (done.filter(_later(marks)) if marks else done).select("producer", F.col("batch_id").cast("long")).distinct()


def read(spark: SparkSession, root: str, table: str, after: Marks | None = None) -> DataFrame:
    """A table's committed rows, with ``producer`` and ``batch_id``; only those of batches after the marks, if given."""
    rows = spark.read.parquet(f"{root}/{table}")
    rows = rows.filter(_later(after)) if after else rows
    return rows.join(_batches(spark, root, after), ["producer", "batch_id"], "left_semi")


def marks(spark: SparkSession, root: str, after: Marks | None = None) -> Marks:
    """The last committed batch of each producer; a row a producer reaches the driver."""
    new = _batches(spark, root, after).groupBy("producer").agg(F.max("batch_id").alias("m")).collect()
    return (after or {}) | {r.producer: r.m for r in new}


def _upto(upto: Marks) -> Column:
    kept = F.lit(False)
    for producer, mark in upto.items():
        kept = kept | ((F.col("producer") == producer) & (F.col("batch_id") <= mark))
    return kept


def last_snapshot(spark: SparkSession, root: str, table: str) -> tuple[int, Marks]:
    """Number of the snapshot that counts, and the marks it holds; 0 where there is none."""
    numbers = [int(n) for n in listed(spark, f"{root}/snapshot_mark/{table}") if exists(spark, f"{root}/snapshot_mark/{table}/{n}/_SUCCESS")]
    if not numbers:
        return 0, {}
    return max(numbers), {r.producer: r.mark for r in spark.read.parquet(f"{root}/snapshot_mark/{table}/{max(numbers)}").collect()}


def newest(spark: SparkSession, root: str, table: str, key: str, version: str, keep: Column | None = None, upto: Marks | None = None) -> DataFrame:
    """The newest row of each key: of the last snapshot and of the batches since, which is what ``latest`` gives of all batches.

    ``keep`` leaves other rows out.  It is pushed into the snapshot, of which no more than those rows (and
    their partitions, see ``compact``) are read; versions of a key must then grow from batch to batch.
    """
    number, held = last_snapshot(spark, root, table)
    tail = read(spark, root, table, held)
    tail = (tail if upto is None else tail.filter(_upto(upto))).drop("producer", "batch_id")
    if not number:
        found = state.latest(tail, key, version)
        return found if keep is None else found.filter(keep)
    snapshot = spark.read.parquet(f"{root}/snapshot/{table}/{number}").select(*tail.columns)
    if keep is None:
        return state.latest(snapshot.unionByName(tail), key, version)
    changed = tail.select(F.col(key).alias("_key")).distinct()
    same = snapshot.filter(keep).join(changed, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    return same.unionByName(state.latest(tail, key, version).filter(keep))


def compact(spark: SparkSession, root: str, table: str, key: str, version: str, by: str | None = None) -> int:
    """Writes the newest row of each key as the next snapshot, in partitions of ``by``, and swaps it in by its row of marks.

    Readers see the old snapshot and its batches, or the new one and those since; nothing is changed in place.
    """
    number, held = last_snapshot(spark, root, table)
    upto = marks(spark, root, held)
    rows = newest(spark, root, table, key, version, upto=upto)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{root}/snapshot/{table}/{number + 1}")
    held_now = spark.createDataFrame(sorted(upto.items()), "producer string, mark long").coalesce(1)
    held_now.write.mode("overwrite").parquet(f"{root}/snapshot_mark/{table}/{number + 1}")
    return number + 1


@contextmanager
def lease(spark: SparkSession, root: str, name: str, minutes: float) -> Iterator[bool]:
    """Whether this run alone may go on: numbered files, each made by one run only; the next number is free once the last is released or ``minutes`` old."""
    folder = f"{root}/lease/{name}"
    files = listed(spark, folder)
    last = max((int(n) for n in files if n.isdigit()), default=0)
    live = last and f"{last}.released" not in files and files[str(last)] > (time() - 60 * minutes) * 1000
    mine = not live and create(spark, f"{folder}/{last + 1}")
    try:
        yield mine
    finally:
        if mine:
            create(spark, f"{folder}/{last + 1}.released")
