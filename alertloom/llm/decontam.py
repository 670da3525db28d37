"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document thousands of words long and an item of thirty are far apart in Jaccard terms
however fully the item is contained, so a document sketch of fixed length would lose it.
The minima are therefore taken on the item's side: items are
partitioned by size (powers of two), and a partition fixes how many minimum hashes of an item are
kept, so many that a document holding the asked share of the item holds at least
one of them.  All shingles of every document are looked up among these minima.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm import bits
from alertloom.llm.common import tidy, written
from alertloom.llm.shingles import set_blocks

CONTAINMENT = 0.8


def _need(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least number of shared shingles of an item of ``n``."""
    return (percent * n + 99) // 100


def _item_sets(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets in set_blocks(batch.column(1)):
                sizes = np.array([len(s) for s in sets])
                # Of the partition [2^p, 2^(p+1)) the largest size sets the number of minima.
                top = np.array([(1 << int(n).bit_length()) - 1 for n in sizes], np.int64)
                minima = np.minimum(sizes, top - _need(top, percent) + 1)
                rank = np.concatenate([np.arange(n) for n in sizes])
                row = np.repeat(np.arange(lo, hi), sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(sizes[row - lo], pa.int64()), pa.array(np.concatenate(sets).view(np.int64)), pa.array(rank < minima[row - lo])],
                    names=["item_id", "size", "hash", "minimum"],
                )

    return run


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, item_id, shared, size``: the items whose five-word shingles lie in a document to the given share or more.

    ``docs`` (doc_id long, text string) and ``items`` (item_id long, text string) may have further
    columns.  An item or document of one to four words is one shingle, so a very short item is found
    only as a whole document.  Null and empty texts contain nothing.  Rows repeated
    under one doc_id are one document; rows without an id are left out.
    """
    spark = docs.sparkSession
    percent = round(100 * containment)
    given = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id IS NOT NULL")
    shingled = written(given.mapInArrow(_item_sets(percent), "item_id long, size long, hash long, minimum boolean").distinct(), "items")
    every, smallest = (spark.sparkContext.broadcast(bits.build(x)) for x in (shingled, shingled.filter("minimum")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for lo, hi, sets in set_blocks(batch.column(1)):
                hits = [s[bits.passes(every.value, s)] if bits.passes(smallest.value, s).any() else s[:0] for s in sets]
                ends = np.cumsum([0, *(len(h) for h in hits)]).astype(np.int32)
                found = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hits).view(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), found], names=["doc_id", "n", "hits"])
                yield out.filter(pa.array(np.diff(ends) > 0))

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")
    hits = texts.mapInArrow(look_up, "doc_id long, n long, hits array<long>")
    hits = written(hits.select("doc_id", "n", F.size("hits").alias("held"), F.explode("hits").alias("hash")), "hits")
    # A document smaller than the share of an item, or with fewer shingles of any items, cannot hold it.
    enough = (100 * F.col("n") >= percent * F.col("q")) & (100 * F.col("held") >= percent * F.col("q"))
    minima = shingled.filter("minimum").withColumnRenamed("size", "q")
    candidates = written(hits.join(minima, "hash").filter(enough).select("doc_id", "item_id").distinct(), "candidates")
    # Shingles are met with candidate pairs only: one that many items share does not pair its documents with all of them.
    met = hits.select("doc_id", "hash").distinct().join(candidates, "doc_id").join(shingled, ["item_id", "hash"])
    shared = met.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.first("size").alias("size"))
    return shared.filter(100 * F.col("shared") >= percent * F.col("size")).select("doc_id", "item_id", "shared", "size")


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, n_items, items, contaminated`` for each row of ``docs``: the ids of contained items, ascending.

    See ``contained_items``.  A row without doc_id holds no item by definition.
    """
    found = contained_items(docs, items, containment).groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    ids = docs.select(F.col("doc_id").cast("long"))
    none = F.array().cast("array<long>")
    return ids.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), F.col("items").isNotNull().alias("contaminated")
    )
