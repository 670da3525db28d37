"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, groups by connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm import bits
from alertloom.llm.common import components, tidy, written
from alertloom.llm.shingles import mix, set_blocks

SLOTS, ROWS = 256, 8
PERCENT = 85
# Four bits of each slot are kept.  A pair of similarity 0.85 agrees in 0.86 of them; 0.766 (an estimate of 0.75) lies over four standard errors lower.
NIBBLES_EQUAL = 196

_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_STEP = 0x9E3779B97F4A7C15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIXERS = mix(np.arange(1, SLOTS + 3, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)

SIGNED = "doc_id long, n long, k1 long, k2 long, bands array<long>, bits array<long>"


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, a row for each set; the row of an empty set is all ones.

    Each element draws, step by step, a rank in [step, step + 1) and the next
    place of its own random permutation of the slots; a slot keeps the smallest rank.
    Steps run over all elements of a block together; a set is done as soon as its
    largest slot lies below the next step, since later ranks cannot lower it.
    """
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), slots), _NONE)
    if not sizes.sum():
        return out
    flat, element, row = out.reshape(-1), np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    perm = None
    for step in range(slots):
        drawn = mix(element + np.uint64((step + 1) * _STEP % (1 << 64)))
        at = step + (((drawn & _LOW) * np.uint64(slots - step)) >> _HALF).astype(np.int64)
        if perm is None:
            place = at
        else:
            line = np.arange(len(element))
            place = perm[line, at].astype(np.int64)
            perm[line, at] = perm[:, step]
        np.minimum.at(flat, row * slots + place, (drawn >> _HALF) | (np.uint64(step) << _HALF))
        left = (out.max(1) >= np.uint64((step + 1) << 32)) & (sizes > 0)
        keep = left[row]
        if not keep.any():
            break
        if perm is None:
            element, row, at = element[keep], row[keep], at[keep]
            perm = np.tile(np.arange(slots, dtype=np.uint16), (len(element), 1))
            perm[np.arange(len(element)), at] = 0
        elif 4 * keep.sum() < 3 * len(keep):
            element, row, perm = element[keep], row[keep], perm[keep]
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    for batch in batches:
        for lo, hi, sets in set_blocks(batch.column(1)):
            slots = superminhash(sets)
            grouped = slots.reshape(len(sets), SLOTS // ROWS, ROWS) * _MIXERS[:ROWS]
            bands = mix(grouped.sum(2, dtype=np.uint64) + _MIXERS[None, ROWS : ROWS + SLOTS // ROWS])
            nibbles = ((slots ^ (slots >> np.uint64(4))) & np.uint64(15)).astype(np.uint8)
            traits = ((nibbles[:, ::2] << 4) | nibbles[:, 1::2]).view(np.int64)
            key = lambda m: np.array([mix(s ^ m).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)  # noqa: E731, B023
            lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(key(_MIXERS[0])), pa.array(key(_MIXERS[1])), lists(bands), lists(traits)],
                names=["doc_id", "n", "k1", "k2", "bands", "bits"],
            )
    tidy()


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, hashes``: the shingle sets of the documents in ``nodes`` (and of a few more: a filter of fixed size sorts out, so no text is shuffled)."""
    wanted = docs.sparkSession.sparkContext.broadcast(bits.build(nodes.select(F.xxhash64("node").alias("hash"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = bits.passes(wanted.value, batch.column(2).to_numpy().view(np.uint64))
            batch = batch.filter(pa.array(mine))
            for lo, hi, sets in set_blocks(batch.column(1)):
                ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), hashes], names=["node", "hashes"])

    node = F.col("doc_id").cast("long").alias("node")
    rows = docs.select(node, F.col("text").cast("string")).filter("node IS NOT NULL")
    return rows.select("node", "text", F.xxhash64("node").alias("h")).mapInArrow(run, "node long, hashes array<long>")


def _close(a: str, b: str) -> Column:
    """Sizes allow the similarity, and so do the four-bit slots."""
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    differ = F.lit(0)
    for i in range(SLOTS // 16):
        x = F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(x)
    return (100 * low >= PERCENT * high) & (differ <= SLOTS - NIBBLES_EQUAL)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have the similarity."""
    own = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    other = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(own, "a").join(other, "b")
    same = F.size(F.array_intersect("ha", "hb"))
    return both.filter(100 * same >= PERCENT * (F.size("ha") + F.size("hb") - same)).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (doc_id long, text string; further columns are ignored).

    Documents whose five-word shingle sets have a similarity of 0.85 or more are
    linked; a component is named by its smallest doc_id, whose document is kept.
    Documents with equal sets form a class first, and only a class's smallest
    doc_id goes on, so copies never pair up.  Classes that share one of 32 bands of eight
    slots are candidates.  Within a bucket each member is compared with the most
    central one (that which meets most others over all bands); in buckets that then still
    hold several components, members outside the central one's component are
    compared with the members of other components, so links lost by the first comparison are
    found; pairs inside one component are never made.  Each link is
    confirmed on the full sets.  Null, empty and blank texts have no shingle and
    are linked with nothing; repeated rows share a component and are each returned; rows
    without doc_id name no document: their component is that of their copies, or null, and ``kept`` is false where they have copies.
    """
    signed = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sign, SIGNED), "signed")
    found = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = written(found.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "classes")

    member = classes.select("node", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    placed = written(member.join(shared, "band"), "placed")
    met = placed.groupBy("node").agg((F.sum("size") - F.count("*")).alias("met"))
    traits = written(classes.select("node", "n", "bits", "bands").join(met, "node"), "traits")
    members = placed.select("band", "node")
    order = F.struct("met", (-F.col("node")).alias("order"))
    centres = members.join(traits.select("node", "met"), "node").groupBy("band").agg(F.max(order).alias("c"))
    centres = written(centres.select("band", (-F.col("c.order")).alias("centre")), "centres")

    stars = members.join(centres, "band").filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    ends = traits.select("node", "n", "bits")
    stars = stars.join(ends.alias("x"), F.col("a") == F.col("x.node")).join(ends.alias("y"), F.col("b") == F.col("y.node")).filter(_close("x", "y"))
    stars = written(stars.select("a", "b"), "stars")
    sets = written(_sets(docs, traits), "sets")
    links = written(_verified(stars, sets), "links")
    first = components(links)

    labelled = written(members.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled")
    core = centres.select("band", F.col("centre").alias("node")).join(first, "node", "left").select("band", F.coalesce("comp", "node").alias("core"))
    open_ = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band").join(core, "band")
    # All bands of a member go along, so that a pair is made only in the first band it shares.
    rest = written(labelled.join(open_, "band").join(traits.drop("met"), "node"), "rest")
    outer = rest.filter("comp <> core").alias("x")
    # Both ends may lie outside the core; such a pair is made once.
    crossing = (F.col("x.band") == F.col("y.band")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.core")) | (F.col("x.node") < F.col("y.node")))
    first_band = F.expr("array_intersect(x.bands, y.bands)[0] = x.band")
    pairs = outer.join(rest.alias("y"), crossing & _close("x", "y") & first_band).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    pairs = written(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    more = written(_verified(pairs, sets), "links")
    comps = components(links.union(more))

    class_comp = classes.select("k1", "k2", "n", "node").join(comps, "node", "left").select("k1", "k2", "n", F.coalesce("comp", "node").alias("component_id"))
    whole = signed.select("doc_id", "n", "k1", "k2").join(class_comp, ["k1", "k2", "n"], "left")
    component = F.coalesce("component_id", "doc_id")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
