"""Plan boundaries for costly per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.sql import Sql

_OWN = "_own"


def deal(df: DataFrame, partitions: int | None) -> DataFrame:
    """Rows dealt round robin into so many partitions, ahead of costly work on few bytes a row; as they are for None."""
    return df if partitions is None else df.repartition(partitions)


def once(df: DataFrame, keep: list[str], **named: Sql) -> DataFrame:
    """``keep`` plus the named expressions, each computed exactly once per row.

    A filter on a computed column is normally pushed below the projection that
    computes it, which then runs twice; for a JSON parse or a vendor mapping that
    doubles the job.  A filter cannot pass a generator, so the values go through
    a one-element ``inline_outer``.  It adds no rows and no shuffle.

    The tiny lambda, over a column so that it is not folded away, keeps the wide projection out of whole-stage code: fused
    into one method it would be too long for the JVM to compile, whereas a
    projection of its own is split into small methods.
    """
    fields = ", ".join(f"'{n}', {s.text}" for n, s in named.items())
    own = f"transform(array(`{keep[0] if keep else df.columns[0]}`), x -> x)"
    struct = F.expr(f"named_struct({fields}, '{_OWN}', {own})")
    staged = df.select(*keep, struct.alias("_once"))
    return staged.select(*keep, F.expr("inline_outer(array(_once))")).drop(_OWN)
