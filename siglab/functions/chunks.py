"""Scans over one long ordered group by many tasks: chunks of rows, totals of chunks, a scan over the totals.

A window over a key is one task a key. Here the rows of a key are cut into chunks, windows run over (key, chunk), and
what enters a chunk from the left comes from one row a chunk before it. A chunk is a range of positions
(:func:`numbered` gives positions by the same two levels), so chunks are of equal size whatever the times of the rows.

* :func:`lent`: rolling windows. Each chunk gets the last rows of those before it, marked, to be dropped later.
* :func:`scanned`: running sums, products and maxima, from the chunk's own and those of all chunks before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk.
ROWS = 16_384
#: Position in the group, from 0; chunk number; whether a row is lent to a chunk, not its own.
AT, CHUNK, LENT = "at_", "chunk_", "lent_"


def _known(keys: Sequence[str], value: Column) -> Column:
    """``value``, or an error in rows with a null key: joins on keys, which the rows' partitioning serves, would lose them."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return F.when(null, F.raise_error(F.lit(f"Scans by chunks need keys; one of {', '.join(keys)} is null.")).cast("long")).otherwise(value)


def _before(totals: DataFrame, keys: Sequence[str], by: str, scans: Mapping[str, tuple[Callable, str]]) -> DataFrame:
    """A row for each chunk with what the chunks before it add up to (null for the first)."""
    upto = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, by, *(agg(F.col(c)).over(upto).alias(f"{c}before_") for c, (agg, _) in scans.items()))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = AT) -> DataFrame:
    """``df`` with each row's place in its key's order, from 0. ``bucket``: a number that never falls along the order, so
    that rows of different buckets are already in order; each bucket of a key is ordered by a task of its own."""
    held = df.withColumn("bucket_", bucket)
    inner = held.withColumn("inner_", F.row_number().over(Window.partitionBy(*keys, "bucket_").orderBy(*order)) - 1)
    sizes = held.groupBy(*keys, "bucket_").agg(F.count("*").alias("n_"))
    starts = _before(sizes, keys, "bucket_", {"n_": (F.sum, "n_")})
    place = _known(keys, (F.col("inner_") + F.coalesce("n_before_", F.lit(0))).cast("long")).alias(name)
    return inner.join(starts, [*keys, "bucket_"], "left").select(*(F.col(f"`{c}`") for c in df.columns), place)


def time_bucket(df: DataFrame, by: str = "ts", rows: int = ROWS) -> Column:
    """A bucket for :func:`numbered` by time, of about ``rows`` rows where they come evenly (one aggregate of ``df``)."""
    seconds = F.unix_seconds(F.col(by).cast("timestamp"))
    keys, first, last = df.agg(F.count("*"), F.min(seconds), F.max(seconds)).first()
    width = max(1, int((last - first) / max(keys, 1) * rows)) if keys else 1
    return F.floor(F.coalesce(seconds - F.lit(first or 0), F.lit(-1)) / F.lit(width))


def lent(df: DataFrame, keys: Sequence[str], lookback: int, rows: int = ROWS, at: str = AT) -> DataFrame:
    """``df`` with its chunk, and each chunk with copies of the ``lookback`` rows before it (``lent_``), from as many
    chunks back as that takes. Windows over (keys, chunk) that look back no further are right on rows that aren't lent."""
    own = F.floor(F.col(at) / rows).cast("long")
    # A row is its own chunk's and that of each later chunk that begins at most ``lookback`` rows after it.
    last = F.floor((F.col(at) + lookback) / rows).cast("long")
    if lookback <= 0:
        return df.withColumn(CHUNK, own).withColumn(LENT, F.lit(False))
    return df.withColumn("own_", own).withColumn(CHUNK, F.explode(F.sequence(own, last))).withColumn(LENT, F.col(CHUNK) != F.col("own_")).drop("own_")


def returned(df: DataFrame) -> DataFrame:
    """``df`` without rows that are lent."""
    return df.filter(~F.col(LENT)).drop(LENT)


def scanned(df: DataFrame, keys: Sequence[str], scans: Mapping[str, tuple], by: str = AT, chunk: str = CHUNK) -> DataFrame:
    """``df`` with running aggregates over each key in the order of ``by``.

    ``scans``: by column name, the aggregate (F.sum, F.product, F.max ...), what it takes, and how two of its results
    are joined into one; where the aggregate goes by the rows' order, a fourth says what it gives of a whole chunk.
    Chunks of a key are disjoint ranges of ``by``; the aggregate of a chunk's rows up to one is joined to that of all
    chunks before. Keys aren't null.
    """
    own = Window.partitionBy(*keys, chunk).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = df.groupBy(*keys, chunk).agg(*((whole[0] if whole else agg(x)).alias(f"{name}_") for name, (agg, x, _, *whole) in scans.items()))
    before = _before(totals, keys, chunk, {f"{name}_": (agg, name) for name, (agg, *_) in scans.items()})
    within = df.withColumns({f"{name}_own_": agg(x).over(own) for name, (agg, x, *_) in scans.items()})

    def joined(name: str, both: Callable) -> Column:
        left, right = F.col(f"{name}_before_"), F.col(f"{name}_own_")
        return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(both(left, right)).alias(name)

    met = within.join(before, [*keys, chunk], "left")
    return met.select(*(F.col(f"`{c}`") for c in df.columns), *(joined(name, both) for name, (_, _, both, *_) in scans.items()))


def plus(a: Column, b: Column) -> Column:
    return a + b


def times(a: Column, b: Column) -> Column:
    return a * b
