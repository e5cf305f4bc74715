"""Quantiles of all values so far, exactly.

A window with ``percentile`` sorts every prefix anew. Here each row's quantile is looked up as an order statistic of a
prefix: "the k-th smallest of the first i values", for all rows together, by halving the values' ranks bit by bit and
counting (a wavelet matrix in numpy: a pass over the rows for each bit, no loop over rows).

* :func:`thresholds`: one task a series, over (time, value) alone; an array for each series.
* :func:`long_thresholds`: for long series. Values are cut into blocks of like size by splitters, rows into chunks of
  time. A chunk finds, from counts, the block where each row's order statistic lies and its place in there; a block
  then answers its look-ups, dealt by time so that a block that is asked often is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siglab.functions import chunks

#: Blocks of values of a long series at most; look-ups that one task answers over a block.
BLOCKS, LOOKUPS = 1024, 1 << 18
_STEP = 2048


def kth(values: np.ndarray, upto: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each (i, k): where among the sorted values the one stands that is k-th (from 0) of the first i."""
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(len(values))
    low, high, k, out = np.zeros_like(upto), upto.copy(), k.copy(), np.zeros(len(upto), np.int64)
    for bit in range(max(1, (len(values) - 1).bit_length()) - 1, -1, -1):
        zero = (rank >> bit) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(zero)])
        a, b = zeros[low], zeros[high]
        up = k >= b - a
        k = np.where(up, k - (b - a), k)
        low, high = np.where(up, zeros[-1] + low - a, a), np.where(up, zeros[-1] + high - b, b)
        out |= up.astype(np.int64) << bit
        rank = np.concatenate([rank[zero], rank[~zero]])
    return out


def _places(n: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two order statistics that the q-quantile of n values lies between, and its place in [0, n - 1]."""
    place = (n - 1) * q
    below = np.floor(place).astype(np.int64)
    return below, np.minimum(below + (place > below), n - 1), place


def _between(a: np.ndarray, b: np.ndarray, below: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.where((place == below) | (a == b), a, (below + 1 - place) * a + (place - below) * b)


def expanding(values: np.ndarray, q: float, least: int) -> np.ndarray:
    """The q-quantile of the values up to each, straight between the two nearest; NaN before there are ``least``. NaNs are no values."""
    real = ~np.isnan(values)
    n, out = np.cumsum(real), np.full(len(values), np.nan)
    asked = np.flatnonzero(n >= max(least, 1))
    if len(asked):
        own, upto = values[real], n[asked]
        below, above, place = _places(upto, q)
        ordered = np.sort(own)
        out[asked] = _between(ordered[kth(own, upto, below)], ordered[kth(own, upto, above)], below, place)
    return out


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN


def _null(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def thresholds(df: DataFrame, value: str, q: float, least: int, keys: Sequence[str], by: str = "ts", name: str = "thresholds_") -> DataFrame:
    """keys, ``name``, ``values_``: arrays of the running quantiles of each series and of the values, in the order of ``by``."""
    slim = df.select(*keys, by, value)
    kinds = T.StructType([*(slim.schema[k] for k in keys), T.StructField(name, T.ArrayType(T.DoubleType())), T.StructField("values_", T.ArrayType(slim.schema[value].dataType))])

    def run(rows: pa.Table) -> pa.Table:
        if any(rows.column(k)[0].as_py() is None for k in keys):
            raise ValueError(f"Series need an id for a running quantile; {', '.join(keys)} has a null.")
        rows = rows.sort_by(by)
        found = _null(expanding(_numbers(rows.column(value)), q, least))
        own = rows.column(value).combine_chunks()
        held = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (found, own)]
        return pa.table([*(rows.column(k).slice(0, 1) for k in keys), *held], names=[*keys, name, "values_"])

    return slim.groupBy(*keys).applyInArrow(run, kinds)


def with_quantile(df: DataFrame, value: str, q: float, least: int, name: str, keys: Sequence[str], by: str = "ts") -> DataFrame:
    """``df`` with ``name``: the q-quantile of ``value`` over the rows so far, once there are ``least`` values.

    Only (keys, by, value) go through Python; the result comes back as one row a series, joined on ``keys``, so
    rows that are partitioned by ``keys`` stay where they are. ``value`` is given as the quantile saw it: where it is
    that quantile, a second computation of ``df`` could differ from it in its last bits.
    """
    found = thresholds(df, value, q, least, keys, by)
    placed = df.withColumn("place_", F.row_number().over(Window.partitionBy(*keys).orderBy(by)) - 1)
    seen = lambda c: F.get("values_", F.col("place_")).alias(c) if c == value else F.col(f"`{c}`")
    return placed.join(found, list(keys), "left").select(*map(seen, df.columns), F.get("thresholds_", F.col("place_")).alias(name))


def _splitters(df: DataFrame, keys: Sequence[str], value: str, rows: int) -> DataFrame:
    """keys and ``splits_``: values that cut each series' values into blocks of about ``rows``, by a sketch. Blocks needn't
    be equal, they only bound what a task holds."""
    n = F.count(value)
    sketch = F.percentile_approx(value, F.array(*(F.lit(k / BLOCKS) for k in range(1, BLOCKS))), 4 * BLOCKS)
    every = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(n / rows))).cast("int")
    taken = F.filter(sketch, lambda _, i: F.floor((i + 1) * every / BLOCKS) > F.floor(i * every / BLOCKS))
    return df.groupBy(*keys).agg(F.coalesce(F.array_distinct(taken), F.array().cast("array<double>")).alias("splits_"))


def long_thresholds(df: DataFrame, value: str, q: float, least: int, keys: Sequence[str], at: str = chunks.AT, name: str = "threshold_", rows: int = chunks.ROWS, lookups: int = LOOKUPS) -> DataFrame:
    """keys, ``at`` and ``name`` of each row of series numbered by ``at`` from 0, as :func:`with_quantile` defines it. Keys aren't null."""
    keys, chunk = list(keys), chunks.CHUNK
    slim = df.select(*keys, F.col(at).cast("long").alias("at_"), F.col(value).cast("double").alias("v_")).withColumn(chunk, F.floor(F.col("at_") / rows))
    splits = _splitters(slim, keys, "v_", rows)
    held = slim.join(splits, keys).withColumn("block_", F.when(F.col("v_").isNotNull(), F.size(F.filter("splits_", lambda s: s < F.col("v_"))))).drop("splits_")

    # Of each chunk, the values in each block before it: an array as long as the series has blocks.
    counts = held.filter("block_ is not null").groupBy(*keys, chunk, "block_").agg(F.count("*").alias("n_"))
    grid = slim.select(*keys, chunk).distinct().join(splits, keys).select(*keys, chunk, F.explode(F.sequence(F.lit(0), F.size("splits_"))).alias("block_"))
    upto = Window.partitionBy(*keys, "block_").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.join(counts, [*keys, chunk, "block_"], "left").withColumn("n_", F.coalesce(F.sum("n_").over(upto), F.lit(0)))
    before = filled.groupBy(*keys, chunk).agg(F.transform(F.sort_array(F.collect_list(F.struct("block_", "n_"))), lambda x: x["n_"]).alias("before_"))

    kinds = [slim.schema[k] for k in keys]
    asked_kind = T.StructType([*kinds, *(T.StructField(c, T.LongType()) for c in ("at_", "block_", "k_", "lot_")), T.StructField("share_", T.DoubleType())])

    def ask(own: pa.Table, entering: pa.Table) -> pa.Table:
        own = own.sort_by("at_")
        spot, block = own.column("at_").to_numpy(), own.column("block_").cast(pa.float64()).to_numpy(zero_copy_only=False)
        seen = np.array(entering.column("before_")[0].as_py(), np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for begin in range(0, len(spot), _STEP):
            real, some = ~np.isnan(block[begin : begin + _STEP]), slice(begin, begin + _STEP)
            each = np.zeros((len(real), len(seen)), np.int64)
            each[np.flatnonzero(real), block[some][real].astype(np.int64)] = 1
            each = np.cumsum(each, axis=0) + seen
            seen, total = each[-1].copy(), np.cumsum(each, axis=1)
            n = total[:, -1]
            ready = np.flatnonzero(n >= max(least, 1))
            below, above, place = _places(n[ready], q)
            for k, share in ((below, np.where(above > below, below + 1 - place, 1.0)), (above, np.where(above > below, place - below, 0.0))):
                wanted = share > 0
                line, k, share = ready[wanted], k[wanted], share[wanted]
                of = (total[line] <= k[:, None]).sum(axis=1)
                out.append((spot[some][line], of, k - np.where(of > 0, total[line, np.maximum(of - 1, 0)], 0), share))
        at_, of, k, share = (np.concatenate(x) if out else np.empty(0) for x in (zip(*out) if out else ((),) * 4))
        columns = [pa.array(at_, pa.int64()), pa.array(of, pa.int64()), pa.array(k, pa.int64()), pa.array(at_.astype(np.int64) // lookups, pa.int64()), pa.array(share, pa.float64())]
        return pa.table([*(pa.chunked_array([pa.repeat(own.column(c)[0], len(at_))]) for c in keys), *columns], names=asked_kind.names)

    before = before.toDF(*before.columns)  # names of its own for Spark, as both sides come from the same rows
    asked = held.drop("v_").groupBy(*keys, chunk).cogroup(before.groupBy(*keys, chunk)).applyInArrow(ask, asked_kind)

    # Each lot of look-ups into a block meets all values of the block; a lot has as many look-ups as a block has values, or more.
    values = held.filter("block_ is not null").select(*keys, F.col("block_").cast("long").alias("block_"), "at_", "v_")
    met = asked.select(*keys, "block_", "lot_").distinct().join(values, [*keys, "block_"])
    told_kind = T.StructType([*kinds, T.StructField("at_", T.LongType()), T.StructField("part_", T.DoubleType())])

    def answer(look: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("at_")
        v = own.column("v_").to_numpy()
        upto = np.searchsorted(own.column("at_").to_numpy(), look.column("at_").to_numpy(), side="right")
        found = np.sort(v)[kth(v, upto, look.column("k_").to_numpy())] if len(v) and len(look) else np.empty(0)
        return pa.table([*(look.column(c) for c in keys), look.column("at_"), pa.array(found * look.column("share_").to_numpy(), pa.float64())], names=told_kind.names)

    by, met = [*keys, "block_", "lot_"], met.toDF(*met.columns)
    parts = asked.groupBy(*by).cogroup(met.groupBy(*by)).applyInArrow(answer, told_kind)
    return parts.groupBy(*keys, "at_").agg(F.sum("part_").alias(name)).withColumnRenamed("at_", at)
