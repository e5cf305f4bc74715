"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered 0..n-1 in order of (doc_id, text hash) by ranges; a keyed Feistel network over the least even
number of bits that holds n permutes the numbers, and a result of n or more is permuted again until it falls
below n. Position ``p`` is slot ``p div shards`` of shard ``p mod shards``: the shuffle is reproducible, and the
place of any row is computed from its number alone, as is the number at any place by the inverse. Shard sizes in
rows differ by one at most (law ``rows``). The law leaves no room for keeping equal texts together, so they are
spread like any others.

Nulls, empty texts, ties: a null ``doc_id`` comes first in the order, a null text counts as empty. Rows with
equal doc_id and text are interchangeable and get places of their own. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglab.llm import storage

ROUNDS = 6
SEED = 20_240_601


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _network(x: np.ndarray, half: int, seed: int, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key = (seed * 0x632BE59BD9B4E019 + k * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        if back:
            left, right = right ^ (_scramble(left, key) & mask), left
        else:
            left, right = right, left ^ (_scramble(right, key) & mask)
    return (left << shift) | right


def permute(numbers: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """A permutation of 0..n-1, or its inverse, applied to ``numbers``."""
    half, x = _half_bits(n), _network(numbers.astype(np.uint64), _half_bits(n), seed, back)
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = _network(x[out], half, seed, back)
    return x.astype(np.int64)


def number(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``row_number_``, 0, 1, ... in the given order: sorted by ranges, counted, then shifted."""
    names = rows.columns
    dealt = storage.materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part_"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("inner_")), "numbered")
    total, begin = 0, []
    for part, n in sorted(dealt.groupBy("part_").count().collect()):  # a row for each partition
        begin += [0] * (part - len(begin)) + [total]
        total += n
    shift = F.get(F.lit(begin or [0]).cast("array<long>"), F.col("part_"))
    return dealt.select(*names, (F.col("inner_") + shift).alias("row_number_"), F.lit(total).cast("long").alias("total_"))


def shards(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("tie_"))
    rows = number(slim, F.asc_nulls_first("doc_id"), F.asc("tie_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            at = permute(batch.column(3).to_numpy(), batch.column(4)[0].as_py(), seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at % shards, pa.int32()), pa.array(at // shards, pa.int64()), batch.column(3)], ["doc_id", "size", "text_crc32", "shard", "slot", "row_number"])

    placed = rows.select("doc_id", "size", "text_crc32", "row_number_", "total_").mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, slot long, row_number long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
