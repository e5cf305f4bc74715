"""Document fingerprints: MinHash signatures by universal hash permutations, bands joined in Spark, Jaccard verified.

``h -> (a * h + b) mod 2^32`` with odd ``a`` permutes the 32-bit shingle hashes; a fingerprint holds, for each of
``permutations`` such maps, the least value over a text's shingles. Everything per text is vectorised numpy.
:func:`classes` joins bands of the fingerprints and verifies what meets by the Jaccard similarity of the shingles.
:func:`against_next` finds the neighbour of each document by one range-dealt pass, never by a window over all rows;
an id of many rows is dealt to several ranges by a hash of the text.

Nulls, empty texts, ties: a null text counts as empty. A text without words has no shingles; its fingerprint is
``permutations`` times the largest value, alike (1.0) to another such text and unlike (0.0) to any other. Rows
are ordered by ``doc_id`` (null first; -2^63 counts as null there), then by a hash of the text; equal rows stay
separate rows. Different texts under one ``doc_id`` are compared each for itself. An empty table gives an
empty result. Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglab.llm import components, shingles

PERMUTATIONS = 128
#: Of five places each: a pair at 0.8 meets in one of them with a chance of 99.995 %.
BANDS = 25

_NONE = np.uint32(0xFFFFFFFF)


def _maps(permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, permutations, dtype=np.uint32)


def signatures(column: pa.Array, permutations: int = PERMUTATIONS, seed: int = 1, width: int = shingles.WIDTH) -> np.ndarray:
    """A row of ``permutations`` unsigned 32-bit numbers for each text."""
    raw, bounds = shingles.utf8(column)
    a, b = _maps(permutations, seed)
    out = np.full((len(column), permutations), _NONE, np.uint32)
    for first, last in shingles.blocks(bounds):
        at = bounds[first : last + 1]
        hashed, begin = shingles.shingle_hashes(raw[at[0] : at[-1]], at - at[0], width)
        has = np.flatnonzero(np.diff(begin))
        if not len(has):
            continue
        low, from_ = (hashed >> np.uint64(32)).astype(np.uint32), begin[has]
        for k in range(permutations):
            out[first + has, k] = np.minimum.reduceat(np.minimum(low * a[k] + b[k], _NONE - np.uint32(1)), from_)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of equal places of each pair of fingerprints: an estimate of the Jaccard similarity."""
    return (x == y).mean(axis=1) if len(x) else np.zeros(0)


def _hex(x: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in x.astype(">u4")]


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, seed: int = 1, width: int = shingles.WIDTH) -> DataFrame:
    """doc_id, fingerprint (hex), of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(signatures(batch.column(1), permutations, seed, width)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def classes(docs: DataFrame, threshold: float = shingles.THRESHOLD, permutations: int = PERMUTATIONS, bands: int = BANDS, seed: int = 1, width: int = shingles.WIDTH) -> DataFrame:
    """doc_id, text_key, class_id (least doc_id of the group of near copies), kept (whether the row stands for its
    class) of every row: bands of the fingerprints are joined, and what meets is linked where the Jaccard similarity
    of the shingles is at least ``threshold``."""
    rows = permutations // bands

    def describe(column: pa.Array, *_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = signatures(column, permutations, seed, width)
        keys = np.empty((len(found), bands), np.int64)
        for k in range(bands):
            x = np.full(len(found), k, np.uint64)
            for value in found[:, k * rows : (k + 1) * rows].T:
                x = shingles.mix(x * np.uint64(0x9E3779B97F4A7C15) + value.astype(np.uint64), k)
            keys[:, k] = x.view(np.int64)
        return keys, components.sketch(found)

    return components.near_classes(docs, describe, permutations, threshold, width, store=False)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id of every row; options as of :func:`classes`."""
    return classes(docs, **options).select("doc_id", "class_id")


_LEAST = -(1 << 63)


def _place() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(_LEAST))


def _range_of(bounds: list[int]) -> Column:
    """The range of a row (doc_id, key): how many bounds are up to its id. An id that is a bound ``m`` times is dealt
    to ``m`` ranges by its key."""
    if not bounds:
        return F.lit(0)
    known, steps = F.lit(bounds).cast("array<long>"), F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

    def up_to(fits: Callable[[Column], Column]) -> Column:  # by binary search
        return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(bounds)) & fits(F.get(known, low + step - 1)), low + step).otherwise(low))

    below, reached = up_to(lambda x: x < _place()), up_to(lambda x: x <= _place())
    share = F.col("key") / F.lit(2.0**64) + 0.5
    return F.when(reached - below < 2, reached).otherwise(below + 1 + F.least(F.floor(share * (reached - below)), reached - below - 1).cast("int"))


def beside_next(docs: DataFrame, parts: int, told: DataFrame | None = None) -> DataFrame:
    """bucket, doc_id, borrowed, key, text, class_id, kept: dealt into ranges of (doc_id, text_key) and ordered in each;
    a last row with ``borrowed`` is the first row of the next range (after the last range: of the whole table). Rows
    of ``told`` (doc_id, text_key, class_id, kept) have no text and come right before the rows that they tell of.

    Where ranges begin is known before anything is shuffled, so each text crosses the network once. Of the rows
    of a range, those equal to its first are lent.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", components.text_key(F.col("text")))
    keys = docs.select("doc_id", "key") if told is None else told.select("doc_id", F.col("text_key").alias("key"))
    at = [k / parts for k in range(1, parts)]
    found = keys.agg(F.percentile_approx(_place(), at or [0.5], 10_000)).first()[0]
    own = _range_of(list(found) if found and at else [])
    begins = sorted((r[0], r[1][0], r[1][1]) for r in keys.groupBy(own.alias("bucket")).agg(F.min(F.struct(_place().alias("o"), "key"))).collect())  # a row for each range
    before = {b: begins[i - 1][0] for i, (b, _, _) in enumerate(begins)}
    listed = lambda x: F.get(F.lit([x.get(b, 0) for b in range(parts)]).cast("array<long>"), own)
    first = (_place() == listed({b: o for b, o, _ in begins})) & (F.col("key") == listed({b: k for b, _, k in begins}))
    mine = F.struct(own.alias("bucket"), F.lit(False).alias("borrowed"))
    lent = F.struct(listed(before).cast("int").alias("bucket"), F.lit(True).alias("borrowed"))
    both = docs.select("doc_id", "key", "text", F.inline(F.when(first, F.array(mine, lent)).otherwise(F.array(mine))))
    rows = both.select("bucket", "doc_id", "borrowed", "key", "text", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("boolean").alias("kept"))
    if told is not None:
        rows = rows.union(told.select("doc_id", F.col("text_key").alias("key"), "class_id", "kept").select(own.alias("bucket"), "doc_id", F.lit(False), "key", F.lit(None).cast("string"), "class_id", "kept"))
    return rows.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "borrowed", F.asc_nulls_first("doc_id"), "key", F.asc_nulls_first("text"))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by as many of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def against_next(docs: DataFrame, told: DataFrame | None = None, permutations: int = PERMUTATIONS, seed: int = 1, width: int = shingles.WIDTH) -> DataFrame:
    """For each row its fingerprint, that of its edited text (see :func:`edited`), and how alike it is to that and
    to the next row's fingerprint; the row after the last is the first. With ``told`` (as of :func:`classes`), also
    the row's class_id and whether it is kept; it travels with the texts, in the same shuffle."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row seen, which waits for the next: bucket, doc_id, borrowed, text, class_id, kept, signature
        of: tuple = (None, None)

        def results(rows: list[tuple]) -> pa.RecordBatch:
            ids, text, class_id, kept, own, after, after_own = zip(*rows)
            new = [edited(x, y) for x, y in zip(text, after)]
            changed = signatures(pa.array(new, pa.large_string()), permutations, seed, width)
            own, after_own = np.stack(own), np.stack(after_own)
            sums = [hashlib.sha256(x.encode()).hexdigest() for x in new]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(map(len, text), pa.int64()), pa.array(sums, pa.string()), pa.array(_hex(own), pa.string()), pa.array(_hex(changed), pa.string()), pa.array(likeness(own, changed)), pa.array(likeness(own, after_own)), pa.array(class_id, pa.int64()), pa.array(kept, pa.bool_())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "kept"],
            )

        for whole in batches:
            _, bounds = shingles.utf8(whole.column(4))
            for first, last in shingles.blocks(bounds, 8 * shingles.BLOCK_BYTES):
                batch = whole.slice(first, last - first)
                found = signatures(batch.column(4), permutations, seed, width)
                done = []
                for bucket, doc_id, borrowed, _, text, class_id, kept, own in zip(*(x.to_pylist() for x in batch.columns), found):
                    if text is None:
                        of = (class_id, kept)
                        continue
                    if held is not None and held[0] == bucket and not held[2]:
                        done.append((held[1], *held[3:], text, own))
                    held = (bucket, doc_id, borrowed, text, *of, own)
                if done:
                    yield results(done)

    out = beside_next(docs, parts, told).mapInArrow(run, fields)
    return out if told is not None else out.drop("class_id", "kept")
