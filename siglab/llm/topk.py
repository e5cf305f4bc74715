"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are cut into blocks of rows. In a block, each dimension has a posting list of the rows where it is not
zero, with their weights. A query, as sparse (dimension, weight) terms, scatters weight times postings into a
dense array of the block's scores; a partition selection keeps the k best of the block. Blocks of queries and of
candidates make a grid, cut into tiles; a task holds a tile's queries, lets the tile's candidates stream by, and
keeps the k best of each query so far, so a tile gives k rows a query, and a last selection merges the tiles. Tiles
are found by arithmetic on block numbers; neither side is ever broadcast or held whole.

Nulls, ties, repeats: vectors that are null or hold a null or non-finite component take no part, as query or
candidate; nor do rows with a null id. Equal scores go to the smaller id. Rows are told apart by a row number, not by
their id: a query's candidates are all rows but itself, so an id that repeats can be a result more than once, and
be a result of the other rows of that id; each row of a repeated query id has results (ranks from 1) of its own.
Vectors of differing lengths count as zero beyond their end. Scores are exact: where components are so large that
64 bits may not hold a sum, blocks are scored in whole numbers of any length, and a result that a long can't
hold raises OverflowError. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglab.llm import storage

K = 20
ROWS_A_BLOCK = 2048
QUERIES_A_BLOCK = 256
#: Blocks of queries, and of candidates, that meet in one tile.
BLOCKS_A_TILE = 16
#: Partitions of the grid at most; beyond, a partition has several tiles, one after another.
MOST_PARTITIONS = 20_000


def postings(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column, the rows where it isn't zero and its values there."""
    out = []
    for column in rows.T:
        at = np.flatnonzero(column)
        out.append((at, column[at]))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, equal ones by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Tile:
    """Blocks of queries, each with its best results so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.ids = k, [], []
        self.vectors: list[np.ndarray] = []
        self.best: list[tuple[np.ndarray, np.ndarray]] = []

    def ask(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.rows += rows.tolist()
        self.ids += ids.tolist()
        self.vectors += list(vectors)
        self.best += [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(rows)

    def meet(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """A block of candidates. Vectors hold whole numbers as doubles; sums that 64 bits hold surely are made in those."""
        most = max((float(np.abs(q).max(initial=0)) for q in self.vectors), default=0.0) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
        if not most < 2.0**62:
            return self._meet_large(rows, ids, vectors)
        lists = postings(vectors.astype(np.int64))
        for i, (own, query) in enumerate(zip(self.rows, self.vectors)):
            query = query.astype(np.int64)
            scores = np.zeros(len(rows), np.int64)
            for term in np.flatnonzero(query[: len(lists)]):
                at, weight = lists[term]
                scores[at] += query[term] * weight
            other = np.flatnonzero(rows != own)
            found = other[best(scores[other], ids[other], self.k)]
            score, name = np.concatenate([self.best[i][0], scores[found]]), np.concatenate([self.best[i][1], ids[found]])
            top = best(score, name, self.k)
            self.best[i] = score[top], name[top]

    def _meet_large(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        lists = [(at, [int(x) for x in weight]) for at, weight in postings(vectors)]
        for i, (own, query) in enumerate(zip(self.rows, self.vectors)):
            scores = [0] * len(rows)
            for term in np.flatnonzero(query[: len(lists)]).tolist():
                weight = int(query[term])
                for at, x in zip(lists[term][0].tolist(), lists[term][1]):
                    scores[at] += weight * x
            so_far = list(zip(self.best[i][0].tolist(), self.best[i][1].tolist()))
            top = sorted([*so_far, *((x, name) for x, name, row in zip(scores, ids.tolist(), rows.tolist()) if row != own)], key=lambda x: (-x[0], x[1]))[: self.k]
            if any(abs(x) >= 1 << 63 for x, _ in top):
                raise OverflowError("A result's inner product doesn't fit in 64 bits.")
            self.best[i] = np.array([x for x, _ in top], np.int64), np.array([x for _, x in top], np.int64)

    def results(self) -> pa.RecordBatch:
        n = [len(x) for x, _ in self.best]
        flat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(self.rows, np.int64), n)), pa.array(np.repeat(np.array(self.ids, np.int64), n)), flat([y for _, y in self.best]), flat([x for x, _ in self.best])], ["query_row", "query_id", "vec_id", "score"])


def _blocks(rows: DataFrame, size: int, n: int, salt: int) -> tuple[DataFrame, int]:
    """Rows (row, vec_id, v) packed into binary blocks of about ``size``: block, rows, ids, dims, data; and the number of blocks."""
    count = max(1, -(-n // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at = None

        def packed() -> pa.RecordBatch:
            wide = max(len(v) for *_, v in held)
            data = np.zeros((len(held), wide))
            for i, (*_, v) in enumerate(held):
                data[i, : len(v)] = v
            told = [np.array([x[k] for x in held], np.int64).tobytes() for k in range(2)]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([x], pa.binary()) for x in told), pa.array([wide], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["block", "rows", "ids", "dims", "data"])

        for batch in batches:
            flat, bounds = batch.column(3).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy())])
            for i, (block, row, name) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if held and (block != at or len(held) == size):
                    yield packed()
                    held = []
                at = block
                held.append((row, name, flat[bounds[i] : bounds[i + 1]]))
        if held:
            yield packed()

    dealt = rows.select(F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).alias("block"), "row", "vec_id", "v")
    return dealt.repartition(F.col("block")).sortWithinPartitions("block", "row").mapInArrow(run, "block long, rows binary, ids binary, dims int, data binary"), count


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: float = 64.0, rows_a_block: int = ROWS_A_BLOCK, queries_a_block: int = QUERIES_A_BLOCK, tile: int = BLOCKS_A_TILE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) that ``is_query`` holds for,
    the k other rows of highest inner product of ``floor(scale * component)``."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), is_query.alias("asks"))
    sound = whole.filter("vec_id is not null and e is not null").filter(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    spark = vectors.sparkSession

    def _floor(x: Column) -> Column:
        y = x * scale  # from 2^53 on, doubles are whole
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    with storage.Scratch(spark) as scratch:
        usable = scratch.keep(sound.select("vec_id", F.transform("e", _floor).alias("v"), "asks").withColumn("row", F.monotonically_increasing_id()), "vectors")
        n, asked = usable.agg(F.count("*"), F.count_if("asks")).first()
        there, across = _blocks(usable.select("row", "vec_id", "v"), rows_a_block, n, 1)
        asks, down = _blocks(usable.filter("asks").select("row", "vec_id", "v"), queries_a_block, asked, 2)
        across, down = -(-across // tile), -(-down // tile)
        # A block of queries goes to every tile of its row of the grid, one of candidates to every tile of its column.
        row, column = F.floor(F.col("block") / tile), F.floor(F.col("block") / tile)
        every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("other")
        fields = ["rows", "ids", "dims", "data"]
        sent = asks.select("block", every(across), *fields).select((row * across + F.col("other")).alias("tile"), F.lit(0).alias("side"), *fields)
        sent = sent.union(there.select("block", every(down), *fields).select((F.col("other") * across + column).alias("tile"), F.lit(1).alias("side"), *fields))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, Tile(k)
            for batch in batches:
                for number, side, rows, ids, dims, data in zip(*(x.to_pylist() for x in batch.columns)):
                    if number != at:
                        if held.rows:
                            yield held.results()
                        at, held = number, Tile(k)
                    block = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dims)
                    (held.meet if side else held.ask)(*block)
            if held.rows:
                yield held.results()

        parts = max(1, min(across * down, MOST_PARTITIONS), int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = sent.repartition(parts, "tile").sortWithinPartitions("tile", "side").mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
        order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        return storage.materialise(top, "top")
