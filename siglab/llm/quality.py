"""Quality scores: random Fourier features over document statistics, ridge by partition sums, isotonic calibration.

Each whole text is reduced to a few statistics (:data:`STATISTICS`). Random Fourier features approximate a
Gaussian kernel over the standardised statistics, to which the statistics themselves are added as a linear term;
the normal equations of ridge regression are summed within each partition, then over partitions as a tree, so the
driver gets a bounded number of small matrices. The kernel's width is chosen among :data:`SIGMAS` within the labelled
rows that are given: by the squared error on an eighth of them that the trial fits leave out (it follows from their
normal equations alone), which then joins the fit. Another, disjoint part of the labelled rows calibrates: their
ridge scores are counted in fixed bins, and pool-adjacent-violators over the bins, joined by straight lines, makes a
score a probability.

The statistics hold nothing but the text: labels, languages, sources and ids enter no score. All labelled rows
take part.

Nulls, empty texts, ties: a null text counts as empty; an empty text has all statistics 0 and is scored like any
other. Labels that are null or of unknown documents are left out; several labels of a document all count. Equal
texts get equal scores. Without labels every score is 0.5; with labels of one kind, that kind's. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglab.llm import shingles, storage

FEATURES = 256
#: Widths of the kernel that are tried, in units of half the root of the number of statistics.
SIGMAS = (1.0, 2.0, 4.0)
RIDGE = 1.0
BINS = 400
#: Of so many parts of the labelled rows, two calibrate and one chooses the width.
PARTS = 8
#: Sums that one task of the tree adds up.
FAN_IN = 16

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_spread", "distinct_words", "letters", "digits", "signs", "stops", "spaces",
    "capitals", "lines", "line_bytes", "wide", "symbol_words", "bar_share", "short_words", "repeated_shingles",
)


def _classes() -> np.ndarray:
    """A bit for each kind of byte: letter, digit, sign, sentence mark, space, capital, line feed, beyond ASCII, bar."""
    kind = np.zeros(256, np.int64)
    for i in range(256):
        c = chr(i)
        if i >= 128:
            kind[i] = 1 | 128
        elif c.isalpha():
            kind[i] = 1 | (32 if c.isupper() else 0)
        elif c.isdigit():
            kind[i] = 2
        elif c in ".,;:!?'\"-()":
            kind[i] = 8
        elif i <= 32:
            kind[i] = 16 | (64 if i == 10 else 0)
        else:
            kind[i] = 4 | (256 if c in "|<>{}" else 0)
    return kind


_KIND = _classes()


def statistics(column: pa.Array) -> np.ndarray:
    """A row of :data:`STATISTICS` for each text."""
    raw, bounds = shingles.utf8(column)
    out = np.zeros((len(column), len(STATISTICS)))
    for first, last in shingles.blocks(bounds):
        at = bounds[first : last + 1] - bounds[first]
        data = raw[bounds[first] : bounds[last]]
        size = np.diff(at).astype(float)
        has = np.flatnonzero(size)
        if not len(has):
            continue
        owner = np.repeat(np.arange(last - first), np.diff(at))
        n = last - first
        by_byte = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)
        share = lambda bit: by_byte @ ((_KIND & bit) > 0)
        letters, digits, signs, stops, spaces, capitals, lines, wide, bars = (share(1 << k) for k in range(9))
        starts, stops_at, begin = shingles.words(data, at)
        words = np.diff(begin).astype(float)
        of = np.repeat(np.arange(n), np.diff(begin))
        length = (stops_at - starts).astype(float)
        mean = np.bincount(of, length, n) / words.clip(1)
        spread = np.sqrt((np.bincount(of, length**2, n) / words.clip(1) - mean**2).clip(0))
        hashed = shingles.word_hashes(data, starts, stops_at)
        different = np.diff(shingles.distinct(hashed, begin)[1])
        odd = np.concatenate([[0], np.cumsum(((_KIND & 4) > 0)[data])])
        odd_words = np.bincount(of, odd[stops_at] > odd[starts], n)
        joined, where = shingles.shingle_hashes(data, at, 3)
        total = np.diff(where)
        single, alone, _ = shingles.distinct(joined, where)
        length_ = size.clip(1)
        block = np.stack([
            np.log1p(size), np.log1p(words), mean, np.log1p(spread), different / words.clip(1), letters / length_, digits / length_, signs / length_, stops / length_, spaces / length_,
            capitals / words.clip(1), np.log1p(lines), np.log1p(size / (lines + 1)), wide / length_, odd_words / words.clip(1), bars / length_, np.bincount(of, length <= 3, n) / words.clip(1), 1 - np.diff(alone) / total.clip(1),
        ], axis=1)
        block[size == 0] = 0
        out[first:last] = block
    return out


@dataclass(eq=False)
class Model:
    """Standardisation, random features, ridge weights and the calibration's points."""

    mean: np.ndarray
    scale: np.ndarray
    seed: int = 5
    sigma: float = 2.0
    features: int = FEATURES
    weights: np.ndarray | None = None
    x: np.ndarray | None = None
    y: np.ndarray | None = None
    base: float = 0.5

    def expand(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.standard_normal((len(self.mean), self.features)) / (self.sigma * math.sqrt(len(self.mean)) / 2)
        b = rng.uniform(0, 2 * math.pi, self.features)
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ w + b) * math.sqrt(2 / self.features), z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or self.x is None or not len(stats):
            return np.full(len(stats), self.base)
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0, 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence in weighted squares, by pooling adjacent violators."""
    level: list[list[float]] = []
    for v, w in zip(value, weight):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v2, w2, n2 = level.pop()
            v1, w1, n1 = level.pop()
            level.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([v for v, _, _ in level], [n for _, _, n in level])


def _rows(batch: pa.RecordBatch, index: int) -> np.ndarray:
    return batch.column(index).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _summed(rows: DataFrame, models: list[Model]) -> dict[tuple[int, int], np.ndarray]:
    """The normal equations of (stats, y, part) rows for each model and part: z'z, z'y as a last column, y'y below it.
    Summed by partition, then over ``FAN_IN`` partitions at a time, then here."""
    wide = models[0].features + len(models[0].mean) + 1

    def told(total: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([k for _, k in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["model", "part", "total"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            stats, y, of = _rows(batch, 0) if len(batch) else np.zeros((0, 0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for p in np.unique(of):
                for k, model in enumerate(models):
                    z, own = model.expand(stats[of == p]), y[of == p]
                    at = total.setdefault((k, int(p)), np.zeros((wide + 1, wide + 1)))
                    at[:wide, :wide] += z.T @ z
                    at[:wide, wide] += z.T @ own
                    at[wide, wide] += own @ own
        yield told(total)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for k, p, x in zip(*(c.to_pylist() for c in batch.columns)):
                at = total.setdefault((k, p), np.zeros((wide + 1, wide + 1)))
                at += np.frombuffer(x).reshape(wide + 1, wide + 1)
        yield told(total)

    fields = "model int, part int, total binary"
    sums, n = rows.mapInArrow(part, fields), rows.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        sums = sums.repartition(n).mapInArrow(group, fields)
    out: dict = {}
    for k, p, x in sums.toLocalIterator():
        out[k, p] = out.get((k, p), 0) + np.frombuffer(x).reshape(wide + 1, wide + 1)
    return out


def _solved(total: np.ndarray, ridge: float) -> np.ndarray:
    z = total[:-1, :-1]
    return np.linalg.solve(z + ridge * np.eye(len(z)), total[:-1, -1])


def _error(total: np.ndarray, weights: np.ndarray) -> float:
    """The summed squared error of weights on the rows of a sum."""
    return float(total[-1, -1] - 2 * weights @ total[:-1, -1] + weights @ total[:-1, :-1] @ weights)


def fit(labelled: DataFrame, seed: int = 5, ridge: float = RIDGE, sigmas: Sequence[float] = SIGMAS) -> Model:
    """A model from rows (doc_id, stats, y)."""
    of = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    calibrates = of < 2
    moments = [f(F.get("stats", i)) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    first = labelled.agg(F.count("*"), F.avg("y"), *moments).first()
    if not first[0]:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    flat = np.array(first[2:], float)
    tried = [Model(flat[0::2], np.where(flat[1::2] > 1e-9, flat[1::2], 1.0), seed, sigma, base=float(first[1])) for sigma in sigmas]
    model = tried[0]
    if first[1] in (0.0, 1.0):
        return model
    sums = _summed(labelled.filter(~calibrates).select("stats", "y", (of == 2).cast("int").alias("part")), tried)
    if not sums:
        return model
    if all((k, p) in sums for k in range(len(tried)) for p in (0, 1)):
        model = tried[int(np.argmin([_error(sums[k, 1], _solved(sums[k, 0], ridge)) for k in range(len(tried))]))]
    at = tried.index(model)
    model.weights = _solved(sum(x for (k, _), x in sums.items() if k == at), ridge)
    frozen = model

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = frozen.raw(_rows(batch, 0)) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(1)], ["s", "y"])

    def binned(rows: DataFrame) -> list:
        at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("s") + 0.5) * (BINS / 2)))).cast("int")
        return rows.select("stats", "y").mapInArrow(raw, "s double, y double").groupBy(at.alias("bin")).agg(F.avg("s"), F.avg("y"), F.count("*")).collect()

    bins = sorted(binned(labelled.filter(calibrates)), key=lambda r: r[1]) or sorted(binned(labelled), key=lambda r: r[1])
    x, y, w = (np.array([r[k] for r in bins], float) for k in (1, 2, 3))
    level = isotonic((y * w + model.base * 0.5) / (w + 0.5), w)
    # Distinct levels at their mean scores, so that scores between them follow a straight line.
    starts = np.flatnonzero(np.concatenate([[True], level[1:] > level[:-1] + 1e-12]))  # what differs by rounding alone is one level
    mass = np.add.reduceat(w, starts)
    model.x, model.y = np.add.reduceat(x * w, starts) / mass, level[starts]
    low, high = x.min() - 0.5, x.max() + 0.5
    model.x = np.concatenate([[low - 1], model.x, [high + 1]])
    model.y = np.concatenate([[model.y[0] * 0.5], model.y, [(1 + model.y[-1]) / 2]])
    return model


def described(docs: DataFrame) -> DataFrame:
    """doc_id, stats (doubles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = statistics(batch.column(1)).reshape(-1)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(STATISTICS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], ["doc_id", "stats"])

    return storage.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, stats array<double>")


def score(docs: DataFrame, labels: DataFrame, seed: int = 5, ridge: float = RIDGE) -> DataFrame:
    """doc_id, score (0 to 1) of every row; ``labels``: doc_id, quality (0/1), only those that may be learnt from."""
    stats = storage.materialise(described(docs), "statistics")
    told = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    labelled = storage.materialise(stats.join(told, "doc_id"), "labelled")
    model = fit(labelled, seed, ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_rows(batch, 1)) if len(batch) else np.zeros(0))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")
