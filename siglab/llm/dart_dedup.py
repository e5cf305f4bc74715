"""Near-duplicate removal by DartMinHash: hashed darts thrown into weighted element regions.

Each shingle owns a strip of the plane, as wide as its weight: how often the text has it. Darts fall on every strip
as a Poisson process drawn from hashes of (shingle, region, dart), so two texts see the same darts wherever their
strips overlap. A text keeps, for each of ``coordinates`` places, the dart of least rank in its strips: an exact
weighted MinHash at a cost near the text's length plus ``coordinates * ln(coordinates)``, instead of their product.
Runs of ``rows`` coordinates make the bucket keys; texts that meet in a bucket are compared by the weighted Jaccard
similarity of their shingles: the sum of the lesser counts over the sum of the greater ones, which for texts that
repeat no shingle is the Jaccard similarity of sets.

Nulls, empty texts, ties: null texts count as empty; all texts without words are one class. Equal texts are one
class whatever their number. Rows are told apart by what they hold, so different texts under one ``doc_id`` are
compared and kept each for itself; rows with a null ``doc_id`` are compared like all others. A class is named by its
least ``doc_id`` (null if it has none) and stood for by that id's text (of several: the one of least hash; without
an id, likewise). Of equal rows ``deduplicate`` keeps one. An empty table gives an empty result. Other columns are
passed on by ``deduplicate`` (but for names that begin with ``dart_``) and ignored by ``near_classes``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglab.llm import components, shingles

BANDS = 25
ROWS = 5
#: The finest region of ranks is [0, 2^FINEST); each further one doubles the reach.
FINEST = -6


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(mean: float) -> np.ndarray:
    """The distribution function at 0, 1, ... as far as doubles tell it from 1."""
    term, total, out = math.exp(-mean), 0.0, []
    while not out or (total < 1 - 1e-16 and len(out) < 20 + 10 * mean):
        total += term
        out.append(total)
        term *= mean / len(out)
    return np.array(out)


def darts(hashes: np.ndarray, weights: np.ndarray, reach: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element, rank and name of each dart below an element's weight with a rank below its ``reach``."""
    element, rank, name = [], [], []
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    heavy = 0
    while (low_w := 0.0 if heavy == 0 else 2.0 ** (heavy - 1)) < weights.max():
        wide = 1.0 if heavy == 0 else low_w
        in_w = np.flatnonzero(weights > low_w)
        for level in range(FINEST, 64):
            low_r = 0.0 if level == FINEST else 2.0 ** (level - 1)
            own = in_w[reach[in_w] > low_r]
            if not len(own):
                break
            tall = 2.0**level - low_r
            region = shingles.mix(hashes[own], 1 + seed * 8192 + heavy * 128 + level - FINEST)
            area = wide * tall
            if area > 30:  # cut into strips whose counts are drawn one by one
                strips = math.ceil(area / 16)
                own, region = np.repeat(own, strips), shingles.mix(np.repeat(region, strips) + np.tile(np.arange(strips, dtype=np.uint64), len(own)), 3)
                base, tall = low_r + np.tile(np.arange(strips), len(own) // strips) * (tall / strips), tall / strips
                area /= strips
            else:
                base = np.full(len(own), low_r)
            law = _poisson(area)
            u = _uniform(region)
            some = np.flatnonzero(u >= law[0])
            n = np.searchsorted(law, u[some], "right")
            at = np.repeat(some, n)
            index = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            dart = shingles.mix(region[at] + index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5)
            r, w = base[at] + tall * _uniform(dart), low_w + wide * _uniform(shingles.mix(dart, 7))
            ok = (w < weights[own[at]]) & (r < reach[own[at]])
            element.append(own[at[ok]])
            rank.append(r[ok])
            name.append(dart[ok])
        heavy += 1
    return np.concatenate(element), np.concatenate(rank), np.concatenate(name)


def signatures(hashes: np.ndarray, begin: np.ndarray, weights: np.ndarray, coordinates: int = BANDS * ROWS, seed: int = 0) -> np.ndarray:
    """A row for each text: the name of the earliest dart of each coordinate (0 throughout for no elements)."""
    out = np.zeros((len(begin) - 1, coordinates), np.uint64)
    todo = np.flatnonzero(np.diff(begin))
    expected = coordinates * (math.log(coordinates) + 2)
    while len(todo):
        size = np.diff(begin)[todo]
        at = np.repeat(begin[todo] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(todo)), size)
        mass = np.bincount(owner, weights[at], len(todo))
        element, rank, name = darts(hashes[at], weights[at], (expected / mass)[owner], seed)
        place = owner[element] * coordinates + (shingles.mix(name, 9) % np.uint64(coordinates)).astype(np.int64)
        best = np.full(len(todo) * coordinates, np.inf)
        np.minimum.at(best, place, rank)
        first = rank == best[place]
        filled = np.zeros(len(best), np.uint64)
        filled[place[first]] = name[first]
        full = np.isfinite(best.reshape(len(todo), coordinates)).all(axis=1)
        out[todo[full]] = filled.reshape(len(todo), coordinates)[full]
        todo, expected = todo[~full], expected * 2  # a place without a dart: look further out, which changes no other place
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), np.int64)
    for k in range(bands):
        x = np.full(len(signature), k, np.uint64)
        for value in signature[:, k * rows : (k + 1) * rows].T:
            x = shingles.mix(x ^ value, k)
        keys[:, k] = x.view(np.int64)
    return keys


def _classes(docs: DataFrame, threshold: float = shingles.THRESHOLD, width: int = shingles.WIDTH, bands: int = BANDS, rows: int = ROWS, seed: int = 0) -> DataFrame:
    def describe(column: pa.Array, hashes: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        signature = signatures(hashes, begin, count.astype(np.float64), bands * rows, seed)
        return band_keys(signature, bands, rows), components.sketch(signature)

    return components.near_classes(docs, describe, bands * rows, threshold, width, weighted=True)


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (least doc_id of the group of near copies), class_key (which tells classes of one least id
    apart), kept (whether the row stands for its class) of every row of ``docs`` (doc_id, text). Options: threshold,
    width, bands, rows, seed."""
    return _classes(docs, **options).select("doc_id", "class_id", "class_key", "kept")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row that stands for it (one of equal rows)."""
    chosen = _classes(docs.select("doc_id", "text"), **options).filter("kept").select(F.col("doc_id").alias("dart_id"), F.col("text_key").alias("dart_key")).distinct()
    named = docs.withColumn("dart_own_key", components.text_key(F.col("text").cast("string")))
    met = named.join(chosen, named.doc_id.cast("long").eqNullSafe(chosen.dart_id) & (named.dart_own_key == chosen.dart_key), "left_semi")
    return met.dropDuplicates(["doc_id", "dart_own_key"]).select(*(F.col(f"`{c}`") for c in docs.columns))
