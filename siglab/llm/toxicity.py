"""Toxicity by a classifier chain over hashed words.

Categories are predicted in a fixed order: each linear model sees the words of a text and the probabilities of
the categories before it, and was trained with out-of-fold predictions of those, so that it meets at training
what it will meet later. The last category is the label itself; the ones before it are drawn from the labelled
texts by their most telling words (see :func:`categories`). They are no categories that anybody labelled: ``labels``
has one flag, so "severe" and "abusive" are that flag for texts with three and with two telling words, derived targets
that only let the chain tell strong cases first. What the chain gains over one model is what a test measures on texts
that no choice saw. Folds are made of whole groups of equal texts, and for
each fold everything that looks at labels is learnt anew from the other folds: which words are used, which of them
mark toxicity, what the earlier categories are, and the weights.

Training is on a bounded sample of the labelled rows (``SAMPLE``, those of least hash of doc_id). Spark hashes and
counts their words; the driver gets counts of at most ``PLACES`` hashed words, and of each text the words that are
used. Scoring reads every whole text in blocks, in numpy, and needs no shuffle.

Nulls, empty texts, ties: a null text counts as empty and gets the probabilities of a text without known words.
Labels that are null or of unknown documents are left out; a document with several labels is toxic if any says
so. Equal rows get equal results, each its own. Without a toxic and a clean label every probability is the
share of toxic labels (0 without labels). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siglab.llm import shingles, storage

#: Labelled documents that the models are fitted on, at most.
SAMPLE = 6000
#: Hashed places of words, and how many of them a model may use.
PLACES = 1 << 20
USED = 4000
#: Least documents of the sample that hold a word which a model uses.
LEAST = 4
FOLDS = 4
RIDGE = 0.2
#: Bytes of the beginnings of words that count as words themselves.
PREFIXES = (4, 5, 6, 8)
THRESHOLD = 0.5
NAMES = ("severe", "abusive", "toxic")

_LETTERS = np.full(256, 32, np.uint8)
for _i in range(256):
    if 65 <= _i <= 90:
        _LETTERS[_i] = _i + 32
    elif 97 <= _i <= 122 or _i >= 128:
        _LETTERS[_i] = _i


def places(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of texts: the first one's index, how many, and the distinct (text, place) of its words."""
    raw, bounds = shingles.utf8(column)
    for first, last in shingles.blocks(bounds):
        at = bounds[first : last + 1]
        plain = _LETTERS[raw[at[0] : at[-1]]]
        starts, stops, begin = shingles.words(plain, at - at[0])
        owner = np.repeat(np.arange(last - first), np.diff(begin))
        found = [shingles.word_hashes(plain, starts, stops)]
        owners = [owner]
        for n in PREFIXES:
            long = stops - starts > n
            found.append(shingles.mix(shingles.word_hashes(plain, starts[long], starts[long] + n), n))
            owners.append(owner[long])
        place = (np.concatenate(found) % np.uint64(PLACES)).astype(np.int64)
        yield first, np.concatenate(owners), place


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: tuple[np.ndarray, np.ndarray], n: int, wide: int, more: np.ndarray, y: np.ndarray, ridge: float = RIDGE, turns: int = 120) -> np.ndarray:
    """Weights of a ridge logistic regression on 0/1 features (row, column pairs), dense columns ``more`` and a
    constant, by accelerated gradient descent with a step for each column."""
    at, column = rows
    size = np.bincount(column, minlength=wide).astype(float)
    most = np.bincount(at, minlength=n).max(initial=0) + (more**2).sum(axis=1).max(initial=0) + 1
    step = 4.0 / np.concatenate([np.minimum(size, n) * np.sqrt(most), np.full(more.shape[1], n * most), [n * np.sqrt(most)]]).clip(1)
    w = np.zeros(wide + more.shape[1] + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(turns):
        z = np.bincount(at, ahead[:wide][column], n) + more @ ahead[wide:-1] + ahead[-1]
        miss = _logistic(z) - y
        grad = np.concatenate([np.bincount(column, miss[at], wide), more.T @ miss, [miss.sum()]])
        pull = ridge * ahead
        pull[-1] = 0
        new = ahead - step * (grad + pull) / (1 + step * ridge)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (new - w) @ (ahead - new) > 0:
            t_new = 1.0
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


@dataclass
class Chain:
    """Models in order: ``columns`` maps a hashed place to a feature (-1: none), ``weights`` has a row for each category."""

    names: tuple[str, ...] = NAMES
    columns: np.ndarray | None = None
    weights: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def predict(self, owner: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        out = np.full((n, len(self.names)), self.base)
        if self.columns is None:
            return out
        column = self.columns[place]
        known = column >= 0
        wide = len(self.weights[0]) - 1
        pairs = np.unique(owner[known] * wide + column[known])
        at, column = pairs // wide, pairs % wide
        for k, w in enumerate(self.weights):
            out[:, k] = _logistic(np.bincount(at, w[:wide][column], n) + out[:, :k] @ w[wide:-1] + w[-1])
        return out


def telling(held: np.ndarray, toxic: np.ndarray, rows: int, bad: float, least: int, used: int) -> np.ndarray:
    """The places that tell the classes apart best, by the size of their log odds ratio over its error: from how
    many texts, and toxic texts, hold each place."""
    some = np.flatnonzero(held >= least)
    a = toxic[some] + 0.5
    b = held[some] - toxic[some] + 0.5
    c, d = bad - toxic[some] + 0.5, rows - bad - (held[some] - toxic[some]) + 0.5
    score = (np.log(a) - np.log(b) - np.log(c) + np.log(d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return some[np.argsort(-np.abs(score), kind="stable")[:used]]


def categories(at: np.ndarray, marks: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A column of 0/1 for each of :data:`NAMES`: toxic texts with at least three of the words that mark toxicity
    (severe), with at least two (abusive), and all toxic ones. ``at``, ``marks``: each text's words, and whether they mark it."""
    n = np.bincount(at[marks], minlength=len(y))
    return np.stack([y * (n >= 3), y * (n >= 2), y], axis=1)


def _outside(x: np.ndarray, f: int) -> np.ndarray:
    """Sums over all folds but ``f`` (-1: over all); a column for each fold."""
    return x.sum(axis=1) - (x[:, f] if f >= 0 else 0)


def chosen_words(place: np.ndarray, held: np.ndarray, toxic: np.ndarray, rows: np.ndarray, bad: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that a model without fold ``f`` uses, and whether they mark toxicity. ``held``, ``toxic``: of each place
    and fold, how many texts and toxic texts hold it; ``rows``, ``bad``: how many there are in each fold."""
    h, t = _outside(held, f), _outside(toxic, f)
    best = telling(h, t, _outside(rows[None], f)[0], _outside(bad[None], f)[0], LEAST, USED)
    return place[best], (t[best] >= 3) & (t[best] >= 0.9 * h[best])


def train(pairs: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, words: Sequence[tuple[np.ndarray, np.ndarray]]) -> Chain:
    """Fits the chain. ``pairs``: texts and the distinct places that they hold; ``words``: :func:`chosen_words` of
    each fold, then of all rows."""
    y, n = y.astype(float), len(y)
    base = float(y.mean()) if n else 0.0
    if not 0 < base < 1:
        return Chain(base=base)
    seen = []  # for each fold, then for all rows: the pairs of text and feature, the number of features, the categories
    for places_, marking in words:
        columns = np.full(PLACES, -1, np.int64)
        columns[places_] = np.arange(len(places_))
        known = columns[pairs[1]] >= 0
        at, column = pairs[0][known], columns[pairs[1][known]]
        seen.append(((at, column), max(len(places_), 1), categories(at, np.append(marking, False)[column], y)))
    unseen, chain = np.zeros((n, len(NAMES))), Chain(columns=columns, base=base)
    for k in range(len(NAMES)):
        for f in range(FOLDS if k < len(NAMES) - 1 else 0):
            inside, ((at, column), wide, target) = fold != f, seen[f]
            if not inside.any():
                continue
            row, use = np.cumsum(inside) - 1, inside[at]
            w = fit((row[at[use]], column[use]), int(inside.sum()), wide, unseen[inside, :k], target[inside, k])
            z = np.bincount(at, w[:wide][column], n) + unseen[:, :k] @ w[wide:-1] + w[-1]
            unseen[~inside, k] = _logistic(z)[~inside]
        (at, column), wide, target = seen[-1]
        chain.weights.append(fit((at, column), n, wide, unseen[:, :k], target[:, k]))
    return chain


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """text, toxic, fold of at most ``rows`` labelled documents, those of least hash of doc_id."""
    told = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    told = told.withColumn("u", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))  # below 2^63, evenly
    n = told.count()
    # Twice the share that is wanted holds the least ones, and keeps what is sorted bounded whatever the labels' number.
    near = told.filter(F.col("u") < (2**63 - 1) * min(n, 2 * rows + 100) // max(n, 1))
    drawn = near.orderBy("u", "doc_id").limit(rows).select("doc_id", "toxic")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = named.join(F.broadcast(drawn), "doc_id")  # ``rows`` pairs of numbers at most are broadcast
    return got.select("text", "toxic", F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(FOLDS)).cast("int").alias("fold"))


def learnt(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Chain:
    """The chain of a bounded sample of the labelled documents."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [*places(batch.column(0)), (len(batch), None, None)]
            for (first, owner, place), (last, *_) in zip(found, found[1:]):
                pairs = np.unique(owner * PLACES + place)
                begin = np.searchsorted(pairs // PLACES, np.arange(last - first + 1))
                listed = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(pairs % PLACES, pa.int32()))
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), listed], ["toxic", "fold", "places"])

    with storage.Scratch(docs.sparkSession) as scratch:
        features = scratch.keep(storage.spread(sample(docs, labels, rows)).mapInArrow(hashed, "toxic int, fold int, places array<int>"), "features")
        each = features.select("toxic", "fold", F.explode("places").alias("place"))
        by_fold = [f(F.when(F.col("fold") == k, x)) for k in range(FOLDS) for f, x in ((F.count, F.lit(1)), (F.sum, F.col("toxic")))]
        counted = each.groupBy("place").agg(F.count("*").alias("n"), *(x.alias(f"c{i}") for i, x in enumerate(by_fold))).filter(F.col("n") >= LEAST).drop("n").fillna(0).toArrow()
        order = np.argsort(counted["place"].to_numpy())
        place = counted["place"].to_numpy()[order]
        numbers = np.stack([counted[f"c{i}"].to_numpy() for i in range(2 * FOLDS)], axis=1)[order].astype(float)
        size = {r.fold: (r.n, r.bad) for r in features.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).collect()}
        whole, bad = (np.array([size.get(f, (0, 0))[i] for f in range(FOLDS)], float) for i in (0, 1))
        words = [chosen_words(place, numbers[:, 0::2], numbers[:, 1::2], whole, bad, f) for f in (*range(FOLDS), -1)]
        used = np.unique(np.concatenate([x for x, _ in words]))

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                listed = [x[np.isin(x, used)].astype("<i4").tobytes() for x in (y.values.to_numpy() for y in batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(listed, pa.binary())], ["toxic", "fold", "places"])

        got = features.mapInArrow(kept, "toxic int, fold int, places binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["places"], r["toxic"], r["fold"]))  # whatever the order of arrival
    held = [np.frombuffer(r["places"], "<i4") for r in got]
    pairs = np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate([*held, np.zeros(0, np.int32)]).astype(np.int64)
    return train(pairs, np.array([r["toxic"] for r in got], np.int64), np.array([r["fold"] for r in got], np.int64), words)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, a probability p_<category> for each category, and toxic (0/1: the last one
    is ``threshold`` or more). Rows are scored where they are read; nothing is shuffled."""
    chain = learnt(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(batch), len(chain.names)))
            # Block by block: a block ends where the next begins, so two are held at a time.
            for (first, owner, place), (last, *_) in itertools.pairwise(itertools.chain(places(batch.column(at)), [(len(batch), None, None)])):
                out[first:last] = chain.predict(owner, place, last - first)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x) for x in out.T)], [f.name for f in schema.fields])

    own = "text" in keep and dict(docs.dtypes)["text"] == "string"
    at = keep.index("text") if own else len(keep)
    whole = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = T.StructType([*(whole.schema[c] for c in keep), *(T.StructField(f"p_{x}", T.DoubleType()) for x in chain.names)])
    sent = [*keep] if own else [*keep, F.col("text").cast("string").alias("text_")]
    scored = storage.spread(whole.select(*sent)).mapInArrow(run, schema)
    return scored.withColumn("toxic", (F.col(f"p_{chain.names[-1]}") >= threshold).cast("int"))
