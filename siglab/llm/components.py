"""From candidate buckets to verified links to classes, without ever listing the pairs of a group.

Rows are known by a row number, never by ``doc_id``, so texts that share an id stay apart. Texts with the same
elements (shingles, or with ``weighted`` shingles and their occurrences) are one node from the start, however many
they are. Each bucket has one leader, its least node, which a partial aggregate finds whatever the bucket's size. A
node is compared with all leaders of its buckets. Buckets that are then one class are done. The nodes of the
others are keyed anew, by the rarest fifth of their elements (prefix filtering), which is exact: nodes that are alike enough share such a key, while
nodes that share only what many have do not.
There more and more leaders, those of low hash, meet their buckets, and leave them, until every two nodes of a bucket that
are of different classes have been compared: first, within the join itself, by length, by the places of the
shared key (what is behind them must suffice for the overlap) and by sketches of their signatures, then by their
elements. Between turns a class takes the least that it is linked with, which may leave some apart for a turn; at the
end all links become classes by passing on the least node, with pointer jumping.

Every step is written to the shared folder and deleted when its successor is there; a lost executor costs no more
than the tasks of one step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglab.llm import shingles, storage

#: About how many leaders a prefix bucket has in the first turn, and by how much each further turn multiplies them. A
#: turn makes about as many rows as entries times leaders, and few leaders suffice for most of a large group to join.
FIRST, LEADERS = 16, 16
#: Frequent hashes that the order of prefixes knows.
LISTED = 50_000
#: Parts that the rows of one class are dealt to where they look up its name.
SALTS = 8

Describe = Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def sketch(coordinates: np.ndarray) -> np.ndarray:
    """Four bits of each signature coordinate, packed into 64-bit numbers."""
    n, k = coordinates.shape
    nibbles = np.zeros((n, -(-k // 16) * 16), np.uint64)
    nibbles[:, :k] = shingles.mix(coordinates.astype(np.uint64), 21) >> np.uint64(60)
    shifted = nibbles.reshape(n, -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(shifted, axis=2).view(np.int64)


def differing(k: int, threshold: float) -> int:
    """Bits of two sketches of ``k`` coordinates that may differ at that similarity: the mean and six deviations,
    which a pair at the threshold exceeds less than once in ten million."""
    q = 1 - threshold
    return math.ceil(2 * k * q + 6 * math.sqrt(k * (5 * q - 4 * q * q)))


def _every_salt() -> Column:
    return F.explode(F.lit([*range(SALTS)]).cast("array<long>"))


def connected(links: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """node, class_id (least node of its component) of every node in ``links`` (a, b)."""
    both = scratch.keep(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "both-ways")
    label = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("class_id")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("class_id").alias("m"))
        step = label.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("class_id").alias("was"), F.least("class_id", "m").alias("class_id"))
        # Where a class has a lower label itself, its nodes take that one. Both sides have an exchange of their own, so
        # adaptive execution can split the rows of a large class.
        up = label.filter("node <> class_id").select(F.col("node").alias("class_id"), F.col("class_id").alias("up"))
        new = scratch.keep(step.join(up, "class_id", "left").select("node", "was", F.coalesce("up", "class_id").alias("class_id")), "labels")
        scratch.drop(label)
        label, moved = new, not new.filter("was <> class_id").isEmpty()
        if not moved:
            scratch.drop(both)
            return label


def hooked(links: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """node, class_id of every node that ``links`` (a, b) link to a lesser one: it takes the least of those, that one's own
    and so on. Nodes of one class are connected, but some that are connected may be left apart: of two links of a node
    to lesser ones, only one counts. :func:`connected` says all; this costs a few exchanges."""
    ends = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).filter("node <> to")
    label = scratch.keep(ends.groupBy("node").agg(F.min("to").alias("class_id")), "labels")
    while True:
        up = label.select(F.col("node").alias("class_id"), F.col("class_id").alias("up"))
        new = scratch.keep(label.join(up, "class_id", "left").select("node", F.coalesce("up", "class_id").alias("class_id"), F.col("up").isNotNull().alias("moved")), "labels")
        scratch.drop(label)
        label = new
        if label.filter("moved").isEmpty():
            return label


def text_key(text: Column) -> Column:
    """By which the rows of one ``doc_id`` are told apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _named(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))


def elements(batch: pa.Array, width: int, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, where each text's begin, their counts; then the elements that similarity is about, and
    where those begin: the same hashes, or with ``weighted`` one for each occurrence, so that the Jaccard similarity
    of elements is the weighted one of shingle counts."""
    raw, at = shingles.utf8(batch)
    found, begin = shingles.shingle_hashes(raw, at, width)
    found, begin, count = shingles.distinct(found, begin)
    if not weighted or not (count > 1).any():
        return found, begin, count, found, begin
    total = np.concatenate([[0], np.cumsum(count)])
    nth = np.arange(total[-1]) - np.repeat(total[:-1], count)
    each = np.repeat(found, count)
    later = nth > 0
    each[later] = shingles.mix(each[later] ^ (nth[later].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 31)
    begin_each = total[begin]
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin_each))
    return found, begin, count, each[np.lexsort((each, owner))], begin_each


def _binary(each: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The upper 32 bits of each text's elements, ascending, as bytes."""
    low = (each >> np.uint64(32)).astype(np.uint32)
    return pa.array([low[x:y].tobytes() for x, y in zip(begin[:-1], begin[1:])], pa.binary())


def describe_texts(docs: DataFrame, describe: Describe, width: int, weighted: bool, store: bool) -> DataFrame:
    """doc_id, text_key, set_a, set_b (two hashes of the elements), keys (of buckets), hashes (32 bits of each element,
    ascending; null without ``store``), size (how many), bits (the sketch)."""

    def listed(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, bounds = shingles.utf8(whole.column(2))
            for first, last in shingles.blocks(bounds):
                batch = whole.slice(first, last - first)
                found, begin, count, each, begin_each = elements(batch.column(2), width, weighted)
                has, sums = np.flatnonzero(np.diff(begin_each)), np.zeros((2, len(batch)), np.uint64)
                for k in range(2):
                    if len(has):
                        sums[k, has] = np.add.reduceat(shingles.mix(each, 11 + k), begin_each[has])
                keys, bits = describe(batch.column(2), found, begin, count)
                sets = _binary(each, begin_each) if store else pa.nulls(len(batch), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), listed(keys), sets, pa.array(np.diff(begin_each), pa.int64()), listed(bits)],
                    ["doc_id", "text_key", "set_a", "set_b", "keys", "hashes", "size", "bits"],
                )

    return storage.spread(_named(docs).select("doc_id", "text_key", "text")).mapInArrow(run, "doc_id long, text_key long, set_a long, set_b long, keys array<long>, hashes binary, size long, bits array<long>")


def hashes_again(docs: DataFrame, wanted: DataFrame, width: int, weighted: bool) -> DataFrame:
    """node, hashes, size of ``wanted`` (node, doc_id, text_key), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, bounds = shingles.utf8(whole.column(1))
            for first, last in shingles.blocks(bounds):
                batch = whole.slice(first, last - first)
                *_, each, begin = elements(batch.column(1), width, weighted)
                yield pa.RecordBatch.from_arrays([batch.column(0), _binary(each, begin), pa.array(np.diff(begin), pa.int64())], ["node", "hashes", "size"])

    mine = wanted.select("node", F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    named = _named(docs)
    met = named.join(mine, named.doc_id.eqNullSafe(mine.id) & (named.text_key == mine.key)).select("node", "text")
    return met.mapInArrow(run, "node long, hashes binary, size long").dropDuplicates(["node"])


def _alike(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (([np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(k)]) for k in ("x", "y"))
            ok = np.array([shingles.jaccard(one, other) >= threshold for one, other in zip(x, y)], bool)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def frequent(sets: DataFrame, scratch: storage.Scratch, most: int = LISTED) -> dict[int, int]:
    """Hashes that many of the sets hold, with about how many: counted within tasks, those met twice there or more
    added up, the highest, ``most`` at most. Only the order of hashes comes from it, so it changes costs, never results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(0)]
            value, n = np.unique(np.concatenate(whole) if whole else np.zeros(0, np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["h", "n"])

    counted = scratch.keep(sets.select("hashes").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    step = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for level, n in sorted(counted.groupBy(step.alias("level")).count().collect(), reverse=True):  # some hundred levels
        if total + n > most:
            break
        total, least = total + n, level
    out = dict(counted.filter(step >= least).collect()) if least is not None else {}
    scratch.drop(counted)
    return out


def prefixes(sets: DataFrame, threshold: float, often: dict[int, int]) -> DataFrame:
    """node, key, pos (place in the order) for the rarest hashes of each set: two sets that are alike enough share at least one of them.

    Sets of a similarity of t or more share at least t of the larger one, so they can't miss each other in all of
    the first ``n - ceil(t * n) + 1`` hashes of one common order; with rare hashes first, few others share one.
    """
    names = np.array(sorted(often), np.int64)
    held = np.array([often[x] for x in names.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, key, pos = [], [], []
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.unique(np.frombuffer(x.as_buffer(), np.uint32)).astype(np.int64)
                weight = np.zeros(len(own), np.int64)
                if len(names):
                    at = np.searchsorted(names, own).clip(max=len(names) - 1)
                    weight = np.where(names[at] == own, held[at], 0)
                first = own[np.lexsort((own, weight))][: len(own) - math.ceil((threshold - 1e-9) * len(own)) + 1]
                pos.append(np.arange(len(first), dtype=np.int32))
                node.append(np.full(len(first), name, np.int64))
                key.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node) if node else np.zeros(0, np.int64)), pa.array(np.concatenate(key) if key else np.zeros(0, np.int64)), pa.array(np.concatenate(pos) if pos else np.zeros(0, np.int32))], ["node", "key", "pos"])

    return sets.select("node", "hashes").mapInArrow(run, "node long, key long, pos int")


def _several(entry: DataFrame, classes: DataFrame | None, scratch: storage.Scratch) -> DataFrame | None:
    """``entry`` where a bucket (key) has several classes, with ``n``, the bucket's rows; None where none has. A class_id
    that is a node of ``classes`` becomes that node's class first."""
    own = [c for c in entry.columns if c not in ("class_id", "n")]
    told = entry.select("class_id", *own)
    if classes is not None:
        now = classes.select(F.col("node").alias("class_id"), F.col("class_id").alias("now"))
        told = told.join(now, "class_id", "left").select(F.coalesce("now", "class_id").alias("class_id"), *own)
    told = scratch.keep(told, "classed")
    several = told.groupBy("key").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y"), F.count("*").alias("n")).filter("x <> y").select("key", "n")
    rest = scratch.keep(told.join(several, "key"), "unsettled")
    scratch.drop(told)
    if not rest.isEmpty():
        return rest
    scratch.drop(rest)
    return None


def _differ(wide: range) -> Column:
    """Bits in which two sketches b0, b1, ... and c0, c1, ... differ."""
    return sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"c{k}"))) for k in wide), F.lit(0))


def _linked(pairs: DataFrame, sets: DataFrame, coordinates: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b; some of them repeated) that are alike enough: by length and sketch first, then by their elements.

    Pairs are dealt by b, of which each has few, for both their repeats and b's sketch; then a's sketch and elements are
    met, where adaptive execution can split those of one a; only what is likely meets b's elements."""
    wide = range(-(-coordinates // 16))
    brief = lambda bit: (F.get("bits", k).alias(f"{bit}{k}") for k in wide)
    once = pairs.select("a", "b").repartition("b").distinct().join(sets.select(F.col("node").alias("b"), F.col("size").alias("n"), *brief("b")), "b")
    both = once.join(sets.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("hashes").alias("x"), *brief("c")), "a")
    likely = both.filter((_differ(wide) <= differing(coordinates, threshold)) & (F.least("m", "n") >= F.lit(threshold - 1e-9) * F.greatest("m", "n")))
    met = likely.select("a", "b", "x").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(_alike(threshold), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the classes (low, high) of pairs of nodes (one, other; some of them repeated) whose elements
    are alike enough; ``sets``: node, hashes, size. Pairs are dealt by ``one``, of which each has few."""
    once = pairs.select("one", "other", "low", "high").repartition("one").distinct()
    met = once.join(sets.select(F.col("node").alias("one"), F.col("hashes").alias("x"), F.col("size").alias("m")), "one")
    both = met.join(sets.select(F.col("node").alias("other"), F.col("hashes").alias("y"), F.col("size").alias("n")), "other")
    possible = both.filter(F.least("m", "n") >= F.lit(threshold - 1e-9) * F.greatest("m", "n"))
    return possible.select(F.col("low").alias("a"), F.col("high").alias("b"), "x", "y").mapInArrow(_alike(threshold), "a long, b long")


def _leads(lots: int) -> Column:
    """Whether a row leads its bucket of n rows in the turn of so many leaders: all do where that many suffice, else
    those whose node has a low hash, so that one node leads in many of its buckets."""
    return (F.col("n") <= lots) | (F.pmod(F.xxhash64("node", F.lit(lots)), F.lit(1 << 31)) * F.col("n") < F.lit(lots << 31))


def _settle(left: DataFrame, classes: DataFrame, coordinates: int, threshold: float, scratch: storage.Scratch) -> list[DataFrame]:
    """Links (a, b), between nodes or classes, once all pairs of the sets ``left`` that could be linked have been compared by
    prefix buckets, but for those whose class was known to be one; ``classes`` are those known from before."""
    wide, found = range(-(-coordinates // 16)), []
    keyed = prefixes(left, threshold, frequent(left, scratch)).join(left.select("node", "size", *(F.get("bits", k).alias(f"b{k}") for k in wide)), "node")
    entry = scratch.keep(keyed.withColumn("class_id", F.col("node")), "prefixes")
    rest, lots = _several(entry, classes, scratch), FIRST
    scratch.drop(entry)
    enough = F.least(F.col("size") - F.col("pos"), F.col("long") - F.col("place")) >= (F.col("size") + F.col("long")) * (threshold / (1 + threshold)) - 1e-6
    told = {"leader": "node", "led": "class_id", "long": "size", "place": "pos"} | {f"c{k}": f"b{k}" for k in wide}
    while rest is not None:
        leader = rest.filter(_leads(lots)).select("key", *(F.col(y).alias(x) for x, y in told.items()))
        once = ~_leads(lots) | (F.col("node") > F.col("leader"))
        met = rest.join(leader, "key").filter((F.col("class_id") != F.col("led")) & once & enough & (_differ(wide) <= differing(coordinates, threshold)))
        pairs = met.select(F.col("node").alias("one"), F.col("leader").alias("other"), F.least("class_id", "led").alias("low"), F.greatest("class_id", "led").alias("high"))
        found.append(scratch.keep(verified(pairs, left, threshold), "links"))
        others, was, now = rest.filter(~_leads(lots)), rest, None  # leaders have met all of their buckets
        if others.isEmpty():
            rest = None
        else:
            now = None if found[-1].isEmpty() else hooked(found[-1], scratch)
            rest, lots = _several(others, now, scratch), lots * LEADERS
        scratch.drop(was, now)
    return found


def near_classes(docs: DataFrame, describe: Describe, coordinates: int, threshold: float = shingles.THRESHOLD, width: int = shingles.WIDTH, weighted: bool = False, store: bool = True) -> DataFrame:
    """doc_id, text_key, class_id, class_key, kept of every row: the least doc_id among the texts that are linked to its
    own (null if none has an id) with its text_key, and whether the row is that one (equal rows all are).

    ``describe`` gives for texts (column, their distinct hashes, where each text's begin, their counts) an int64 array
    with a bucket key in each column, and the :func:`sketch` of their ``coordinates`` signature values. Without
    ``store`` the elements of texts that share a bucket are computed again from the texts, instead of kept for all.
    """
    spark = docs.sparkSession
    with storage.Scratch(spark, broadcasts=False) as scratch:  # both sides of every join here grow with the table
        told = scratch.keep(describe_texts(docs, describe, width, weighted, store).withColumn("row", F.monotonically_increasing_id()), "described")
        first = scratch.keep(told.groupBy("set_a", "set_b").agg(F.min("row").alias("node")), "nodes")
        keys = F.when((F.col("row") == F.col("node")) & (F.col("size") > 0), F.col("keys")).alias("keys")  # a node has one row's
        member = scratch.keep(told.select("doc_id", "text_key", "set_a", "set_b", "row", "size", "keys").join(first, ["set_a", "set_b"]).select("doc_id", "text_key", "node", keys), "members")
        each = member.filter("keys is not null").select("node", F.explode("keys").alias("key"))
        leader = scratch.keep(each.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader"), "leaders")
        entry = scratch.keep(each.join(leader, "key"), "entries")
        scratch.drop(first, leader)
        about = told.join(entry.select(F.col("node").alias("row")).distinct(), "row", "left_semi").withColumnRenamed("row", "node")
        if store:
            sets = scratch.keep(about.select("node", "hashes", "size", "bits"), "sets")
            scratch.drop(told)
        else:
            slim = scratch.keep(about.select("node", "doc_id", "text_key", "bits"), "candidates")
            scratch.drop(told)
            sets = scratch.keep(hashes_again(docs, slim, width, weighted).join(slim.select("node", "bits"), "node"), "sets")
            scratch.drop(slim)
        # First each node meets the leaders of its buckets; then what is in buckets that still have several classes goes on.
        links = scratch.keep(_linked(entry.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")), sets, coordinates, threshold), "links")
        classes = hooked(links, scratch)
        rest = _several(entry.select("node", "key", F.col("node").alias("class_id")), classes, scratch)
        scratch.drop(entry)
        if rest is not None:
            left = scratch.keep(sets.join(rest.select("node").distinct(), "node", "left_semi"), "unsettled-sets")
            scratch.drop(rest, sets)
            for more in _settle(left, classes, coordinates, threshold, scratch):
                links = links.union(more)
            scratch.drop(left)
        scratch.drop(classes)
        classes = connected(links, scratch)
        place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
        own = member.join(classes.select("node", "class_id"), "node", "left").select("doc_id", "text_key", F.coalesce("class_id", "node").alias("class"))
        own = scratch.keep(own, "own-classes")
        least = own.groupBy("class").agg(F.min(place).alias("least"))
        salted = own.withColumn("salt", F.pmod("text_key", F.lit(SALTS))).join(least.withColumn("salt", _every_salt()), ["class", "salt"])
        return storage.materialise(salted.select("doc_id", "text_key", F.col("least.id").alias("class_id"), F.col("least.key").alias("class_key"), place.eqNullSafe(F.col("least")).alias("kept")), "classes")
