"""A trie of conversation prefixes, its totals found by leaf peeling.

A node is a distinct sequence of first turns (role, text); it is known by two 64-bit hashes of four sums over its
turns, of hashes of (depth, role, text): sums run along a conversation chunk by chunk, so one long conversation is
the work of many tasks. Texts cross the network once, to be put in order; from then on rows hold hashes and counts.

Totals of subtrees are found by passing messages upwards. A node holds a counter of children that aren't complete,
and the exclusive-or of their names. A leaf is complete at once; complete nodes send their totals to their parents,
which add them up and lower their counters, until the root is complete. A node whose counter stands at one knows
its last child by name: it takes over what that child has so far and the child's own last child (chains are jumped in
doubling steps), so the rounds grow with the logarithm of the trie's size, not with its depth. Nodes that
one conversation alone passes through save nothing and have one leaf below, so they send no message.

A node's ending conversations are hashed as a stream of chunks of 4,096 ids each, sorted; no group is held whole.

Nulls, empty texts, ties: a null ``role`` or ``text`` counts as empty; an empty text has no words; a null ``turn``
comes first. Turns with equal numbers are put in order by role, then text; repeated rows are turns of their own. Rows
with a null ``conv_id`` belong to no conversation and take no part. A conversation without turns is a member of
the root. An empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglab.functions import chunks
from siglab.llm import storage

#: Turn numbers, and turns of a rebuilt conversation, that one task puts in order or adds up.
TURNS_A_CHUNK = 1024
#: Width of a range of ids that is one row in the hash of a node's ending conversations.
IDS_A_CHUNK = 4096
#: Conversations that share the beginning of the first of them, and the number of lengths such a beginning can have.
FAMILY, LENGTHS = 20, 4

_MASK = (1 << 32) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place of the turn, from 0), two hashes of (role, text), words: a row for each turn."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text).filter("conv_id is not null")
    bucket = F.coalesce(F.floor(F.col("turn") / TURNS_A_CHUNK), F.lit(-(1 << 60)))
    placed = chunks.numbered(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], bucket, "at")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return placed.select("conv_id", "at", F.xxhash64("role", "text").alias("ta"), F.xxhash64(F.lit(7), "text", F.lit(11), "role").alias("tb"), words.alias("words"))


def regrown(turns: DataFrame, family: int = FAMILY, lengths: int = LENGTHS) -> DataFrame:
    """Conversations that begin with the first turns of their family's first: conv_id, depth (from 1; 0 for one row
    that each conversation has besides), ta, tb, words, last (the deepest row of its conversation).

    ``turns`` as :func:`turns` gives them. Of conversation c, the first ``crc32(c) mod lengths`` turns are replaced by
    those of conversation ``c - c mod family``. A family's first turns are at most ``lengths - 1`` and go to at most
    ``2 * family - 1`` conversations, so no key of this join is hot.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(lengths))
    known = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    first = turns.filter((F.col("conv_id") % family == 0) & (F.col("at") < lengths - 1))
    leads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "ta", "tb", "words"))).alias("lead"))
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("h").cast("int")), F.array())
    whole = known.join(leads, "base", "left").select("conv_id", "n", "h", lead.alias("lead")).withColumn("led", F.size("lead").cast("long"))
    total = F.col("led") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    own = turns.join(whole.select("conv_id", "n", "h", "led"), "conv_id").filter("at >= h")
    depth = F.col("at") - F.col("h") + F.col("led") + 1
    own = own.select("conv_id", depth.alias("depth"), "ta", "tb", "words", (F.col("at") == F.col("n") - 1).alias("last"))
    zero = F.lit(0).cast("long")
    led = whole.select("conv_id", total.alias("total"), F.posexplode("lead").alias("k", "t")).select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), "t.ta", "t.tb", "t.words", (F.col("k") + 1 == F.col("total")).alias("last"))
    roots = whole.select("conv_id", zero.alias("depth"), zero.alias("ta"), zero.alias("tb"), zero.alias("words"), (total == 0).alias("last"))
    return own.unionByName(led).unionByName(roots)


def paths(rows: DataFrame) -> DataFrame:
    """``rows`` (as of :func:`regrown`) as steps of paths from the root: conv_id, depth, words, last, the node's names a, b and its parent's pa, pb."""
    deep = rows.filter("depth > 0")
    one, two = F.xxhash64("depth", "ta", "tb"), F.xxhash64("tb", "depth", "ta")
    lanes = {"k1": one.bitwiseAND(_MASK), "k2": F.shiftrightunsigned(one, 32), "k3": two.bitwiseAND(_MASK), "k4": F.shiftrightunsigned(two, 32)}
    summed = chunks.scanned(deep.withColumns(lanes).withColumn("chunk_", F.floor((F.col("depth") - 1) / TURNS_A_CHUNK)), ["conv_id"], {f"s{k[1]}": (F.sum, F.col(k), chunks.plus) for k in lanes}, by="depth")
    here, above = [F.col(f"s{i}") for i in range(1, 5)], [F.col(f"s{i}") - F.col(f"k{i}") for i in range(1, 5)]
    name = lambda depth, s: (F.xxhash64(depth, *s), F.xxhash64(*reversed(s), depth))
    (a, b), (pa_, pb_) = name(F.col("depth"), here), name(F.col("depth") - 1, above)
    steps = summed.select("conv_id", "depth", "words", "last", a.alias("a"), b.alias("b"), pa_.alias("pa"), pb_.alias("pb"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = name(zero, [zero] * 4)
    roots = rows.filter("depth = 0").select("conv_id", "depth", "words", "last", top[0].alias("a"), top[1].alias("b"), none.alias("pa"), none.alias("pb"))
    return steps.unionByName(roots)


def _nodes(steps: DataFrame) -> DataFrame:
    """A row for each node; ``shared`` where two conversations or more pass through, and at the root."""
    same = [F.min(c).alias(c) for c in ("depth", "words", "pa", "pb")]
    ends = F.when(F.col("last"), F.col("conv_id"))
    each = steps.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), *same, F.count("*").alias("n_convs"), F.count(ends).alias("n_ends"), F.min(ends).alias("an_end"))
    return each.withColumn("shared", (F.col("n_convs") > 1) | (F.col("depth") == 0))


def _start(nodes: DataFrame) -> DataFrame:
    """The shared nodes before any message: ``rem`` children to wait for, ``xa`` and ``xb`` the exclusive-or of their
    names, ``saved`` and ``leaves`` so far, ``fresh`` if just complete."""
    mine = lambda c: F.when(F.col("shared"), F.col(c))
    below = nodes.filter("depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("n_children"), F.count(mine("a")).alias("rem"), F.bit_xor(mine("a")).alias("xa"), F.bit_xor(mine("b")).alias("xb"))
    below = below.withColumnsRenamed({"pa": "ca", "pb": "cb"})
    zero = F.lit(0).cast("long")
    held = nodes.filter("shared").join(below, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")), "left").drop("ca", "cb").withColumns({c: F.coalesce(c, zero) for c in ("n_children", "rem", "xa", "xb")})
    lone = F.col("n_children") - F.col("rem")
    totals = {"saved": (F.col("n_convs") - 1) * F.col("words"), "leaves": F.when(F.col("n_children") == 0, 1).otherwise(lone).cast("long"), "fresh": F.col("rem") == 0}
    return held.withColumns(totals).drop("shared", "words")


def _round(state: DataFrame) -> DataFrame:
    """One round of messages. Nodes that wait for several children hear from those just complete; nodes that wait for one
    look at it: they take its totals if it is complete, or take its place in the chain if it waits for one itself."""
    own = state.columns
    sent = state.filter("fresh").groupBy("pa", "pb").agg(F.count("*").alias("dn"), F.sum("saved").alias("ds"), F.sum("leaves").alias("dl"), F.bit_xor("a").alias("ya"), F.bit_xor("b").alias("yb")).withColumnsRenamed({"pa": "ma", "pb": "mb"})
    zero = F.lit(0).cast("long")
    heard = state.filter("rem > 1").join(sent, (F.col("a") == F.col("ma")) & (F.col("b") == F.col("mb")), "left")
    heard = heard.withColumns({c: F.coalesce(c, zero) for c in ("dn", "ds", "dl", "ya", "yb")})
    heard = heard.withColumns({"rem": F.col("rem") - F.col("dn"), "saved": F.col("saved") + F.col("ds"), "leaves": F.col("leaves") + F.col("dl"), "xa": F.col("xa").bitwiseXOR(F.col("ya")), "xb": F.col("xb").bitwiseXOR(F.col("yb"))})
    heard = heard.withColumn("fresh", F.col("rem") == 0)
    seen = state.select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("rem").alias("ur"), F.col("saved").alias("us"), F.col("leaves").alias("ul"), F.col("xa").alias("wa"), F.col("xb").alias("wb")).filter("ur < 2")
    jumped = state.filter("rem = 1").join(seen, (F.col("xa") == F.col("ua")) & (F.col("xb") == F.col("ub")), "left")
    jumped = jumped.withColumns({
        "saved": F.col("saved") + F.coalesce("us", zero), "leaves": F.col("leaves") + F.coalesce("ul", zero), "rem": F.coalesce("ur", F.lit(1).cast("long")),
        "xa": F.coalesce("wa", "xa"), "xb": F.coalesce("wb", "xb"), "fresh": F.coalesce(F.col("ur") == 0, F.lit(False)),
    })
    return state.filter("rem = 0").withColumn("fresh", F.lit(False)).select(*own).unionByName(heard.select(*own)).unionByName(jumped.select(*own))


def _peeled(state: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """Rounds of messages until every node is complete; each round's state is written, and the one before deleted."""
    state = scratch.keep(state, "trie-state")
    while not state.filter("rem > 0").isEmpty():
        then = scratch.keep(_round(state), "trie-state")
        scratch.drop(state)
        state = then
    return state


def _several_ends(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes where two conversations or more end, with the hash of their ids: ea, eb, ends."""
    many = nodes.filter("n_ends > 1").select(F.col("a").alias("ea"), F.col("b").alias("eb"))
    met = steps.filter("last").join(many, (F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb"))).select("ea", "eb", "conv_id")
    part = F.floor(F.col("conv_id") / IDS_A_CHUNK)
    told = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = met.groupBy("ea", "eb", part.alias("part")).agg(told.alias("ids"))
    ordered = parts.repartition("ea", "eb").sortWithinPartitions("ea", "eb", "part").select("ea", "eb", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digest, done = None, hashlib.sha256(), []
        for batch in batches:
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != of:
                    if of is not None:
                        done.append((*of, digest.hexdigest()))
                    of, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("ea", "eb", "ends"), x)) for x in done])
                done = []
        if of is not None:
            yield pa.RecordBatch.from_pylist([{"ea": of[0], "eb": of[1], "ends": digest.hexdigest()}])

    return ordered.mapInArrow(run, "ea long, eb long, ends string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of conversations in the form of :func:`regrown`: conv_id (the least that passes), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    with storage.Scratch(spark) as scratch:
        steps = scratch.keep(paths(rows), "trie-steps")
        nodes = scratch.keep(_nodes(steps), "trie-nodes")
        peeled = _peeled(_start(nodes), scratch)
        shared = peeled.select("a", "b", "pa", "pb", "conv_id", "depth", "n_convs", "n_ends", "an_end", "n_children", "saved", "leaves")
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        lone = nodes.filter("not shared").withColumns({"n_children": one - F.col("n_ends"), "saved": zero, "leaves": one}).select(*shared.columns)
        above = peeled.select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("conv_id").alias("above"))
        told = shared.unionByName(lone).join(above, (F.col("pa") == F.col("ua")) & (F.col("pb") == F.col("ub")), "left")
        ends = _several_ends(steps, nodes)
        told = told.join(ends, (F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb")), "left")
        # Below a node that one conversation alone passes through, the parent is that conversation's too.
        parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
        digest: Column = F.when(F.col("n_ends") == 0, F.lit(_EMPTY)).when(F.col("n_ends") == 1, F.sha2(F.col("an_end").cast("string").cast("binary"), 256)).otherwise(F.col("ends"))
        told = told.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), digest.alias("ends_sha256"))
        return storage.materialise(told, "trie")


def of_conversations(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations; the turns, without their texts, are written once."""
    with storage.Scratch(conversations.sparkSession) as scratch:
        return trie(regrown(scratch.keep(turns(conversations), "trie-turns")))
