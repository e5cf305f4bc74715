"""Mixing sources to target weights by Poisson replication.

A source of ``n`` rows whose target share of ``total`` is ``w`` has the mean repetition rate ``w * total / n``.
A uniform number hashed from the row's content is put through the inverse Poisson distribution of that mean to give
the row's count: the row adds up the terms of its law itself, in about as many steps as it gets copies, so the plan
holds one number a source, however large. The row is exploded into as many copies, in lots of :data:`LOT`, and all
copies are ordered by a hash of (content, copy), dealt by ranges. Content is (seed, doc_id, source, MD5 of the text). Only DataFrame functions are used, no Python
runs on the rows.

Nulls, empty texts, ties: a null source is a source of its own; sources without a target weight have weight 0
and give no rows; weights of sources without rows are spread over the others by proportion. A null text counts as
a value of its own. Rows with a null or repeated doc_id draw by their texts; rows that are equal in doc_id, source
and text draw the same count, and their copies lie side by side. An empty table gives an empty result. Columns are
passed on whatever their names; only ``repeats_``, ``rate_``, ``copy_`` and ``mixed_at_``, which are added, must be
free, or a ValueError says so.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siglab.llm import storage

SEED = 17
#: Sources up to which rates are written into the plan; beyond, they are a table that is joined on the source.
LISTED = 2000
#: Copies of a row that are named at once.
LOT = 1024

ADDED = ("repeats_", "rate_", "copy_", "mixed_at_")


def content(seed: int) -> Column:
    """An MD5 sum of what a row is: the seed, its doc_id, its source and its text."""
    told = (F.coalesce(F.col(x).cast("string"), F.lit("~")) for x in ("doc_id", "source"))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *told, F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit("~"))).cast("binary"))


def uniform(sum_: Column) -> Column:
    """A number in [0, 1) in steps of 2^-52, from the first 13 hexadecimal digits of an MD5 sum."""
    return F.conv(F.substring(sum_, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def law(mean: float) -> list[float]:
    """The distribution function of a Poisson number at 0, 1, ... up to where doubles no longer tell it from 1."""
    if not mean > 0:
        return []
    term, total, out = math.exp(-mean), 0.0, []
    while len(out) < mean or term > 1e-17:
        total += term
        out.append(total)
        # From a mean of 700 the first terms underflow, so each is computed by itself.
        term = term * mean / len(out) if mean < 700 else math.exp(len(out) * math.log(mean) - mean - math.lgamma(len(out) + 1))
    return out


def tempered(counts: dict, temperature: float) -> dict:
    """Target weights in proportion to ``count ** temperature``: 1 keeps the shares, 0 makes sources equal."""
    raw = {k: float(v) ** temperature for k, v in counts.items() if v}
    return {k: v / sum(raw.values()) for k, v in raw.items()}


def count(u: Column, mean: Column) -> Column:
    """How many of the sums P(0), P(0) + P(1), ... of the Poisson law are at most ``u``: its inverse at ``u``, a number in [0, 1)."""
    # Beyond, a term is below 1e-25, so no sum still differs from 1 by a step of u.
    steps = F.sequence(F.lit(0), F.ceil(mean + 9 * F.sqrt(mean) + 20).cast("int"))

    def added(first: Column, term: Callable[[Column], Column], then: Callable[[Column, Column], Column]) -> Column:
        start = F.struct(first.alias("t"), F.lit(0.0).alias("c"), F.lit(0).alias("n"))
        more = lambda a, k: F.struct(then(a["t"], k).alias("t"), (a["c"] + term(a["t"])).alias("c"), (a["n"] + (a["c"] + term(a["t"]) <= u).cast("int")).alias("n"))
        return F.aggregate(steps, start, more, lambda a: a["n"])

    plain = added(F.exp(-mean), lambda t: t, lambda t, k: t * mean / (k + 1))
    # From a mean of 700 the first terms underflow, so their logarithms are carried.
    logs = added(-mean, F.exp, lambda t, k: t + F.log(mean / (k + 1)))
    return F.when(mean < 700, plain).otherwise(logs)


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, total: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with ``repeats_`` (its count), ``copy_`` (from 0), ``mixed_at_`` (what the result is ordered by), ``rate_``.

    ``weights``: target share by source (any positive scale); None for :func:`tempered` ones of the table itself.
    ``total``: expected rows of the result; None for as many as ``docs`` has.
    """
    if taken := [c for c in docs.columns if c.lower() in ADDED]:
        raise ValueError(f"The columns {', '.join(taken)} are added by mixing; rename them first.")
    counts = docs.groupBy("source").agg(F.count("*").alias("n_"))
    known = dict(counts.limit(LISTED + 1).collect())
    rates = rates_table(counts, weights, temperature, total) if len(known) > LISTED else None
    rate = _listed(known, weights, temperature, total) if rates is None else F.col("mixing_rate_")
    # The rates are written first, so that both sides have an exchange of their own and a source of many rows can be split.
    met = docs if rates is None else docs.join(storage.materialise(rates, "rates"), F.col("source").eqNullSafe(F.col("mixing_source_")))

    def lots(n: Column, sum_: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / LOT).cast("int")), lambda k: F.struct(n.alias("repeats_"), sum_.alias("mixing_sum_"), (k * LOT).cast("int").alias("mixing_lot_")))
        return F.when(n > 0, each)

    own = [F.col(f"`{c}`") for c in docs.columns]
    drawn = _once(rate, lambda m: _once(content(seed), lambda s: _once(uniform(s), lambda u: _once(count(u, m), lambda n: lots(n, s)))))
    some = met.select(*own, rate.alias("rate_"), F.inline(drawn))
    copies = F.sequence(F.col("mixing_lot_"), F.least(F.col("mixing_lot_") + LOT, F.col("repeats_")) - 1)
    named = F.transform(copies, lambda k: F.struct(k.alias("copy_"), F.md5(F.concat_ws("|", "mixing_sum_", k.cast("string")).cast("binary")).alias("mixed_at_")))
    return some.select(*own, "rate_", "repeats_", F.inline(named)).orderBy("mixed_at_")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, wherever and however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _listed(known: dict, weights: dict | None, temperature: float, total: int | None) -> Column:
    """The rate of a row's source, as the plan says it; null for a source without one."""
    shares = tempered(known, temperature) if weights is None else {k: float(w) for k, w in weights.items() if known.get(k)}
    whole = sum(shares.values())
    total = sum(known.values()) if total is None else total
    means = {k: w / whole * total / known[k] for k, w in shares.items() if w > 0}
    named = [y for k, v in means.items() if k is not None for y in (F.lit(k), F.lit(v))]
    rate = F.create_map(*named)[F.col("source")] if named else F.lit(None).cast("double")
    return F.when(F.col("source").isNull(), F.lit(means[None])).otherwise(rate) if None in means else rate


def rates_table(counts: DataFrame, weights: dict | None, temperature: float, total: int | None) -> DataFrame:
    """mixing_source_, mixing_rate_ of each source with rows and a weight. ``counts``: source, n_."""
    counts = storage.materialise(counts, "sources")
    if weights is None:
        raw = counts.withColumn("w_", F.pow(F.col("n_").cast("double"), F.lit(float(temperature))))
    else:
        kinds = StructType([StructField("k_", counts.schema["source"].dataType), StructField("w_", DoubleType())])
        stated = counts.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], kinds)
        raw = counts.join(stated, F.col("source").eqNullSafe(F.col("k_")), "left").drop("k_")
    whole, rows = raw.agg(F.sum("w_"), F.sum("n_")).first()
    whole = float(whole or 0)  # no source with a weight: no rate
    mean = F.col("w_") / F.lit(whole) * F.lit(float(rows if total is None else total)) / F.col("n_")
    return raw.filter("w_ > 0").select(F.col("source").alias("mixing_source_"), mean.alias("mixing_rate_")).filter("mixing_rate_ > 0")
