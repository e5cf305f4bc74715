"""Exact quantiles of whole groups without holding a group's values in one task.

``percentile`` keeps a count for every value of a group in one place. Here a first pass sketches each group and
brackets every wanted order statistic between two values; a second counts, exactly, what lies below each bracket and how
often each value within it occurs. The order statistic is then read off a running count of the few values that lie within.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch: its ranks are off by at most n / ACCURACY.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str], name: str = "quantiles", accuracy: int = ACCURACY) -> DataFrame:
    """keys and ``name``: for each probability, the value at place (n - 1) * p of the group's n sorted values, straight
    between the two nearest. Nulls and NaNs are no values; a group without values has nulls. Keys may be null.

    Brackets are twice as wide as the sketch's error, so they hold the order statistics; the count below is checked
    all the same, and a bracket that missed raises.
    """
    keys, probabilities = list(keys), [float(p) for p in probabilities]
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    slim = df.select(*keys, v.alias("v_"))
    slack = 2.0 / accuracy
    edges = [F.lit(min(max(p + side * slack, 0.0), 1.0)) for p in probabilities for side in (-1, 1)]
    sketch = slim.groupBy(*keys).agg(F.count("v_").alias("n_"), F.percentile_approx("v_", F.array(*edges), accuracy).alias("e_"), F.min("v_").alias("min_"), F.max("v_").alias("max_"))

    def bracket(i: int) -> Column:
        place = (F.col("n_") - 1) * probabilities[i]
        # Few values are taken whole: the sketch's ranks are then off by less than one, but so is the slack.
        small = F.col("n_") <= 2 * accuracy
        low, high = F.when(small, F.col("min_")).otherwise(F.get("e_", 2 * i)), F.when(small, F.col("max_")).otherwise(F.get("e_", 2 * i + 1))
        return F.struct(F.lit(i).alias("i_"), place.alias("place_"), low.alias("low_"), high.alias("high_"))

    brackets = sketch.select(*(F.col(k).alias(f"{k}__") for k in keys), F.array(*map(bracket, range(len(probabilities)))).alias("b_"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}__"))
    met = slim.filter("v_ is not null").join(brackets, same).select(*keys, "v_", "b_")
    below = [F.count_if(F.col("v_") < F.get("b_", i)["low_"]).alias(f"below_{i}") for i in range(len(probabilities))]
    counted = met.groupBy(*keys).agg(*below, F.any_value("b_").alias("b_"))
    within = met.select(*keys, "v_", F.explode(F.filter("b_", lambda b: F.col("v_").between(b["low_"], b["high_"]))).alias("b"))
    values = within.groupBy(*keys, F.col("b.i_").alias("i_"), "v_").agg(F.count("*").alias("n_"))
    upto = Window.partitionBy(*keys, "i_").orderBy("v_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = values.withColumn("last_", F.sum("n_").over(upto))
    base = counted.select(*(F.col(k).alias(f"{k}__") for k in keys), F.explode(F.transform(F.array(*(F.struct(F.col(f"below_{i}").alias("below_"), F.get("b_", i).alias("b")) for i in range(len(probabilities)))), lambda x: x)).alias("x"))
    base = base.select(*(f"{k}__" for k in keys), F.col("x.b.i_").alias("j_"), F.col("x.below_").alias("below_"), F.col("x.b.place_").alias("place_"))
    met = summed.join(base, same & (F.col("i_") == F.col("j_")))
    first, last = F.col("below_") + F.col("last_") - F.col("n_"), F.col("below_") + F.col("last_") - 1
    holds = lambda k: F.when((first <= k) & (k <= last), F.col("v_"))
    low, high = F.floor("place_"), F.ceil("place_")
    found = met.groupBy(*keys, "i_", "place_").agg(F.max(holds(low)).alias("a_"), F.max(holds(high)).alias("c_"))
    missed = F.col("a_").isNull() | F.col("c_").isNull()
    exact = F.when(missed, F.raise_error(F.lit("The bracket of a quantile missed it.")).cast("double")).when(F.col("a_") == F.col("c_"), F.col("a_"))
    exact = exact.otherwise((high - F.col("place_")) * F.col("a_") + (F.col("place_") - low) * F.col("c_"))
    told = found.withColumn("q_", exact).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i_", "q_"))).alias("m_"))
    told = told.select(*(F.col(k).alias(f"{k}__") for k in keys), "m_")
    groups = sketch.select(*keys)
    return groups.join(told, same, "left").select(*keys, F.array(*(F.try_element_at("m_", F.lit(i)) for i in range(len(probabilities)))).alias(name))
