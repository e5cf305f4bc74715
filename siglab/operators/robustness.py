"""Bootstrap of returns, overfitting gap, robustness score."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglab.functions import frames


def draw(seed: int, sim: Column, i: Column, n: Column) -> Column:
    """A row number below n, from the MD5 sum of seed, simulation and step."""
    text = F.concat(F.lit(f"{seed}:"), sim.cast("string"), F.lit(":"), i.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), n)


#: Paths that one row of the plan stands for until they are drawn.
PATHS_A_LOT = 16


def bootstrap_paths(bars: DataFrame, simulations: int = 1000, seed: int = 123, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """keys, sim_id, total_return, max_drawdown of paths drawn with replacement from a run's returns.

    The draws are hashes, so they need no state and any part of them can be made anywhere. A run's returns become one
    array; lots of paths are dealt to tasks with it, and each path is drawn and followed step by step in place, so no
    row is made for a step.
    """
    told = F.transform(F.sort_array(F.collect_list(F.struct("ts", "strategy_return"))), lambda x: x["strategy_return"])
    own = bars.filter("strategy_return is not null").groupBy(*keys).agg(told.alias("r_")).withColumn("n_", F.size("r_").cast("long"))
    lots = own.select(*keys, "r_", "n_", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1), F.lit(PATHS_A_LOT))).alias("lot_"))
    # By a key of (run, lot), not round-robin, so that a lost task's lots are made again where they were.
    dealt = lots.repartition(*keys, "lot_")
    each = dealt.select(*keys, "r_", "n_", F.explode(F.sequence(F.col("lot_"), F.least(F.col("lot_") + PATHS_A_LOT, F.lit(simulations)) - 1)).alias("sim_id"))
    none = F.lit(None).cast("double")

    def step(path: Column, i: Column) -> Column:
        equity = path["e"] * (1 + F.get("r_", draw(seed, F.col("sim_id"), i, F.col("n_")).cast("int")))
        return follow(path, equity)

    def follow(path: Column, equity: Column) -> Column:
        def seen(e: Column) -> Column:
            peak = F.greatest(path["p"], e)
            return F.struct(e.alias("e"), peak.alias("p"), F.least(path["d"], frames.ratio(e, peak) - 1).alias("d"))

        return F.get(F.transform(F.array(equity), seen), 0)  # the equity is computed once, though it is named thrice

    path = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("n_") - 1), F.struct(F.lit(1.0).alias("e"), none.alias("p"), none.alias("d")), step)
    return each.select(*keys, "sim_id", path.alias("x_")).select(*keys, "sim_id", (F.col("x_.e") - 1).alias("total_return"), F.col("x_.d").alias("max_drawdown"))


def bootstrap_summary(paths: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    q = lambda c, p: F.percentile(c, F.lit(p))  # noqa: E731 - a run has as many values as paths were asked for
    return paths.groupBy(*keys).agg(
        F.count("*").alias("n_simulations"), q("total_return", 0.5).alias("median_total_return"), q("total_return", 0.05).alias("p5_total_return"), q("total_return", 0.95).alias("p95_total_return"),
        F.avg((F.col("total_return") < 0).cast("double")).alias("probability_of_loss"), q("max_drawdown", 0.5).alias("median_max_drawdown"), q("max_drawdown", 0.05).alias("p5_max_drawdown"),
    )


def bootstrap_seeded(returns: Sequence[float], simulations: int = 1000, seed: int = 123) -> dict:
    """The same from one generator, in sequence: for a single series on the driver, reproducible number by number."""
    r = np.asarray([x for x in returns if x is not None], float)
    r = r[~np.isnan(r)]
    if not len(r):
        raise ValueError("There are no returns to resample.")
    rng, total, worst = np.random.default_rng(seed), np.empty(simulations), np.empty(simulations)
    for k in range(simulations):
        path = np.cumprod(1 + rng.choice(r, size=len(r), replace=True))
        total[k], worst[k] = path[-1] - 1, (path / np.maximum.accumulate(path) - 1).min()
    return {
        "n_simulations": simulations, "median_total_return": float(np.median(total)), "p5_total_return": float(np.percentile(total, 5)), "p95_total_return": float(np.percentile(total, 95)),
        "probability_of_loss": float((total < 0).mean()), "median_max_drawdown": float(np.median(worst)), "p5_max_drawdown": float(np.percentile(worst, 5)), "total_returns": total, "max_drawdowns": worst,
    }


#: Numbers of the generator that one task counts.
NUMBERS_A_BLOCK = 1 << 20
_WORD = np.uint64(0xFFFFFFFF)


def _numbers(seed: int, begin: int, count: int) -> np.ndarray:
    """The 32-bit numbers begin, begin + 1, ... of a seeded PCG64, reached by a jump: it makes two at a time, the lower half first."""
    bits = np.random.PCG64(seed)
    bits.advance(begin // 2)
    pairs = bits.random_raw(count // 2 + 1)
    return np.stack([pairs & _WORD, pairs >> np.uint64(32)], axis=1).ravel()[begin % 2 :][:count]


def _taken(numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers below n by multiplication, and which of the numbers give one: few are rejected, so that rows are equally likely."""
    product = numbers * np.uint64(n)
    return (product >> np.uint64(32)).astype(np.int64), (product & _WORD) >= np.uint64((2**32 - n) % n)


def seeded_paths(bars: DataFrame, simulations: int = 1000, seed: int = 123, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """keys, sim_id, total_return, max_drawdown: the paths of :func:`bootstrap_seeded`, number by number, dealt to tasks.

    A path begins where the generator stands after all earlier paths: at their number of draws, plus those that were
    rejected. So rejections are counted first, block by block of the generator's numbers, for each length of a run; then
    a lot of paths jumps to its block and goes on from there.
    """
    keys = list(keys)
    told = F.transform(F.sort_array(F.collect_list(F.struct("ts", "strategy_return"))), lambda x: x["strategy_return"])
    own = bars.filter("strategy_return is not null").groupBy(*keys).agg(told.alias("r_")).withColumn("n_", F.size("r_").cast("long"))
    # Rejections are at most n in 2^32; a share of 1 in 1,000 and one block more is beyond what any run of this length sees.
    blocks = F.ceil(F.col("n_") * simulations * 1.001 / NUMBERS_A_BLOCK) + 1
    asked = own.select("n_").distinct().select("n_", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))

    def count(batches):
        for batch in batches:
            n, block = (x.to_pylist() for x in batch.columns)
            kept = [int(_taken(_numbers(seed, b * NUMBERS_A_BLOCK, NUMBERS_A_BLOCK), m)[1].sum()) for m, b in zip(n, block)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.int64())], ["m_", "block", "kept"])

    counted = asked.repartition("n_", "block").mapInArrow(count, "m_ long, block long, kept long")
    kept = counted.groupBy("m_").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "kept"))), lambda x: x["kept"]).alias("kept_"))
    lots = own.join(kept, F.col("n_") == F.col("m_")).select(*keys, "r_", "kept_", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1), F.lit(PATHS_A_LOT))).alias("lot_"))
    kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys)

    def draw_paths(batches):
        for batch in batches:
            for i in range(len(batch)):
                r, kept, lot = np.array(batch.column(len(keys))[i].as_py(), float), np.cumsum([0, *batch.column(len(keys) + 1)[i].as_py()]), batch.column(len(keys) + 2)[i].as_py()
                n, many = len(r), min(PATHS_A_LOT, simulations - lot)
                begin = lot * n
                block = int(np.searchsorted(kept, begin, side="right")) - 1
                at, left, total, worst = block * NUMBERS_A_BLOCK, np.zeros(0, np.int64), [], []
                skip = begin - kept[block]
                for _ in range(many):
                    while len(left) < n + skip:
                        rows, good = _taken(_numbers(seed, at, NUMBERS_A_BLOCK), n)
                        left, at = np.concatenate([left, rows[good]]), at + NUMBERS_A_BLOCK
                    left, skip = left[skip:], 0
                    path = np.cumprod(1 + r[left[:n]])
                    left = left[n:]
                    total.append(path[-1] - 1)
                    worst.append((path / np.maximum.accumulate(path) - 1).min())
                yield pa.RecordBatch.from_arrays([*(pa.array([batch.column(k)[i].as_py()] * many, batch.column(k).type) for k in range(len(keys))), pa.array(range(lot, lot + many), pa.int32()), pa.array(total), pa.array(worst)], [*keys, "sim_id", "total_return", "max_drawdown"])

    return lots.repartition(*keys, "lot_").mapInArrow(draw_paths, f"{kinds}, sim_id int, total_return double, max_drawdown double")


def overfit_gap(by_segment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From figures with ``segment``: both Sharpe ratios, their gap, and whether a good one turned bad."""
    at = lambda x: F.max(F.when(F.col("segment") == x, F.col("sharpe_ratio")))
    both = by_segment.groupBy(*keys).agg(at("train").alias("in_sample_sharpe"), at("test").alias("out_of_sample_sharpe"))
    return both.withColumn("gap", F.col("in_sample_sharpe") - F.col("out_of_sample_sharpe")).withColumn("overfit_flag", (F.col("in_sample_sharpe") > 0.5) & (F.col("out_of_sample_sharpe") < 0))


def _clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def robustness_points(out_of_sample: DataFrame, folds: DataFrame | None, ladder: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Points, not rounded, of each series: Sharpe ratio (40), folds held (25), drawdown (15), costs (20), and their sum.

    Parts without input, or of series that it lacks, give no points.
    """
    base = out_of_sample.select(*keys, (_clip01(F.col("sharpe_ratio") / 1.5) * 40).alias("oos_sharpe_points"), (_clip01(1 + F.col("max_drawdown") / 0.5) * 15).alias("drawdown_points"))
    if folds is not None:
        base = base.join(folds.groupBy(*keys).agg((F.avg((F.col("test_sharpe") > 0).cast("double")) * 25).alias("stability_points")), list(keys), "left")
    else:
        base = base.withColumn("stability_points", F.lit(0.0))
    if ladder is not None:
        ends = ladder.groupBy(*keys).agg(F.min_by("total_return", "cost").alias("_low"), F.max_by("total_return", "cost").alias("_high"))
        points = F.when((F.col("_low") > 0) & (F.col("_high") > 0), 20.0).when(F.col("_low") > 0, 10.0).otherwise(0.0)
        base = base.join(ends.select(*keys, points.alias("cost_points")), list(keys), "left")
    else:
        base = base.withColumn("cost_points", F.lit(0.0))
    parts = ("oos_sharpe_points", "stability_points", "drawdown_points", "cost_points")
    filled = base.select(*keys, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in parts))
    return filled.withColumn("score", sum((F.col(c) for c in parts), F.lit(0.0)))


def robustness_score(out_of_sample: dict, folds_held: float | None, ladder: Sequence[float] | None) -> dict:
    """The same for one series on the driver, rounded to a tenth: figures, share of folds held, returns by rising cost."""
    clip = lambda x: min(1.0, max(0.0, x))
    cost = 0.0
    if ladder:
        cost = (20.0 if ladder[-1] > 0 else 10.0) if ladder[0] > 0 else 0.0
    parts = {
        "oos_sharpe_points": clip(out_of_sample["sharpe_ratio"] / 1.5) * 40, "stability_points": (folds_held or 0.0) * 25,
        "drawdown_points": clip(1 + out_of_sample["max_drawdown"] / 0.5) * 15, "cost_points": cost,
    }
    return {"score": round(sum(parts.values()), 1), **{k: round(v, 1) for k, v in parts.items()}}
