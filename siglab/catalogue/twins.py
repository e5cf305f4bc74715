"""SQL twins of the queries, as common table expressions for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from siglab.config import COST_LADDER, StrategyConfig
from siglab.operators.features import REGIMES
from siglab.operators.views import SCORECARD

PANEL = """
day AS (SELECT l_returnflag || l_linestatus AS series_id, l_shipdate::date AS ts, avg(l_extendedprice) AS x FROM lineitem GROUP BY ALL),
shock AS (SELECT series_id, ts, (x - avg(x) OVER p) / nullif(stddev_pop(x) OVER p, 0) AS z FROM day WINDOW p AS (PARTITION BY series_id)),
panel AS (SELECT series_id, ts, 100 * exp(sum(0.0002 + 0.012 * z) OVER (PARTITION BY series_id ORDER BY ts)) AS close FROM shock)"""

ORDERS = PANEL.replace("l_returnflag || l_linestatus", "o_orderpriority").replace("l_shipdate", "o_orderdate").replace("l_extendedprice", "o_totalprice").replace("FROM lineitem", "FROM orders")

EVENT_PANEL = PANEL.replace("l_returnflag || l_linestatus", "event_type").replace("l_shipdate::date", "time_bucket(INTERVAL 1 HOUR, ts)").replace("l_extendedprice", "value").replace("FROM lineitem", "FROM events")

BENCHMARKED = PANEL.replace("panel AS", "alone AS") + """,
aday AS (SELECT l_shipdate::date AS ts, avg(l_extendedprice) AS x FROM lineitem GROUP BY ALL),
ashock AS (SELECT ts, (x - avg(x) OVER ()) / nullif(stddev_pop(x) OVER (), 0) AS z FROM aday),
abench AS (SELECT ts, 100 * exp(sum(0.0002 + 0.012 * z) OVER (ORDER BY ts)) AS benchmark_close FROM ashock),
panel AS (SELECT alone.*, benchmark_close FROM alone LEFT JOIN abench USING (ts))"""

KEYS = ("series_id",)


def r(x: str, name: str = "") -> str:
    """A value from ratios, rounded so that two engines agree; never a negative zero."""
    return f"round({x}, 6) + 0e0 AS {name or x}"


def rows(n: int, keys: Sequence[str] = KEYS) -> str:
    return f"(PARTITION BY {', '.join(keys)} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def order(keys: Sequence[str] = KEYS) -> str:
    return f"(PARTITION BY {', '.join(keys)} ORDER BY ts)"


def so_far(keys: Sequence[str] = KEYS) -> str:
    return f"(PARTITION BY {', '.join(keys)} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, keys: Sequence[str] = KEYS) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n, keys)} = {n} THEN {agg}({x}) OVER {rows(n, keys)} END"


def based(keys: Sequence[str] = KEYS, source: str = "panel") -> str:
    return f"base AS (SELECT *, close / lag(close) OVER {order(keys)} - 1 AS ret, coalesce(close / lag(close) OVER {order(keys)} - 1, 0) AS mr FROM {source})"


def product(x: str, keys: Sequence[str]) -> str:
    return f"product(1 + {x}) OVER {so_far(keys)}"


class Shared:
    def __init__(self, keys: Sequence[str]):
        self.keys, self.first, self.second = keys, {}, {}

    def mean(self, w: int) -> str:
        return self._add(self.first, f"ma{w}", full("avg", "close", w, self.keys))

    def deviation(self, w: int) -> str:
        return self._add(self.first, f"sd{w}", full("stddev_pop", "close", w, self.keys))

    def momentum(self, w: int) -> str:
        return self._add(self.first, f"mom{w}", f"close / lag(close, {w}) OVER {order(self.keys)} - 1")

    def vol(self, w: int, of: str = "ret") -> str:
        return self._add(self.first, f"v_{of}{w}", full("stddev_pop", of, w, self.keys))

    def threshold(self, w: int, q: float) -> str:
        v = self.vol(w)
        return self._add(self.second, f"thr{w}", f"CASE WHEN count({v}) OVER {so_far(self.keys)} >= {w} THEN quantile_cont({v}, {q}) OVER {so_far(self.keys)} END")

    @staticmethod
    def _add(at: dict, name: str, text: str) -> str:
        at.setdefault(name, text)
        return name

    def ctes(self) -> str:
        first = "".join(f", {v} AS {k}" for k, v in self.first.items())
        second = "".join(f", {v} AS {k}" for k, v in self.second.items())
        return f"f1 AS (SELECT *{first} FROM base), f2 AS (SELECT *{second} FROM f1)"


def flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 1e0 WHEN NOT ({x}) THEN 0e0 END"


def family(c: StrategyConfig, s: Shared) -> dict[str, str]:
    if c.signal_family == "trend":
        a, b = s.mean(c.short_window), s.mean(c.long_window)
        return {"fast_ma": a, "slow_ma": b, "target": flag(f"{a} > {b}")}
    if c.signal_family == "momentum":
        m = s.momentum(c.momentum_window)
        return {"momentum": m, "target": flag(f"{m} > 0")}
    if c.signal_family == "mean_reversion":
        z = f"(close - {s.mean(c.zscore_window)}) / nullif({s.deviation(c.zscore_window)}, 0)"
        return {"zscore": z, "target": flag(f"{z} < {-c.zscore_entry}")}
    parts = {x: f"({family(StrategyConfig(**{**vars(c), 'signal_family': x, 'use_volatility_filter': False}), s)['target']})" for x in ("trend", "momentum", "mean_reversion")}
    score = "(" + " + ".join(f"coalesce({x}, 0)" for x in parts.values()) + ") / nullif(" + " + ".join(f"(CASE WHEN {x} IS NULL THEN 0 ELSE 1 END)" for x in parts.values()) + ", 0)"
    return {**{f"{k}_signal": v for k, v in parts.items()}, "composite_score": score, "target": flag(f"{score} >= 0.5")}


def signal(c: StrategyConfig, s: Shared) -> dict[str, str]:
    out = family(c, s)
    if c.use_volatility_filter:
        v, t = s.vol(c.vol_filter_window), s.threshold(c.vol_filter_window, c.vol_filter_quantile)
        out["risk_on"] = f"(CASE WHEN {t} IS NULL OR {v} <= {t} THEN 1e0 ELSE 0e0 END)"
        out["target"] = f"({out['target']}) * {out['risk_on']}"
    return out


def exposure(target: str, c: StrategyConfig, s: Shared) -> str:
    x, low = f"({target})", -c.max_exposure if c.allow_short else 0.0
    if c.sizing_method in ("fixed_fraction", "capped_exposure"):
        x = f"({x} * {c.fixed_fraction}::double)"
    elif c.sizing_method == "volatility_target":
        x = f"({x} * ({c.target_volatility}::double / nullif({s.vol(c.vol_lookback, 'mr')} * sqrt(252), 0)))"
    clip = lambda y: f"(CASE WHEN {y} IS NOT NULL THEN least(greatest({y}, {low}::double), {c.max_exposure}::double) END)"
    x = clip(x)
    if c.use_risk_controls:
        v = f"({s.vol(20, 'mr')} * sqrt(252))"
        x = clip(f"({x} * coalesce(CASE WHEN {v} > 0 THEN least(1e0, {c.vol_cap}::double / {v}) END, 1e0))")
    return x


def bars(configs: Sequence[StrategyConfig], keys: Sequence[str] = KEYS, source: str = "panel", extra: str = "", bench: bool = False) -> str:
    """CTEs from ``source`` to ``bars``; ``extra``: columns of the source to keep, each with a comma before it."""
    s, own, each = Shared(keys), [*keys, "config_id"], []
    k = ", ".join(keys)
    for i, c in enumerate(configs):
        x, rates = exposure(signal(c, s)["target"], c, s), c.rates
        guard = f"{c.drawdown_guard_level}::double" if c.use_drawdown_guard else "NULL::double"
        each.append(f"SELECT {k}, ts, close{extra}, ret, mr, {i} AS config_id, {x} AS exposure, {rates.fee}::double AS fee, {rates.spread}::double AS spread, {rates.slippage}::double AS slip, {guard} AS guard FROM f2")
    union = " UNION ALL ".join(each)
    before = f"(PARTITION BY {', '.join(own)} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bench_sql = f""",
bn AS (SELECT *, last_value(benchmark_close IGNORE NULLS) OVER {so_far(own)} AS known FROM b5),
bo AS (SELECT *, coalesce(known / lag(known) OVER {order(own)} - 1, 0) AS benchmark_return FROM bn),
bars AS (SELECT *, {product('benchmark_return', own)} AS benchmark_equity FROM bo)""" if bench else ", bars AS (SELECT * FROM b5)"
    return f"""{based(keys, source)}, {s.ctes()},
b1 AS ({union}),
b2 AS (SELECT *, coalesce(lag(exposure) OVER {order(own)}, 0) AS p0 FROM b1),
g1 AS (SELECT *, {product('p0 * mr', own)} AS ge FROM b2),
g2 AS (SELECT *, ge / greatest(1, max(ge) OVER {so_far(own)}) - 1 <= -abs(guard) AS hit FROM g1),
b3 AS (SELECT *, CASE WHEN coalesce(bool_or(coalesce(hit, false)) OVER {before}, false) THEN 0 ELSE p0 END AS position FROM g2),
b4 AS (SELECT *, coalesce(abs(position - lag(position) OVER {order(own)}), 0) AS turn, position * mr AS gross FROM b3),
b45 AS (SELECT *, turn * (fee + spread + slip) AS cost, gross - turn * (fee + spread + slip) AS net FROM b4),
b5 AS (SELECT *, {product('net', own)} AS eq, {product('gross', own)} AS geq, {product('mr', own)} AS beq FROM b45){bench_sql}"""


def kpis(keys: Sequence[str], source: str = "bars", name: str = "kpi", extended: bool = False, bench: bool = False, net: str = "net") -> str:
    """CTEs that end in ``name`` with all figures of each group, not rounded."""
    k = ", ".join(keys)
    more = ""
    if extended:
        more = f""", avg(position) AS exposure_avg, max(position) AS exposure_max, max(s) AS best_day, min(s) AS worst_day, avg((s > 0)::int) AS win_rate, product(1 + gross) - 1 AS gross_return,
 quantile_cont(rs, 0.5) AS rolling_sharpe_median, {'product(1 + benchmark_return) - 1' if bench else 'NULL::double'} AS benchmark_return"""
    rs = f", ({full('avg', net, 63, keys)}) * 252 / nullif(({full('stddev_pop', net, 63, keys)}) * sqrt(252), 0) AS rs" if extended else ""
    last = ", gross_return - total_return AS cost_drag, total_return - benchmark_return AS benchmark_excess, annualized_return AS cagr" if extended else ""
    return f"""{name}1 AS (SELECT *, {net} AS s, mr AS b, coalesce(abs(position - lag(position) OVER {order(keys)}), 0) AS turn_, {product(net, keys)} AS e_{rs} FROM {source}),
{name}2 AS (SELECT *, e_ / max(e_) OVER {so_far(keys)} - 1 AS dd FROM {name}1),
{name}3 AS (SELECT {k}, count(*) AS n, product(1 + s) - 1 AS total_return, product(1 + b) - 1 AS baseline_return, avg(s) AS m, stddev_pop(s) AS sd, stddev_pop(s) FILTER (WHERE s < 0) AS down, min(dd) AS max_drawdown,
 count(*) FILTER (WHERE position > 0) AS active_days, count(*) FILTER (WHERE turn_ > 0) AS trade_count, avg(turn_) AS turnover, CASE WHEN stddev_pop(s) > 0 AND stddev_pop(b) > 0 THEN corr(s, b) END AS co,
 avg(s - b) AS xm, stddev_pop(s - b) AS xs, avg(s) FILTER (WHERE s > 0) AS win, avg(s) FILTER (WHERE s < 0) AS loss{more} FROM {name}2 GROUP BY {k}),
{name}4 AS (SELECT *, total_return - baseline_return AS excess_return, CASE WHEN 1 + total_return > 0 THEN power(1 + total_return, 252e0 / n) - 1 ELSE 0 END AS annualized_return, sd * sqrt(252) AS annualized_volatility,
 coalesce(m * 252 / nullif(sd * sqrt(252), 0), 0) AS sharpe_ratio, coalesce(m * 252 / nullif(down * sqrt(252), 0), 0) AS sortino_ratio, coalesce(co, 0) AS correlation_to_baseline,
 coalesce(xm * 252 / nullif(xs * sqrt(252), 0), 0) AS information_ratio, coalesce(win / nullif(abs(loss), 0), 0) AS win_loss_ratio FROM {name}3),
{name} AS (SELECT *, CASE WHEN max_drawdown < 0 THEN annualized_return / abs(max_drawdown) ELSE 0 END AS calmar_ratio{last} FROM {name}4)"""


COUNTS = ("active_days", "trade_count")


def figures(names: Sequence[str]) -> str:
    return ", ".join(f"{n}::bigint AS {n}" if n in COUNTS else r(n) for n in names)


def config_values(configs: Sequence[StrategyConfig]) -> str:
    said = lambda c: f"'{c.label}', '{c.signal_family}', {c.short_window}, {c.long_window}, {c.momentum_window}, {c.zscore_window}, {c.zscore_entry}::double, {str(c.use_volatility_filter).lower()}, {c.cost_per_trade}::double"
    values = ", ".join(f"({i}, {said(c)})" for i, c in enumerate(configs))
    return f"cfg(config_id, label, signal_family, short_window, long_window, momentum_window, zscore_window, zscore_entry, use_volatility_filter, cost_per_trade) AS (VALUES {values})"


def regimes(source: str = "panel", keys: Sequence[str] = KEYS, name: str = "reg") -> str:
    k = ", ".join(keys)
    return f"""{name}1 AS (SELECT *, close / lag(close) OVER {order(keys)} - 1 AS ret_ FROM {source}),
{name}2 AS (SELECT *, {full('stddev_pop', 'ret_', 60, keys)} AS regime_vol FROM {name}1),
{name}3 AS (SELECT {k}, quantile_cont(regime_vol, 0.33) AS q1, quantile_cont(regime_vol, 0.66) AS q2, quantile_cont(regime_vol, 0.9) AS q3 FROM {name}2 GROUP BY {k}),
{name} AS (SELECT *, CASE WHEN regime_vol <= q1 THEN 0 WHEN regime_vol <= q2 THEN 1 WHEN regime_vol <= q3 THEN 2 WHEN regime_vol IS NOT NULL THEN 3 END AS regime_order FROM {name}2 JOIN {name}3 USING ({k}))"""


REGIME_NAME = "CASE regime_order " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(REGIMES)) + " END"


def ladder_values() -> str:
    return "(VALUES " + ", ".join(f"({x}::double)" for x in COST_LADDER) + ") t(rung)"


def segments(fraction: float = 0.7, source: str = "bars", keys: Sequence[str] = ("series_id", "config_id")) -> str:
    k = ", ".join(keys)
    return f"""seg0 AS (SELECT *, row_number() OVER {order(keys)} - 1 AS rn, count(*) OVER (PARTITION BY {k}) AS nn FROM {source}),
seg AS (SELECT *, CASE WHEN rn < floor(nn * {fraction}::double) THEN 'train' ELSE 'test' END AS segment FROM seg0)"""


def folds(train: int, test: int) -> str:
    whole = train + test
    return f"""num AS (SELECT series_id, ts, close, row_number() OVER {order()} - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS nn FROM panel),
fold AS (SELECT series_id, ts, close, f.fold::int AS fold, CASE WHEN rn - f.fold * {test} < {train} THEN 'train' ELSE 'test' END AS part
         FROM num JOIN (SELECT unnest(range(0, 1000)) AS fold) f ON f.fold * {test} + {whole} <= nn AND rn >= f.fold * {test} AND rn < f.fold * {test} + {whole})"""


def scorecard_rows(source: str) -> str:
    return " UNION ALL ".join(f"SELECT series_id, config_id, segment, '{k}' AS metric, {k}::double AS value FROM {source}" for k, _, _ in SCORECARD)
