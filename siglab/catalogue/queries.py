"""Queries by name: a Spark plan over the driver's tables, and its SQL twin.

Each is registered by :func:`query`, which takes the twin; values that come from ratios are rounded to six digits
on both sides, as two engines agree to about the last bit only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglab.catalogue import twins as T
from siglab.config import IDENTITY, StrategyConfig, candidates, grid
from siglab.functions import frames
from siglab.operators import attribution, costs, families, features, robustness, scorecard, views
from siglab.plans import chunked, engine, panels, sweep
from siglab.sources import files, gates, rejects, walks
from siglab.streaming import bars as streaming
from siglab.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}

RUN = ("series_id", "config_id")
BASE = StrategyConfig()
SHORTS, LONGS = (5, 10, 20, 30), (40, 60, 90, 120)
GUARDED = StrategyConfig(signal_family="momentum", momentum_window=20, use_drawdown_guard=True, drawdown_guard_level=0.05)
#: The strategy of the events' bars, in batch and as a stream.
STREAMED = StrategyConfig(signal_family="composite", sizing_method="volatility_target", max_exposure=1.5, use_drawdown_guard=True, drawdown_guard_level=0.10, fee=0.0005, spread=0.0002)
COSTED = StrategyConfig(signal_family="mean_reversion", zscore_window=40, fee=0.001, spread=0.0005, slippage=0.0005)
SIGNALS = {
    "sig_trend": BASE,
    "sig_momentum": StrategyConfig(signal_family="momentum"),
    "sig_meanrev": StrategyConfig(signal_family="mean_reversion"),
    "sig_composite": StrategyConfig(signal_family="composite"),
    "sig_volfilter": StrategyConfig(signal_family="composite", use_volatility_filter=True),
}
SIZED = {
    "size_fraction": StrategyConfig(sizing_method="fixed_fraction", fixed_fraction=0.4),
    "size_capped": StrategyConfig(sizing_method="capped_exposure", fixed_fraction=1.5, max_exposure=0.8),
    "size_voltarget": StrategyConfig(sizing_method="volatility_target", target_volatility=0.15, max_exposure=2.0),
    "vol_cap": StrategyConfig(signal_family="momentum", use_risk_controls=True, vol_cap=0.15),
}
SIMULATIONS = 1000
#: Rows of a chunk where a query goes by chunks; the panels have about 2,450 rows a series.
CHUNK_ROWS = 1024


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, never a negative zero."""
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


def query(twin: str, name: str | None = None, plain: bool = False) -> Callable:
    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f if plain else (lambda spark, sf_dir: rounded(f(spark, sf_dir)))
        TWINS[key] = f"WITH {twin}" if twin.lstrip()[:6].upper() != "SELECT" else twin
        return f

    return add


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.lineitem_panel(spark, sf_dir)


def _bars(spark: SparkSession, sf_dir: str, configs) -> DataFrame:
    return engine.bars(panel(spark, sf_dir), configs, components=False)


def _long_bars(spark: SparkSession, sf_dir: str, configs) -> DataFrame:
    return chunked.bars(panel(spark, sf_dir), configs, components=False, rows=CHUNK_ROWS)


def _sql_bars(*configs: StrategyConfig, **options) -> str:
    return f"{T.PANEL}, {T.bars(configs, **options)}"


# Features


@query(f"{T.PANEL}, {T.based()} SELECT series_id, ts, {T.r('ret', 'return_1d')}, {T.r(f'ln(close) - ln(lag(close) OVER {T.order()})', 'log_return')} FROM base")
def returns(spark, sf_dir):
    return panel(spark, sf_dir).withColumns(features.return_features()).drop("close")


def _trend_sql() -> str:
    each = []
    for w in features.TREND:
        ma, sd = f"({T.full('avg', 'close', w)})", f"({T.full('stddev_pop', 'close', w)})"
        each += [T.r(ma, f"ma_{w}"), T.r(f"close / {ma} - 1", f"price_to_ma_{w}"), T.r(f"(close - {ma}) / nullif({sd}, 0)", f"zscore_{w}")]
    return ", ".join(each)


def _momentum_sql() -> str:
    return ", ".join(T.r(f"close / lag(close, {w}) OVER {T.order()} - 1", f"momentum_{w}") for w in features.MOMENTUM)


def _vol_sql() -> str:
    return ", ".join(T.r(f"({T.full('stddev_pop', 'ret', w)})", f"vol_{w}") for w in features.VOLATILITY)


def _high_sql() -> str:
    return ", ".join(T.r(f"close / max(close) OVER {T.rows(w)} - 1", f"drawdown_from_high_{w}") for w in features.VOLATILITY)


@query(f"{T.PANEL} SELECT series_id, ts, {_trend_sql()} FROM panel")
def trend_features(spark, sf_dir):
    return panel(spark, sf_dir).withColumns(features.trend_features()).drop("close")


@query(f"{T.PANEL} SELECT series_id, ts, {_momentum_sql()} FROM panel")
def momentum_features(spark, sf_dir):
    return panel(spark, sf_dir).withColumns(features.momentum_features()).drop("close")


def _volatility(spark, sf_dir):
    based = panel(spark, sf_dir).withColumn("return_1d", frames.change(F.col("close")))
    return based.withColumns(features.volatility_features()).drop("close", "return_1d")


@query(f"{T.PANEL}, {T.based()} SELECT series_id, ts, {_vol_sql()} FROM base")
def vol_features(spark, sf_dir):
    return _volatility(spark, sf_dir).select("series_id", "ts", *(f"vol_{w}" for w in features.VOLATILITY))


@query(f"{T.PANEL}, {T.based()} SELECT series_id, ts, {_high_sql()} FROM base")
def drawdown_high(spark, sf_dir):
    return _volatility(spark, sf_dir).select("series_id", "ts", *(f"drawdown_from_high_{w}" for w in features.VOLATILITY))


@query(f"{T.PANEL}, {T.regimes()} SELECT series_id, ts, {T.r('regime_vol')}, {T.REGIME_NAME} AS vol_regime FROM reg")
def regime_labels(spark, sf_dir):
    return features.with_regimes(panel(spark, sf_dir)).select("series_id", "ts", "regime_vol", "vol_regime")


@query(f"""{T.PANEL}, {T.based()}, {T.regimes()}
SELECT series_id, ts, {T.r('base.close', 'close')}, {T.r('base.ret', 'return_1d')}, {T.r(f'ln(base.close) - ln(lag(base.close) OVER {T.order()})', 'log_return')},
{_trend_sql().replace('close', 'base.close')}, {_momentum_sql().replace('close', 'base.close')}, {_vol_sql().replace('(ret)', '(base.ret)')}, {_high_sql().replace('close', 'base.close')}, {T.r('regime_vol')}, {T.REGIME_NAME} AS vol_regime
FROM base JOIN reg USING (series_id, ts)""")
def feature_frame(spark, sf_dir):
    return features.feature_frame(panel(spark, sf_dir))


@query(f"""{T.PANEL}, {T.based()}, v AS (SELECT *, {T.full('stddev_pop', 'ret', 60)} AS vol FROM base)
SELECT series_id, ts, {T.r(f'CASE WHEN count(vol) OVER {T.so_far()} >= 60 THEN quantile_cont(vol, 0.8) OVER {T.so_far()} END', 'threshold')} FROM v""")
def expanding_vol_threshold(spark, sf_dir):
    shared = families.Shared()
    column = shared.threshold(60, 0.8)
    return shared.add(engine.returns(panel(spark, sf_dir))).select("series_id", "ts", column.alias("threshold"))


@query("""d AS (SELECT o_orderdate::date AS ts, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL), span AS (SELECT min(ts) AS a, max(ts) AS b FROM d),
every AS (SELECT unnest(generate_series(a::timestamp, b::timestamp, INTERVAL 1 DAY))::date AS ts FROM span)
SELECT every.ts, coalesce(n, 0)::bigint AS n_rows FROM every LEFT JOIN d USING (ts) WHERE isodow(every.ts) < 6""", plain=True)
def bdays(spark, sf_dir):
    return walks.calendar(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate")


# Gates


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("close"))


@query("""SELECT event_type AS series_id, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS close_missing, count(*) FILTER (WHERE value <= 0 AND NOT isnan(value)) AS close_low
FROM events GROUP BY event_type""", plain=True)
def validation_gates(spark, sf_dir):
    return gates.counts(_events(spark, sf_dir))


@query(f"{T.PANEL}, {T.based()} SELECT series_id, count(*) AS n_rows, avg((ret = 0)::int) FILTER (WHERE ret IS NOT NULL) AS zero_return_share, false AS has_benchmark FROM base GROUP BY series_id", plain=True)
def quality_report(spark, sf_dir):
    return gates.quality(panel(spark, sf_dir))


@query(f"""{T.PANEL}, {T.based()}, q AS (SELECT series_id, count(*) AS n, avg((ret = 0)::int) FILTER (WHERE ret IS NOT NULL) AS zero FROM base GROUP BY series_id)
SELECT series_id, 'short' AS note, n::double AS value FROM q WHERE n < 3000 UNION ALL SELECT series_id, 'stale', zero FROM q WHERE zero > 0.2 UNION ALL SELECT series_id, 'alone', NULL FROM q""")
def quality_notes(spark, sf_dir):
    return gates.notes(panel(spark, sf_dir), short_rows=3000)


#: Tables as the loader may meet them: clean, with repeated days, with a date column that holds none, with prices that are none.
LOADS = {
    "clean": ("orders", "o_orderdate", "o_totalprice", "o_orderkey"),
    "repeated": ("orders", "o_orderdate", "o_totalprice", "o_orderpriority"),
    "undated": ("orders", "o_orderpriority", "o_totalprice", "o_orderkey"),
    "unpriced": ("events", "ts", "props", "event_type"),
    "events": ("events", "ts", "value", "event_type"),
}


def _gates_sql(case: str, table: str, date: str, close: str, series: str) -> str:
    x = f"try_cast({close}::varchar AS double)"
    price = f"CASE WHEN NOT isnan({x}) THEN {x} END"
    return f"""SELECT '{case}' AS loaded, sum(n)::bigint AS n_rows, coalesce(sum(n) FILTER (WHERE ts IS NULL), 0)::bigint AS bad, coalesce(sum(n - 1) FILTER (WHERE ts IS NOT NULL), 0)::bigint AS twice, sum(missing)::bigint AS missing, sum(low)::bigint AS low
FROM (SELECT ts, count(*) AS n, count(*) FILTER (WHERE c IS NULL) AS missing, count(*) FILTER (WHERE c <= 0) AS low FROM (SELECT {series} AS s, try_cast({date}::varchar AS timestamp) AS ts, {price} AS c FROM {table}) GROUP BY s, ts)"""


@query("SELECT * FROM (" + " UNION ALL ".join(_gates_sql(k, *v) for k, v in LOADS.items()) + ")", plain=True)
def loader_gates(spark, sf_dir):
    def one(case: str, table: str, date: str, close: str, series: str) -> DataFrame:
        raw = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        text = raw.select(*(F.col(c).cast("string").alias(c) for c in (date, close, series)))  # as a CSV file gives them
        return files.gate_counts(files.parsed(text, date, close, series)).select(F.lit(case).alias("loaded"), "*")

    first, *others = (one(k, *v) for k, v in LOADS.items())
    for x in others:
        first = first.unionByName(x)
    return first


@query("SELECT o_orderkey::varchar AS series_id, o_orderdate::timestamp AS ts, o_totalprice AS close FROM orders", plain=True)
def loaded_panel(spark, sf_dir):
    return files.from_parquet(spark, f"{sf_dir}/orders.parquet", "o_orderdate", "o_totalprice", "o_orderkey")


#: Lines of text made of ``orders``, some of them spoilt: a field missing or too many, no customer, a day or a price that is none, a price of no worth.
_LINE = {
    "spark": "CASE WHEN o_orderkey % 97 = 1 THEN concat_ws(',', o_custkey, o_totalprice) WHEN o_orderkey % 89 = 2 THEN concat_ws(',', o_custkey, d, o_totalprice, 'more') WHEN o_orderkey % 83 = 3 THEN concat_ws(',', '', d, o_totalprice)"
    " WHEN o_orderkey % 79 = 4 THEN concat_ws(',', o_custkey, 'someday', o_totalprice) WHEN o_orderkey % 73 = 5 THEN concat_ws(',', o_custkey, d, 'n/a') WHEN o_orderkey % 71 = 6 THEN concat_ws(',', o_custkey, d, -o_totalprice) ELSE concat_ws(',', o_custkey, d, o_totalprice) END",
}
_LINES_SQL = f"""src AS (SELECT o_orderkey, o_custkey::varchar AS o_custkey, round(o_totalprice)::bigint AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders), l AS (SELECT {_LINE['spark']} AS line FROM src),
f AS (SELECT line, string_split(line, ',') AS x FROM l), v AS (SELECT line, len(x) AS n, x[1] AS s, try_cast(x[2] AS timestamp) AS ts, try_cast(x[3] AS double) AS c FROM f),
j AS (SELECT *, CASE WHEN n <> 3 THEN 'fields' WHEN s = '' THEN 'series' WHEN ts IS NULL THEN 'date' WHEN c IS NULL THEN 'close missing' WHEN c <= 0 THEN 'close not positive' END AS why FROM v),
k AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY s, ts, why ORDER BY line) > 1 THEN 'repeated' ELSE why END AS reason FROM j)"""


def _sorted_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.round("o_totalprice").cast("long").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return rejects.sorted_out(src.select(F.expr(_LINE["spark"]).alias("line")))


@query(f"{_LINES_SQL} SELECT s AS series_id, ts, c AS close FROM k WHERE reason IS NULL", plain=True)
def csv_panel(spark, sf_dir):
    return rejects.panel(_sorted_out(spark, sf_dir))


@query(f"{_LINES_SQL} SELECT line, reason FROM k WHERE reason IS NOT NULL", plain=True)
def csv_rejects(spark, sf_dir):
    return rejects.rejected(_sorted_out(spark, sf_dir))


_PAIRS = [(a, b) for a in (-5, 0, 20, 60) for b in (0, 20, 40, 60, 120, 2440)]


@query(f"""{T.PANEL}, n AS (SELECT series_id, count(*) AS n_rows FROM panel GROUP BY ALL)
SELECT series_id, a AS short_window, b AS long_window, n_rows, CASE WHEN least(a, b) < 1 THEN 'not positive' WHEN a >= b THEN 'not less' WHEN n_rows < b + 2 THEN 'too short' ELSE 'usable' END AS verdict
FROM n, (VALUES {', '.join(f'({a}, {b})' for a, b in _PAIRS)}) t(a, b)""", plain=True)
def window_checks(spark, sf_dir):
    return gates.window_checks(panel(spark, sf_dir), _PAIRS)


# Signals and exposure


def _signal(name: str, c: StrategyConfig) -> None:
    shared = T.Shared(T.KEYS)
    columns = T.signal(c, shared)
    listed = ", ".join(T.r(f"({v})", "target_position" if k == "target" else k) for k, v in columns.items())
    query(f"{T.PANEL}, {T.based()}, {shared.ctes()} SELECT series_id, ts, {listed} FROM f2", name)(lambda spark, sf_dir: families.signal_frame(panel(spark, sf_dir), c).drop("close"))


for _name, _config in SIGNALS.items():
    _signal(_name, _config)


def _sized(name: str, c: StrategyConfig) -> None:
    query(f"{_sql_bars(c)} SELECT series_id, ts, {T.r('exposure')}, {T.r('position')} FROM bars", name)(lambda spark, sf_dir: _bars(spark, sf_dir, c).select("series_id", "ts", "exposure", "position"))


for _name, _config in SIZED.items():
    _sized(_name, _config)


@query(f"{_sql_bars(GUARDED)} SELECT series_id, ts, {T.r('position')}, {T.r('geq', 'gross_equity')} FROM bars")
def drawdown_guard(spark, sf_dir):
    return _long_bars(spark, sf_dir, GUARDED).select("series_id", "ts", "position", "gross_equity")


_ROLLING_SQL = f"({T.full('stddev_pop', 'mr', 20)}) * sqrt(252)"


@query(f"{T.PANEL}, {T.based()} SELECT series_id, ts, {T.r(_ROLLING_SQL, 'rolling_volatility')} FROM base")
def rolling_volatility(spark, sf_dir):
    return engine.returns(panel(spark, sf_dir)).select("series_id", "ts", frames.rolling_volatility(F.col("market_return"), 20).alias("rolling_volatility"))


# The backtest


@query(f"{_sql_bars(COSTED)} SELECT series_id, ts, {T.r('turn', 'turnover_')}, {T.r('turn * fee', 'fee_cost')}, {T.r('turn * spread', 'spread_cost')}, {T.r('turn * slip', 'slippage_cost')}, {T.r('cost')} FROM bars")
def cost_decompose(spark, sf_dir):
    return _bars(spark, sf_dir, COSTED).select("series_id", "ts", "turnover_", *(f"{p}_cost" for p in costs.PARTS), "cost")


_NAMED = ("mr AS market_return", "position", "exposure", "cost", "gross AS gross_return", "net AS strategy_return", "mr AS baseline_return", "eq AS strategy_equity", "geq AS gross_equity", "beq AS baseline_equity")
_BARS_SQL = ", ".join(T.r(x.split(" AS ")[0], x.split(" AS ")[-1]) for x in _NAMED)
_BARS = [x.split(" AS ")[-1] for x in _NAMED]


@query(f"{_sql_bars(*candidates())} SELECT series_id, config_id, ts, {_BARS_SQL} FROM bars")
def backtest_bars(spark, sf_dir):
    return _long_bars(spark, sf_dir, candidates()).select("series_id", "config_id", "ts", *_BARS)


@query(f"{_sql_bars(BASE)} SELECT series_id, config_id, ts, {T.r('(geq - 1) * 100', 'gross')}, {T.r('(eq - 1) * 100', 'net')} FROM bars")
def gross_net(spark, sf_dir):
    return views.gross_net(_bars(spark, sf_dir, BASE))


@query(f"{_sql_bars(BASE)} SELECT series_id, config_id, ts, {T.r('(eq - 1) * 100', 'strategy')}, {T.r('(beq - 1) * 100', 'baseline')} FROM bars")
def equity_view(spark, sf_dir):
    return views.equity(_bars(spark, sf_dir, BASE))


@query(f"{_sql_bars(BASE)} SELECT series_id, config_id, ts, {T.r(f'(eq / max(eq) OVER {T.so_far(RUN)} - 1) * 100', 'drawdown')} FROM bars")
def drawdown_view(spark, sf_dir):
    return views.drawdown(_bars(spark, sf_dir, BASE))


@query(f"{T.BENCHMARKED}, {T.bars([BASE], extra=', benchmark_close', bench=True)} SELECT series_id, config_id, ts, {T.r('(eq - 1) * 100', 'strategy')}, {T.r('(benchmark_equity - 1) * 100', 'benchmark')} FROM bars")
def benchmark_compare(spark, sf_dir):
    return views.benchmark(engine.bars(walks.with_benchmark(panel(spark, sf_dir), spark, sf_dir), BASE, components=False))


@query(f"{_sql_bars(BASE)} SELECT series_id, config_id, ts, {T.r('position', 'exposure')} FROM bars")
def exposure_view(spark, sf_dir):
    return views.exposure(_bars(spark, sf_dir, BASE))


@query(f"""{_sql_bars(BASE)} SELECT series_id, config_id, ts, {T.r(f"({T.full('stddev_pop', 'net', 20, RUN)}) * sqrt(252) * 100", 'rolling_vol')},
{T.r(f"({T.full('avg', 'net', 63, RUN)}) * 252 / nullif(({T.full('stddev_pop', 'net', 63, RUN)}) * sqrt(252), 0)", 'rolling_sharpe')} FROM bars""")
def rolling_risk(spark, sf_dir):
    return views.rolling_risk(_bars(spark, sf_dir, BASE))


@query(f"""{_sql_bars(COSTED)} SELECT series_id, config_id, component, {T.r('cost_drag')} FROM (
SELECT series_id, config_id, 'Fee' AS component, sum(turn * fee) * 100 AS cost_drag FROM bars GROUP BY ALL UNION ALL
SELECT series_id, config_id, 'Spread', sum(turn * spread) * 100 FROM bars GROUP BY ALL UNION ALL SELECT series_id, config_id, 'Slippage', sum(turn * slip) * 100 FROM bars GROUP BY ALL)""")
def cost_breakdown(spark, sf_dir):
    return views.cost_breakdown(_bars(spark, sf_dir, COSTED))


@query(f"{_sql_bars(BASE)}, d AS (SELECT *, (eq / max(eq) OVER {T.so_far(RUN)} - 1) * 100 AS dd FROM bars) SELECT series_id, config_id, {T.r('min(dd)', 'trough')}, arg_min(ts, (round(dd, 9), ts)) AS trough_ts FROM d GROUP BY series_id, config_id")
def trough(spark, sf_dir):
    return views.trough(_bars(spark, sf_dir, BASE))


def _histogram_sql(source: str, x: str) -> str:
    return f"""binned AS (SELECT *, min({x}) OVER (PARTITION BY series_id) AS lo, max({x}) OVER (PARTITION BY series_id) AS hi FROM {source})
SELECT series_id, (CASE WHEN lo = hi THEN 1 ELSE least(floor(({x} - lo) / (hi - lo) * 40) + 1, 40) END)::int AS bin, count(*) AS n FROM binned GROUP BY ALL"""


@query(f"{_sql_bars(BASE)}, {_histogram_sql('bars', 'net')}", plain=True)
def return_histogram(spark, sf_dir):
    return views.histogram(_bars(spark, sf_dir, BASE), "strategy_return")


@query(f"{_sql_bars(BASE)}, held AS (SELECT * FROM bars WHERE position > 0), {_histogram_sql('held', 'net')}", plain=True)
def in_market_histogram(spark, sf_dir):
    return views.histogram(_bars(spark, sf_dir, BASE).filter("position > 0"), "strategy_return")


# Scorecards and sweeps


@query(f"{_sql_bars(BASE)}, {T.kpis(RUN)} SELECT series_id, config_id, {T.figures(scorecard.KPIS)} FROM kpi")
def kpis(spark, sf_dir):
    return scorecard.kpis(_bars(spark, sf_dir, BASE), RUN)


@query(f"{T.BENCHMARKED}, {T.bars([BASE], extra=', benchmark_close', bench=True)}, {T.kpis(RUN, extended=True, bench=True)} SELECT series_id, config_id, {T.figures([*scorecard.KPIS, *scorecard.EXTENDED])} FROM kpi")
def kpis_extended(spark, sf_dir):
    return scorecard.kpis(engine.bars(walks.with_benchmark(panel(spark, sf_dir), spark, sf_dir), BASE, components=False), RUN, extended=True)


def _swept(configs) -> str:
    return f"{_sql_bars(*configs)}, {T.kpis(RUN)}, {T.config_values(configs)}, swept AS (SELECT * FROM kpi JOIN cfg USING (config_id))"


_RANKED = "row_number() OVER (PARTITION BY series_id ORDER BY sharpe_ratio DESC NULLS LAST, config_id)"


@query(f"{_swept(candidates())} SELECT series_id, config_id, {', '.join(IDENTITY)}, {T.figures(scorecard.KPIS)} FROM swept")
def config_sweep(spark, sf_dir):
    return sweep.config_sweep(panel(spark, sf_dir), candidates())


@query(f"{_swept(grid(SHORTS, LONGS))} SELECT series_id, config_id, short_window, long_window, cost_per_trade, {T.figures(scorecard.KPIS)} FROM swept")
def param_grid(spark, sf_dir):
    return sweep.parameter_sweep(panel(spark, sf_dir), SHORTS, LONGS)


@query(f"{_swept(candidates())} SELECT series_id, config_id, label, {T.r('sharpe_ratio')}, {T.r('total_return')} FROM swept QUALIFY {_RANKED} = 1")
def best_config(spark, sf_dir):
    return sweep.best(sweep.config_sweep(panel(spark, sf_dir), candidates())).select("series_id", "config_id", "label", "sharpe_ratio", "total_return")


@query(f"{_swept(candidates())}, ranked AS (SELECT *, {_RANKED}::int AS place FROM swept) SELECT series_id, place, label, {T.r('total_return')}, {T.r('sharpe_ratio')}, {T.r('max_drawdown')} FROM ranked WHERE place <= 6")
def top6(spark, sf_dir):
    return views.top(sweep.config_sweep(panel(spark, sf_dir), candidates()))


@query(f"""{_swept(grid(SHORTS, LONGS))} SELECT series_id, short_window, {', '.join(T.r(f'max(sharpe_ratio) FILTER (WHERE long_window = {w})', f'"{w}"') for w in LONGS)} FROM swept GROUP BY series_id, short_window""")
def heatmap_pivot(spark, sf_dir):
    return sweep.heatmap(sweep.parameter_sweep(panel(spark, sf_dir), SHORTS, LONGS), LONGS)


_REVERSION = StrategyConfig(signal_family="mean_reversion", zscore_window=40)
_SEGMENT = (*RUN, "segment")
_BY_SEGMENT = f"{_sql_bars(_REVERSION)}, {T.segments()}, {T.kpis(_SEGMENT, 'seg', 'sk')}"


@query(f"{_BY_SEGMENT} SELECT series_id, config_id, segment, {T.figures(scorecard.KPIS)} FROM sk")
def train_test_kpis(spark, sf_dir):
    return sweep.segment_kpis(_bars(spark, sf_dir, _REVERSION))


@query(f"""{_BY_SEGMENT}, sc AS ({T.scorecard_rows('sk')}) SELECT series_id, config_id, metric, {T.r("max(value) FILTER (WHERE segment = 'train')", 'in_sample')}, {T.r("max(value) FILTER (WHERE segment = 'test')", 'out_of_sample')} FROM sc GROUP BY ALL""")
def scorecard_unpivot(spark, sf_dir):
    return views.scorecard(sweep.segment_kpis(_bars(spark, sf_dir, _REVERSION)), RUN)


_GAP = """gap AS (SELECT series_id, config_id, max(sharpe_ratio) FILTER (WHERE segment = 'train') AS in_sample_sharpe, max(sharpe_ratio) FILTER (WHERE segment = 'test') AS out_of_sample_sharpe FROM sk GROUP BY ALL)"""


@query(f"{_BY_SEGMENT}, {_GAP} SELECT series_id, config_id, {T.r('in_sample_sharpe')}, {T.r('out_of_sample_sharpe')}, {T.r('in_sample_sharpe - out_of_sample_sharpe', 'gap')}, in_sample_sharpe > 0.5 AND out_of_sample_sharpe < 0 AS overfit_flag FROM gap")
def overfit_gap(spark, sf_dir):
    return robustness.overfit_gap(sweep.segment_kpis(_bars(spark, sf_dir, _REVERSION)), RUN)


_FOLD = ("series_id", "fold")
_FOLD_RUN = (*_FOLD, "config_id", "part")
_WALK = f"""{T.PANEL}, {T.folds(250, 125)}, {T.bars(candidates(), _FOLD, 'fold', ', part')}, {T.kpis(_FOLD_RUN, 'bars', 'wk')}, {T.config_values(candidates())},
wide AS (SELECT series_id, fold, config_id, max(sharpe_ratio) FILTER (WHERE part = 'train') AS train_sharpe, max(sharpe_ratio) FILTER (WHERE part = 'test') AS test_sharpe,
 max(total_return) FILTER (WHERE part = 'test') AS test_total_return, max(baseline_return) FILTER (WHERE part = 'test') AS test_baseline_return, max(max_drawdown) FILTER (WHERE part = 'test') AS test_max_drawdown FROM wk GROUP BY ALL),
span AS (SELECT series_id, fold, min(ts) AS a, max(ts) FILTER (WHERE part = 'train') AS b, max(ts) AS c FROM fold GROUP BY ALL),
walk AS (SELECT * FROM wide JOIN cfg USING (config_id) JOIN span USING (series_id, fold) QUALIFY row_number() OVER (PARTITION BY series_id, fold ORDER BY train_sharpe DESC NULLS LAST, config_id) = 1)"""


@query(f"""{_WALK} SELECT series_id, fold, strftime(a, '%Y-%m-%d') AS train_start, strftime(b, '%Y-%m-%d') AS train_end, strftime(c, '%Y-%m-%d') AS test_end, signal_family, label,
{', '.join(T.r(x) for x in ('train_sharpe', 'test_sharpe', 'test_total_return', 'test_baseline_return', 'test_max_drawdown'))} FROM walk""")
def walk_forward(spark, sf_dir):
    return sweep.walk_forward(panel(spark, sf_dir), check=False)


# Robustness and attribution


_SIMS = f"""{_sql_bars(_REVERSION)}, own AS (SELECT series_id, net, row_number() OVER {T.order()} - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM bars),
drawn AS (SELECT series_id, sim_id, i, ('0x' || substr(md5('123:' || sim_id || ':' || i), 1, 8))::bigint % n AS k FROM own, (SELECT unnest(range(0, {SIMULATIONS})) AS sim_id)),
got AS (SELECT d.series_id, sim_id, d.i, o.net FROM drawn d JOIN own o ON o.series_id = d.series_id AND o.i = d.k),
path AS (SELECT *, product(1 + net) OVER (PARTITION BY series_id, sim_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM got),
deep AS (SELECT *, e / max(e) OVER (PARTITION BY series_id, sim_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM path),
sims AS (SELECT series_id, sim_id, product(1 + net) - 1 AS tr, min(dd) AS md FROM deep GROUP BY ALL)"""


@query(f"""{_SIMS} SELECT series_id, count(*) AS n_simulations, {T.r('quantile_cont(tr, 0.5)', 'median_total_return')}, {T.r('quantile_cont(tr, 0.05)', 'p5_total_return')}, {T.r('quantile_cont(tr, 0.95)', 'p95_total_return')},
{T.r('avg((tr < 0)::int)', 'probability_of_loss')}, {T.r('quantile_cont(md, 0.5)', 'median_max_drawdown')}, {T.r('quantile_cont(md, 0.05)', 'p5_max_drawdown')} FROM sims GROUP BY series_id""")
def bootstrap_summary(spark, sf_dir):
    return robustness.bootstrap_summary(robustness.bootstrap_paths(_bars(spark, sf_dir, _REVERSION), SIMULATIONS))


@query(f"{_SIMS}, {_histogram_sql('sims', 'tr')}", plain=True)
def bootstrap_histogram(spark, sf_dir):
    return views.histogram(robustness.bootstrap_paths(_bars(spark, sf_dir, _REVERSION), SIMULATIONS), "total_return")


_RUNGS = f"rungs AS (SELECT *, gross - turn * rung AS laddered FROM bars, {T.ladder_values()})"
_LADDER = f"{_sql_bars(_REVERSION)}, {_RUNGS}, {T.kpis((*RUN, 'rung'), 'rungs', 'lk', net='laddered')}"


@query(f"{_LADDER} SELECT series_id, config_id, rung AS cost, {T.figures(('total_return', 'sharpe_ratio', 'max_drawdown', 'trade_count', 'turnover'))} FROM lk", plain=False)
def cost_ladder(spark, sf_dir):
    return attribution.cost_ladder(_bars(spark, sf_dir, _REVERSION))


@query(f"""{_sql_bars(_REVERSION)}, m AS (SELECT *, avg(net) OVER (PARTITION BY series_id) AS mean FROM bars),
cases AS (SELECT series_id, config_id, ts, 0 AS scenario_order, 'baseline' AS scenario, net AS x FROM m UNION ALL SELECT series_id, config_id, ts, 1, 'higher_costs', gross - turn * 0.005 FROM m
 UNION ALL SELECT series_id, config_id, ts, 2, 'volatility_shock', mean + (net - mean) * 1.5 FROM m UNION ALL SELECT series_id, config_id, ts, 3, 'adverse_drift', net - 0.0005 FROM m
 UNION ALL SELECT series_id, config_id, ts, 4, 'amplified_downside', CASE WHEN net >= 0 THEN net ELSE net * 1.5 END FROM m),
e AS (SELECT *, {T.product('x', (*RUN, 'scenario'))} AS eq FROM cases), d AS (SELECT *, eq / max(eq) OVER {T.so_far((*RUN, 'scenario'))} - 1 AS dd FROM e)
SELECT series_id, config_id, scenario_order, scenario, {T.r('product(1 + x) - 1', 'total_return')}, {T.r('coalesce(avg(x) * 252 / nullif(stddev_pop(x) * sqrt(252), 0), 0)', 'sharpe_ratio')}, {T.r('min(dd)', 'max_drawdown')} FROM d GROUP BY ALL""")
def stress(spark, sf_dir):
    return attribution.stress(_bars(spark, sf_dir, _REVERSION))


_REGIMES = f"""{_sql_bars(_REVERSION)}, {T.regimes('bars', RUN)},
e AS (SELECT *, {T.product('net', (*RUN, 'regime_order'))} AS reg_eq FROM reg WHERE regime_order IS NOT NULL), d AS (SELECT *, reg_eq / max(reg_eq) OVER {T.so_far((*RUN, 'regime_order'))} - 1 AS dd FROM e)
SELECT series_id, config_id, regime_order, {T.REGIME_NAME} AS regime, count(*) AS n_days, count(*) FILTER (WHERE position > 0) AS active_days, {T.r('avg((position > 0)::int)', 'active_share')}, {T.r('product(1 + net) - 1', 'total_return')},
{T.r('product(1 + mr) - 1', 'baseline_return')}, {T.r('CASE WHEN count(*) >= 20 AND stddev_pop(net) > 0 THEN avg(net) * 252 / (stddev_pop(net) * sqrt(252)) END', 'sharpe_ratio')}, {T.r('min(dd)', 'max_drawdown')}
FROM d GROUP BY series_id, config_id, regime_order"""


@query(_REGIMES)
def regime_summary(spark, sf_dir):
    return attribution.by_regime(_bars(spark, sf_dir, _REVERSION))


_SHOWN = ("total_return", "sharpe_ratio", "max_drawdown", "active_share")


def _scaled_sql(x: str) -> str:
    low, high = (f"{f}({x}) OVER (PARTITION BY series_id, config_id)" for f in ("min", "max"))
    return T.r(f"CASE WHEN {low} = {high} THEN 0.5 ELSE ({x} - {low}) / nullif({high} - {low}, 0) END", f"{x}_scaled")


@query(f"SELECT series_id, config_id, regime, {', '.join(map(_scaled_sql, _SHOWN))} FROM (WITH {_REGIMES})")
def regime_scaled(spark, sf_dir):
    by_regime = QUERIES["regime_summary"](spark, sf_dir)
    return views.normalised(by_regime, _SHOWN, RUN).select(*RUN, "regime", *(f"{c}_scaled" for c in _SHOWN))


@query(f"""{_sql_bars(_REVERSION)}, {T.segments()}, {T.kpis(_SEGMENT, 'seg', 'sk')}, {_RUNGS}, {T.kpis((*RUN, 'rung'), 'rungs', 'lk', net='laddered')},
ends AS (SELECT series_id, config_id, arg_min(total_return, rung) AS low, arg_max(total_return, rung) AS high FROM lk GROUP BY ALL),
pts AS (SELECT series_id, config_id, least(1, greatest(0, sharpe_ratio / 1.5)) * 40 AS a, least(1, greatest(0, 1 + max_drawdown / 0.5)) * 15 AS b, CASE WHEN low > 0 AND high > 0 THEN 20e0 WHEN low > 0 THEN 10e0 ELSE 0e0 END AS c
 FROM sk JOIN ends USING (series_id, config_id) WHERE segment = 'test'),
held AS (WITH {_WALK} SELECT series_id, avg((test_sharpe > 0)::int) * 25 AS d FROM walk GROUP BY series_id)
SELECT series_id, config_id, {T.r('a', 'oos_sharpe_points')}, {T.r('coalesce(d, 0e0)', 'stability_points')}, {T.r('b', 'drawdown_points')}, {T.r('c', 'cost_points')}, {T.r('a + b + c + coalesce(d, 0e0)', 'score')} FROM pts LEFT JOIN held USING (series_id)""")
def robustness_points(spark, sf_dir):
    run = _bars(spark, sf_dir, _REVERSION)
    test = sweep.segment_kpis(run).filter("segment = 'test'")
    folds = sweep.walk_forward(panel(spark, sf_dir), candidates(), check=False)
    held = run.select(*RUN).distinct().join(folds, "series_id")  # folds are of a series, whatever its configuration
    return robustness.robustness_points(test, held, attribution.cost_ladder(run), RUN)


@query(f"{T.ORDERS}, {T.bars([BASE])}, {T.kpis(RUN)} SELECT series_id, config_id, {T.figures(scorecard.KPIS)} FROM kpi")
def orders_kpis(spark, sf_dir):
    return scorecard.kpis(engine.bars(walks.orders_panel(spark, sf_dir), BASE, components=False), RUN)


@query(f"""SELECT event_type AS series_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts, count(*) AS n, arg_max(value, (ts, event_id)) AS close, min(value) AS low, max(value) AS high, {T.r('avg(value)', 'mean')} FROM events GROUP BY ALL""")
def event_bars(spark, sf_dir):
    return streaming.bars(spark.read.parquet(f"{sf_dir}/events.parquet"))


_HALVES = f"{_sql_bars(*candidates())}, {T.segments()}, {T.kpis(_SEGMENT, 'seg', 'sk')}"


@query(f"""{_HALVES}, w AS (SELECT series_id, config_id, max(sharpe_ratio) FILTER (WHERE segment = 'train') AS a, max(total_return) FILTER (WHERE segment = 'train') AS b, max(max_drawdown) FILTER (WHERE segment = 'train') AS c,
 max(sharpe_ratio) FILTER (WHERE segment = 'test') AS d, max(total_return) FILTER (WHERE segment = 'test') AS e, max(max_drawdown) FILTER (WHERE segment = 'test') AS f FROM sk GROUP BY ALL)
SELECT series_id, config_id, {T.r('a', 'train_sharpe_ratio')}, {T.r('b', 'train_total_return')}, {T.r('c', 'train_max_drawdown')}, {T.r('d', 'test_sharpe_ratio')}, {T.r('e', 'test_total_return')}, {T.r('f', 'test_max_drawdown')}
FROM w QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY a DESC NULLS LAST, config_id) = 1""")
def panel_selection(spark, sf_dir):
    return panels.selection(panel(spark, sf_dir))


@query(f"""m AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER u <= INTERVAL {sessions.GAP} SECOND THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(ts) AS began, max(ts) + INTERVAL {sessions.GAP} SECOND AS ended, count(*) AS n, {T.r('sum(value)', 'total')} FROM i GROUP BY user_id, island""")
def event_sessions(spark, sf_dir):
    return sessions.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query(f"{T.EVENT_PANEL}, {T.bars([STREAMED])} SELECT series_id, config_id, ts, {_BARS_SQL} FROM bars")
def event_backtest(spark, sf_dir):
    return engine.bars(walks.event_panel(spark.read.parquet(f"{sf_dir}/events.parquet")), STREAMED, components=False).select("series_id", "config_id", "ts", *_BARS)


def bootstrap_seeded_summary(spark, sf_dir):
    """The paths of one seeded generator can't be put in SQL; a test holds them against the generator itself."""
    return rounded(robustness.bootstrap_summary(robustness.seeded_paths(_bars(spark, sf_dir, _REVERSION), SIMULATIONS)))


QUERIES["bootstrap_seeded_summary"] = bootstrap_seeded_summary


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate strategies over the panel, best first."""
    return QUERIES["config_sweep"](spark, sf_dir)
