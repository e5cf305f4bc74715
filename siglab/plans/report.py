"""Files of a research run: CSV tables, charts as inline SVG, and one self-contained HTML page.

Tables that reach the driver here are scorecards, folds, regimes, rungs and one series' bars: small by nature.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglab.operators.views import SCORECARD, formatted

TABLES = ("parameter_sweep_summary", "strategy_equity_curve", "walk_forward_summary", "regime_summary", "cost_sensitivity", "stress_test_summary", "features")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes))


def write_csv(df: DataFrame, path: str, single: bool = True) -> str:
    """A folder of CSV with a header; ``single`` for one part file, which suits small tables."""
    out = rounded(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """The sink for bars at scale."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


# Charts


def _frame(body: str, title: str, wide: int = 640, high: int = 240) -> str:
    return f'<svg viewBox="0 0 {wide} {high}" width="{wide}" height="{high}" role="img"><title>{html.escape(title)}</title><rect width="{wide}" height="{high}" fill="#fff"/><text x="12" y="18" font-size="13" fill="#222">{html.escape(title)}</text>{body}</svg>'


def _span(values: Sequence[float]) -> tuple[float, float]:
    known = [v for v in values if v is not None and np.isfinite(v)] or [0.0]
    low, high = min(known), max(known)
    return (low - 1, high + 1) if low == high else (low, high)


COLOURS = ("#2a6f97", "#b08968", "#6a994e", "#bc4749")


def lines(title: str, series: dict[str, Sequence[float]], wide: int = 640, high: int = 240) -> str:
    low, high_v = _span([v for x in series.values() for v in x])
    body = ""
    for (name, values), colour in zip(series.items(), COLOURS):
        n = max(len(values) - 1, 1)
        points = " ".join(f"{30 + i / n * (wide - 50):.1f},{high - 20 - (v - low) / (high_v - low) * (high - 60):.1f}" for i, v in enumerate(values) if v is not None and np.isfinite(v))
        body += f'<polyline fill="none" stroke="{colour}" stroke-width="1.4" points="{points}"/>'
    legend = "".join(f'<text x="{wide - 130}" y="{18 + 14 * i}" font-size="11" fill="{c}">{html.escape(k)}</text>' for i, (k, c) in enumerate(zip(series, COLOURS)))
    return _frame(body + legend, title, wide, high)


def columns(title: str, labels: Sequence[str], values: Sequence[float], wide: int = 640, high: int = 240) -> str:
    low, top = _span([*values, 0.0])
    step, zero = (wide - 50) / max(len(values), 1), high - 30 - (0 - low) / (top - low) * (high - 70)
    body = ""
    for i, (label, v) in enumerate(zip(labels, values)):
        v = 0.0 if v is None or not np.isfinite(v) else v
        y = high - 30 - (v - low) / (top - low) * (high - 70)
        body += f'<rect x="{32 + i * step:.1f}" y="{min(y, zero):.1f}" width="{step * 0.8:.1f}" height="{abs(y - zero):.1f}" fill="{COLOURS[0] if v >= 0 else COLOURS[3]}"/>'
        if len(values) <= 14:
            body += f'<text x="{32 + i * step:.1f}" y="{high - 8}" font-size="9" fill="#444">{html.escape(str(label))}</text>'
    return _frame(body, title, wide, high)


def cells(title: str, table: pd.DataFrame, wide: int = 640) -> str:
    values = table.to_numpy(float)
    low, top = _span(values.ravel())
    w, body = (wide - 110) / max(table.shape[1], 1), ""
    for i, row in enumerate(table.index):
        body += f'<text x="8" y="{50 + 24 * i}" font-size="11">{html.escape(str(row))}</text>'
        for j in range(table.shape[1]):
            v = values[i, j]
            shade = int(235 - 140 * (v - low) / (top - low)) if np.isfinite(v) else 255
            body += f'<rect x="{100 + j * w:.1f}" y="{34 + 24 * i}" width="{w - 2:.1f}" height="22" fill="rgb({shade},{shade},240)"/><text x="{104 + j * w:.1f}" y="{50 + 24 * i}" font-size="10">{v:.2f}</text>'
    head = "".join(f'<text x="{104 + j * w:.1f}" y="30" font-size="10">{html.escape(str(c))}</text>' for j, c in enumerate(table.columns))
    return _frame(head + body, title, wide, 60 + 24 * len(table))


def histogram(title: str, values: Sequence[float], marks: Sequence[float] = (), bins: int = 40) -> str:
    known = [v for v in values if v is not None and np.isfinite(v)]
    counts, edges = np.histogram(known, bins) if known else (np.zeros(bins), np.linspace(0, 1, bins + 1))
    return columns(title + ("" if not len(marks) else f" (marks: {', '.join(f'{m:.3f}' for m in marks)})"), [f"{e:.3f}" for e in edges[:-1]], counts.tolist())


def stack(title: str, pictures: Sequence[str]) -> str:
    """Several pictures below one another, as one."""
    body, at = "", 0
    for picture in pictures:
        high = int(re.search(r'height="(\d+)"', picture)[1])
        body, at = body + picture.replace("<svg ", f'<svg y="{at}" ', 1), at + high
    return f'<svg viewBox="0 0 640 {at}" width="640" height="{at}" role="img"><title>{html.escape(title)}</title>{body}</svg>'


def charts(r: dict) -> dict[str, str]:
    """Each chart of a result (see :func:`siglab.plans.workflow.run_pipeline`) by name."""
    bars, sweep = r["signals"], r["sweep"]
    eq, net = bars["strategy_equity"], bars["strategy_return"]
    drawdown = (eq / eq.cummax() - 1) * 100
    regimes = r["regimes"].set_index("regime")[["total_return", "sharpe_ratio", "max_drawdown", "active_share"]]
    flat = regimes.max() == regimes.min()
    scaled = ((regimes - regimes.min()) / (regimes.max() - regimes.min()).where(~flat, 1)).where(~flat, 0.5)
    mc, ladder, out = r["monte_carlo"], r["cost_sensitivity"], {}
    out["equity_curve"] = lines("Cumulative return, %", {"Strategy": ((eq - 1) * 100).tolist(), "Baseline": ((bars["baseline_equity"] - 1) * 100).tolist()})
    out["drawdown"] = lines(f"Drawdown, % (trough {drawdown.min():.1f} on {bars['ts'].iloc[int(drawdown.to_numpy().argmin())]})", {"Drawdown": drawdown.tolist()})
    best = sweep.head(6)
    out["scenario_comparison"] = stack("Six best scenarios", [columns(f"{said}, six best", best["label"].tolist(), best[c].tolist()) for said, c in (("Total return", "total_return"), ("Sharpe ratio", "sharpe_ratio"), ("Maximal drawdown", "max_drawdown"))])
    if r.get("heatmap") is not None:
        out["sweep_heatmap"] = cells("Sharpe ratio by windows", r["heatmap"])
    out["return_distribution"] = stack("Distribution of returns", [histogram("Returns, all days", net.tolist()), histogram("Returns in the market", net[bars["position"] > 0].tolist())])
    out["kpi_dashboard"] = columns("Key figures", [k for k, _, _ in SCORECARD[:6]], [r["full_kpis"][k] for k, _, _ in SCORECARD[:6]])
    walk = r["walk_forward"]
    if walk is not None and len(walk):
        out["walk_forward"] = columns(f"Test Sharpe ratio by fold ({(walk['test_sharpe'] > 0).mean():.0%} positive)", walk["fold"].tolist(), walk["test_sharpe"].tolist())
    paths = [histogram("Bootstrap total return", list(mc["total_returns"]), [mc["p5_total_return"], mc["median_total_return"], mc["p95_total_return"]]), histogram("Bootstrap maximal drawdown", list(mc["max_drawdowns"]), [mc["p5_max_drawdown"], mc["median_max_drawdown"]])]
    out["monte_carlo"] = stack("Bootstrap", paths)
    out["regime_heatmap"] = cells("Regimes, scaled by column", scaled)
    out["cost_sensitivity"] = columns("Return by cost", [f"{x:.2%}" for x in ladder["cost"]], ladder["total_return"].tolist())
    return out


def _table(df: pd.DataFrame) -> str:
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else html.escape(str(v))
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in df.columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{show(v)}</td>" for v in row) + "</tr>" for row in df.itertuples(index=False)) + "</table>"


def page(r: dict, pictures: dict[str, str]) -> str:
    """The report: ten numbered sections, nothing fetched from anywhere."""
    both = pd.DataFrame([(label, formatted(r["in_sample_kpis"][k], kind), formatted(r["out_of_sample_kpis"][k], kind)) for k, label, kind in SCORECARD], columns=["Figure", "In sample", "Out of sample"])
    mc = pd.DataFrame([(k, v) for k, v in r["monte_carlo"].items() if np.isscalar(v)], columns=["Figure", "Value"])
    picture = lambda *names: "".join(pictures.get(n, "") for n in names)
    sections = (
        ("Summary", f"<p>Selected: <b>{html.escape(r['label'])}</b>. {html.escape(r['takeaway'])}</p>" + picture("kpi_dashboard")),
        ("Data", f"<p>{r['n_obs']} rows, {r['train_size']} to select on, {r['test_size']} held out.</p>"),
        ("Selection", _table(r["sweep"][["label", "total_return", "sharpe_ratio", "max_drawdown"]]) + picture("scenario_comparison", "sweep_heatmap")),
        ("In and out of sample", _table(both)),
        ("Equity and drawdown", picture("equity_curve", "drawdown", "return_distribution")),
        ("Walk-forward", (_table(r["walk_forward"]) if r["walk_forward"] is not None else f"<p>{html.escape(r.get('walk_forward_message') or '')}</p>") + picture("walk_forward")),
        ("Bootstrap", _table(mc) + picture("monte_carlo")),
        ("Regimes", _table(r["regimes"]) + picture("regime_heatmap")),
        ("Costs and stress", _table(r["cost_sensitivity"]) + _table(r["stress"]) + picture("cost_sensitivity")),
        ("Limits", "<p>Research diagnostics on past or synthetic data. Not advice and no forecast.</p>"),
    )
    body = "".join(f"<h2>{i}. {name}</h2>{text}" for i, (name, text) in enumerate(sections, 1))
    style = "body{font:14px sans-serif;max-width:760px;margin:auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:3px 7px;font-size:12px}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Signal research report</title><style>{style}</style></head><body><h1>Signal research report</h1>{body}</body></html>"


def write(r: dict, folder: str) -> dict[str, str]:
    """Charts and page below ``folder`` (on the driver): their paths by name."""
    root = Path(folder)
    (root / "charts").mkdir(parents=True, exist_ok=True)
    pictures, out = charts(r), {}
    for name, text in pictures.items():
        out[name] = str(root / "charts" / f"{name}.svg")
        Path(out[name]).write_text(text)
    out["report"] = str(root / "report.html")
    Path(out["report"]).write_text(page(r, pictures))
    return out
