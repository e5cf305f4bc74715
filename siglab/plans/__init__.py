"""Whole plans: the backtest engine, sweeps, walk-forward, workflows, reports."""
