"""Operators over panels and bars: features, signals, exposure, costs, scorecards, attribution, research."""
