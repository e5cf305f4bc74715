"""Bars from event streams, the same in batch and streaming."""
