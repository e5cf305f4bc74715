"""Operators for preparing large text collections: fingerprints, de-duplication, filtering, mixing, packing.

Nothing else in :mod:`siglab` imports this subpackage.
"""
