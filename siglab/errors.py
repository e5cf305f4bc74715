"""Errors that callers are meant to catch."""


class ValidationError(ValueError):
    """Data or a configuration doesn't pass a check."""
