"""Collectors and scalar functions."""

from . import aggregates, bits, intervals, strings

__all__ = ["aggregates", "bits", "intervals", "strings"]
