"""Ordered and unordered record sequences on Spark: pipelines, key-value tables, versioned storage."""

from .flow import Flow, UnorderedInput, flow

__all__ = ["Flow", "UnorderedInput", "flow"]
