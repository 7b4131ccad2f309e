"""Scalar function shims with pinned result types."""

from ..compat import ceil, floor, power, safe_cast

__all__ = ["ceil", "floor", "power", "safe_cast"]
