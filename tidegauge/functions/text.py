"""Text formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_UNITS = [("GB", 1024**3), ("MB", 1024**2), ("KB", 1024)]


def format_bytes(size: Column) -> Column:
    """1536 -> "1.50 KB"; below a kilobyte whole bytes."""
    text = None
    for unit, factor in _UNITS:
        value = F.format_string(f"%.2f {unit}", size / factor)
        text = F.when(size >= factor, value) if text is None else text.when(size >= factor, value)
    return text.otherwise(F.format_string("%d B", size))
