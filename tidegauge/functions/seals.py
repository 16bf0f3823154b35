"""Telling whether a text is one JSON document and nothing more."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sealed_text(text: Column) -> Column:
    # The JSON reader stops after the first value, so "[] junk" would pass. Closing
    # the text inside an array with its own hash makes trailing text visible.
    return F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text).cast("string"), F.lit("]"))


def sealed(text: Column) -> Column:
    """VARIANT array of the document and its seal; null if that is not JSON."""
    return F.try_parse_json(sealed_text(text))


def unsealed(doc: Column, text: Column) -> Column:
    """``doc`` from ``sealed``, with the document at ``$[0]``, or null if the text held more than it."""
    seal = F.try_variant_get(doc, "$[1]", "bigint")
    parts = F.size(F.try_variant_get(doc, "$", "array<boolean>"))
    return F.when((seal == F.xxhash64(text)) & (parts == 2), doc)
