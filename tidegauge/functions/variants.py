"""Strict typing over VARIANT: JSON has to *be* the type, not merely convert to it.

``try_variant_get`` casts ("5" -> 5, 1.5 -> 1). The contract does not, so every
check looks at the stored type first. All helpers are null-safe booleans.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UINT32_MAX = 4294967295


def at(doc: Column, path: str) -> Column:
    """The raw value at ``path``: SQL NULL if absent, a VARIANT null if JSON null."""
    return F.try_variant_get(doc, path, "variant")


def text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def long(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "bigint")


def double(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "double")


def boolean(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "boolean")


def kind(doc: Column, path: str) -> Column:
    """Stored type name: STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, VOID, OBJECT<..>, ARRAY<..>."""
    return F.schema_of_variant(at(doc, path))


_STORED = {
    "string": "^STRING$",
    "long": "^BIGINT$",
    "uint32": "^BIGINT$",
    "uint64": "^BIGINT$",
    "double": "^(BIGINT|DOUBLE|DECIMAL)",
    "bool": "^BOOLEAN$",
    "object": "^OBJECT",
}


def is_stored(value: Column, wanted: str) -> Column:
    """The VARIANT is exactly of the wanted type; false for null."""
    ok = F.coalesce(F.schema_of_variant(value).rlike(_STORED[wanted]), F.lit(False))
    if wanted == "uint32":
        ok = ok & F.coalesce(value.try_cast("bigint").between(0, UINT32_MAX), F.lit(False))
    if wanted == "uint64":
        ok = ok & F.coalesce(value.try_cast("bigint") >= 0, F.lit(False))
    return ok


def is_stored_sql(value: str, wanted: str) -> str:
    """``is_stored`` as SQL text, for generated conditions."""
    ok = f"coalesce(schema_of_variant({value}) RLIKE '{_STORED[wanted]}', false)"
    if wanted == "uint32":
        ok = f"({ok} AND coalesce(try_cast({value} AS BIGINT) BETWEEN 0 AND {UINT32_MAX}, false))"
    if wanted == "uint64":
        ok = f"({ok} AND coalesce(try_cast({value} AS BIGINT) >= 0, false))"
    return ok


def is_type(doc: Column, path: str, wanted: str) -> Column:
    """Present at ``path`` and exactly of the wanted type."""
    return is_stored(at(doc, path), wanted)


def is_optional(doc: Column, path: str, wanted: str) -> Column:
    """Absent, JSON null, or exactly of the wanted type."""
    return is_absent(doc, path) | is_type(doc, path, wanted)


def is_absent(doc: Column, path: str) -> Column:
    """Absent or JSON null."""
    return F.coalesce(F.is_variant_null(at(doc, path)), F.lit(False)) | at(doc, path).isNull()
