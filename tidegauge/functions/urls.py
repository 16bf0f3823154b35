"""URL path extraction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"
_AUTHORITY = _ABSOLUTE + r"([^/?#\\]*)"
_PATH = _ABSOLUTE + r"[^/?#\\]*([^?#]*)"
# Blanks, control characters, quotes, angle brackets, back-ticks, carets, braces, and all beyond ASCII are percent-encoded.
_ENCODED = r"[^\x21\x23-\x3B\x3D\x3F-\x5D\x5F\x61-\x7A\x7C\x7E]"
# Most URLs: nothing to strip, encode or resolve before the query. The path is the group.
_PLAIN = (
    r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[A-Za-z0-9._~\-]+(?::[0-9]+)?(?![^?#]*/\.{1,2}(?:[/?#]|$))"
    r"(/[A-Za-z0-9._~!$&'()*+,;=:@/\-]*)(?:[?#].*)?$"
)
_DOT, _DOTS = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"


def extract_path(url: Column) -> Column:
    """Path of an absolute URL, as a browser normalises it; ``/`` when it has none or is not an absolute URL.

    Blanks at the ends, tabs and line ends are dropped, back-slashes count as slashes, what may not stand in a path is
    percent-encoded, and dot segments are resolved. What follows in the query or fragment does not matter.
    """
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    host = F.regexp_extract(text, _AUTHORITY, 1)
    path = F.translate(F.regexp_extract(text, _PATH, 1), "\\", "/")
    one = F.transform(
        F.split(path, ""),
        lambda c: F.when(c.rlike(_ENCODED), F.regexp_replace(F.hex(c.cast("binary")), "(..)", "%$1")).otherwise(c),
    )
    path = F.when(path.rlike(_ENCODED), F.array_join(one, "")).otherwise(path)
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda held, s: F.when(s.rlike(_DOTS), F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))))
        .when(s.rlike(_DOT), held)
        .otherwise(F.concat(held, F.array(s))),
    )
    last = F.element_at(segments, -1)
    ended = (last.rlike(_DOT) | last.rlike(_DOTS)) & (F.size(kept) > 0)
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ended, "/").otherwise(""))
    path = F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), resolved).otherwise(path)
    valid = text.rlike(_ABSOLUTE) & (host != "") & ~host.rlike(r"[\x00-\x20<>^|%`{}\\]")
    full = F.when(valid & (path != ""), path).otherwise(F.lit("/"))
    return F.when(url.rlike(_PLAIN), F.regexp_extract(url, _PLAIN, 1)).otherwise(full)
