"""File paths as they are written in listings and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for "no reference" (compared in lower case).
NO_REFERENCE = ("", "na", "n/a", "none", "not_applicable", "not applicable", "-")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal_path(c: Column) -> Column:
    """Trimmed, ``\\`` made ``/``, repeated ``/`` made one, leading ``./`` dropped, lower case."""
    slashed = F.regexp_replace(F.translate(strip(c), "\\", "/"), "/+", "/")
    return F.lower(F.regexp_replace(slashed, r"^(\./)+", ""))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def references(c: Column) -> Column:
    """The normalised references in a field split at ``;`` and ``|``; an empty array for null."""
    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), "[;|]"), strip)
    return F.transform(F.filter(pieces, lambda p: ~F.lower(p).isin(*NO_REFERENCE)), normal_path)
