"""Player id clean-up. Three rules, because the exports write ids in three ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: id patterns
WRAPPED_ID = r"ObjectId\(?'?([a-f0-9]+)'?\)?"
HEX_ID = "[0-9a-f]{24}"
_MARKER = "ObjectId"


def _unwrap(c: Column) -> Column:
    """The id inside the first wrapper; a string without one stays as it is (one regex pass)."""
    return F.regexp_replace(c, f"(?s)^.*?{WRAPPED_ID}.*$", "$1")


def wrapped_or_raw(c: Column) -> Column:
    """``ObjectId('ab12')`` -> ``ab12``; any other string passes through."""
    # The marker test is a plain substring search; only rows that pass it pay for the regex.
    return F.when(F.contains(c, F.lit(_MARKER)), _unwrap(c)).otherwise(c)


def wrapped_or_strict(c: Column) -> Column:
    """As above, but a bare string must be exactly 24 hex characters."""
    inner = _unwrap(c)
    return F.when(F.contains(c, F.lit(_MARKER)), F.when(inner != c, inner)).otherwise(
        F.when(c.rlike(f"^{HEX_ID}$"), c)
    )


def first_hex_run(c: Column) -> Column:
    """The first run of 24 hex characters anywhere, else null."""
    return F.get(F.regexp_extract_all(c, F.lit(HEX_ID), F.lit(0)), F.lit(0))
