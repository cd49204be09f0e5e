"""Times as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(at: Column | str) -> Column:
    """Microseconds of a time, with or without a zone (then the session's)."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))
