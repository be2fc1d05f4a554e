"""Period labels: strings that sort in time order, with "total" after all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOTAL = "total"

GRAINS = {
    "day": lambda ts: F.date_format(ts, "yyyyMMdd"),
    "month": lambda ts: F.date_format(ts, "yyyyMM"),
    "quarter": lambda ts: F.date_format(F.date_trunc("quarter", ts), "yyyyMM"),
}

READERS = {
    "datetime": lambda c: c,
    "string": lambda c: F.try_to_timestamp(c),
    "unix": lambda c: F.timestamp_seconds(c.cast("bigint")),
}


def period_label(col: Column | str, grain: str = "day", source: str = "datetime") -> Column:
    """Label of the period holding `col`, which is a datetime, a date string or unix seconds."""
    col = F.col(col) if isinstance(col, str) else col
    return GRAINS[grain](READERS[source](col))
