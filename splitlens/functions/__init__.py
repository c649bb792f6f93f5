"""Column-level helpers: numeric kernels, formatting, literals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_ntz(value: dt.date | dt.datetime) -> Column:
    """A zone-less timestamp literal (``TIMESTAMP_NTZ``) built from text, so its wall-clock
    value never depends on the session or the Python process time zone.  Constant-folded,
    it reaches Parquet ``PushedFilters`` unchanged."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
