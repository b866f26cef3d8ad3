"""What a run took, counted while its rows pass by."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def throughput(df: DataFrame, footage_seconds: float | None = None) -> dict[str, float]:
    """Computes all of ``df`` (its rows go nowhere): ``rows, seconds, rows_per_second, ms_per_row`` and, for footage of a known
    length, ``times_realtime``. Rows are counted by an observation, without a second pass."""
    seen = Observation()
    began = time.monotonic()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    seconds, rows = max(time.monotonic() - began, 1e-9), seen.get["rows"]
    out = {"rows": rows, "seconds": seconds, "rows_per_second": rows / seconds, "ms_per_row": 1000 * seconds / rows if rows else 0.0}
    return out | ({"times_realtime": footage_seconds / seconds} if footage_seconds is not None else {})
