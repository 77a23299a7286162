"""What a run says of itself: counts that Spark takes while the rows go by, and rows a second."""

from __future__ import annotations

import logging
import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger("glyphloom.runs")


def timed(rows: DataFrame, name: str = "run", path: str | None = None, **metrics: Column) -> dict[str, object]:
    """Run a query once, into a parquet table at `path` or into nothing, and give its metrics (aggregates of its rows), `rows`, `seconds` and `rows_per_second`; a line of the log says the same.

    The metrics come with the run: no row is read again for them.
    """
    seen = Observation(name)
    made = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[x.alias(k) for k, x in metrics.items()])
    began = time.perf_counter()
    if path is None:
        made.write.format("noop").mode("overwrite").save()
    else:
        made.write.parquet(path)
    seconds = time.perf_counter() - began
    told = {**seen.get, "seconds": seconds, "rows_per_second": seen.get["rows"] / seconds}
    LOG.info("%s: %s", name, ", ".join(f"{k}={v:.3f}" if isinstance(v, float) else f"{k}={v}" for k, v in told.items()))
    return told
