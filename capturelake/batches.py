"""Arrow batches that fit pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Most rows and bytes of an Arrow batch: a page has tens of kilobytes and more.
ROWS, BYTES = 512, 8 << 20


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches no longer than pages allow."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = conf.get(name, None) or ""
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(name, str(most))
    return df
