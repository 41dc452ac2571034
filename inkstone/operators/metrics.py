"""What runs leave behind: spans of time, trace tags, and rows of metrics."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TRACE = re.compile(r"[A-Za-z0-9_.-]{1,64}")


@contextmanager
def traced(spark: SparkSession, trace: str | None) -> Iterator[str | None]:
    """Tags the jobs started inside with a caller's trace id; ids with other signs are left out, not passed on."""
    tag = trace if trace and _TRACE.fullmatch(trace) else None
    if tag:
        spark.addTag(tag)
    try:
        yield tag
    finally:
        if tag:
            spark.removeTag(tag)


class Timings:
    """Named spans, in milliseconds from the start of a request."""

    def __init__(self) -> None:
        self.began, self.spans = time.perf_counter(), []

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.spans.append((name, round((start - self.began) * 1000, 3), round((time.perf_counter() - start) * 1000, 3)))

    def rows(self, spark: SparkSession, request: str) -> DataFrame:
        """(``request``, ``span``, ``start_ms``, ``duration_ms``)."""
        return spark.createDataFrame([(request, *s) for s in self.spans], "request string, span string, start_ms double, duration_ms double")


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of metrics, with the time they were written."""
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def timing_pairs(pairs: DataFrame) -> DataFrame:
    """One row on paired durations (``a``, ``b``): pairs, means, medians, share in which b is faster, mean difference.

    Pairs that lack a side don't count.
    """
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    return both.agg(F.count("*").alias("pairs"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.percentile("a", F.lit(0.5)).alias("p50_a"), F.percentile("b", F.lit(0.5)).alias("p50_b"), F.avg((F.col("b") < F.col("a")).cast("int")).alias("b_faster"), F.avg(F.col("a") - F.col("b")).alias("mean_saved"))
