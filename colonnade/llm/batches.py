"""A bound on what a task hands to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
SPARKS_OWN = 64 << 20
BOUND = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB at most (or one row), where the session has Spark's own bound of 64 MB; any other setting stays.

    Texts and pages are long, and a task holds a few copies of a batch on each side of the pipe. The setting is read when a query is
    planned, so it is made for the session.
    """
    if str(spark.conf.get(KEY)).rstrip("bB") == str(SPARKS_OWN):
        spark.conf.set(KEY, str(BOUND))
