"""Late rows: those whose time lies below the running maximum of the rows before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators.order import Ordered


def split_late(o: Ordered, time: str = "epoch_s") -> Ordered:
    """Adds ``late`` and ``insert_position`` (clean rows before the row); late rows that share a position form one batch."""
    o = o.running(F.col(time), "__top", "max", inclusive=False)
    o = o.with_column("late", F.coalesce(F.col(time) < F.col("__top"), F.lit(False)))
    o = o.running((~F.col("late")).cast("bigint"), "insert_position", "sum", inclusive=False)
    return o._new(o.df.drop("__top"))
