"""Ordered streams without a single-task window.

``numbered`` gives every row its dense position in a total order: rows are range-partitioned and sorted, and each sorted part starts where
the counts of the parts before it end. ``Ordered`` then works in row groups of a fixed number of positions: lags and running
aggregates run in windows partitioned by row group, and a table with one row for each group carries what the groups before leave. That table
is summed up in the same way, in spans of SPAN groups, so what one task ever orders is one row for each span (rows / GROUP_ROWS / SPAN), or
one for each sorted part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.session import shared_checkpoints

GROUP_ROWS = 131_072
SPAN = 1024


def numbered(df: DataFrame, *keys, name: str = "rn") -> DataFrame:
    """df with a dense position from 0 in the order of keys, which must be total (rows that tie may swap)."""
    shared_checkpoints(df.sparkSession)
    part, at = "__part", "__at"
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()).checkpoint()
    counts = placed.groupBy(F.shiftright(at, 33).alias(part)).count()
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each sorted part
    starts = counts.select(part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inner = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    starts = F.broadcast(starts)  # as many rows as there were tasks; the rows themselves stay where they are
    return placed.withColumn(part, F.shiftright(at, 33)).join(starts, part).withColumn(name, F.col("__start") + inner).drop(part, at, "__start")


class Ordered:
    """Rows with a dense position ``rn``, cut into row groups ``grp``."""

    def __init__(self, df: DataFrame, group_rows: int = GROUP_ROWS):
        self.rows = group_rows
        self.df = df.withColumn("grp", F.floor(F.col("rn") / group_rows).cast("long"))

    @classmethod
    def by(cls, df: DataFrame, *keys, group_rows: int = GROUP_ROWS) -> Ordered:
        return cls(numbered(df, *keys), group_rows)

    def _new(self, df: DataFrame) -> Ordered:
        out = object.__new__(Ordered)
        out.rows, out.df = self.rows, df
        return out

    def within(self) -> Window:
        return Window.partitionBy("grp").orderBy("rn")

    def lag(self, value: str, name: str, k: int = 1) -> Ordered:
        """The value k positions before, null for the first k rows; k is small against a group.

        The join with the k last values of the group before is on the group alone, so it needs no shuffle beyond the window's.
        """
        last = self.df.where(F.col("rn") % self.rows >= self.rows - k).select((F.col("rn") + k).alias("__to"), F.col(value).alias("__v"))
        entries = F.map_from_entries(F.collect_list(F.struct("__to", "__v")))
        edges = last.groupBy(F.floor(F.col("__to") / self.rows).cast("long").alias("grp")).agg(entries.alias("__edges"))
        own = F.lag(value, k).over(self.within())
        df = self.df.withColumn("__own", own).join(edges, "grp", "left")
        return self._new(df.withColumn(name, F.when(F.col("rn") % self.rows < k, F.try_element_at("__edges", F.col("rn"))).otherwise(F.col("__own"))).drop("__own", "__edges"))

    def running(self, value: Column, name: str, how: str = "sum", inclusive: bool = True) -> Ordered:
        """Running sum, max or last non-null of value, this row included or not; sums start at 0."""
        make = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
        whole = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("rn"))) if how == "last" else make("__v")
        df = self.df.withColumn("__v", value)
        carried = self._carried(df.groupBy("grp").agg(whole.alias("__w")), how, make)
        frame = self.within().rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        own, carry = make("__v").over(frame), F.col("__carry")
        df = df.withColumn("__own", own).join(carried, "grp", "left")
        if how == "sum":
            out = F.coalesce(F.col("__own"), F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif how == "max":
            out = F.greatest("__own", carry)
        else:
            out = F.coalesce("__own", carry)
        return self._new(df.withColumn(name, out).drop("__own", "__carry", "__v"))

    @staticmethod
    def _carried(groups: DataFrame, how: str, make) -> DataFrame:
        """(grp, __carry): the aggregate of all groups before each one, from (grp, __w)."""
        whole = F.max_by("__w", F.when(F.col("__w").isNotNull(), F.col("grp"))) if how == "last" else make("__w")
        groups = groups.withColumn("__span", F.floor(F.col("grp") / SPAN).cast("long"))
        spans = groups.groupBy("__span").agg(whole.alias("__s"))
        spans = spans.select("__span", make("__s").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)).alias("__far"))
        near = make("__w").over(Window.partitionBy("__span").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))
        both = groups.withColumn("__near", near).join(spans, "__span")
        if how == "sum":
            carry = F.coalesce("__near", F.lit(0)) + F.coalesce("__far", F.lit(0))
        else:
            carry = F.greatest("__near", "__far") if how == "max" else F.coalesce("__near", "__far")
        return both.select("grp", carry.alias("__carry"))

    def with_column(self, name: str, value: Column) -> Ordered:
        return self._new(self.df.withColumn(name, value))

    def where(self, condition) -> DataFrame:
        return self.df.where(condition)

    def delta(self, value: str, name: str) -> Ordered:
        """value less the one before (less 0 for the first row)."""
        o = self.lag(value, "__before")
        return o._new(o.df.withColumn(name, F.col(value) - F.coalesce("__before", F.lit(0))).drop("__before"))
