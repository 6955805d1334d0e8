"""Transforms of ordered streams beyond lags and running sums, and their inverses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.operators.order import Ordered


def zero_runs(o: Ordered, delta: str = "d") -> DataFrame:
    """(rn, zeros, d) for each row with a non-zero delta: how many zeros stand before it; and one row with null rn and d for the zeros at the end."""
    o = o.running(F.when(F.col(delta) != 0, F.col("rn")), "__last", "last", inclusive=False)
    nonzero = o.where(F.col(delta) != 0).select("rn", (F.col("rn") - F.coalesce("__last", F.lit(-1)) - 1).alias("zeros"), F.col(delta).alias("d"))
    end = o.df.agg(F.max("rn").alias("n"), F.max(F.when(F.col(delta) != 0, F.col("rn"))).alias("last"))
    tail = end.where("n IS NOT NULL").select(F.lit(None).cast("bigint").alias("rn"), (F.col("n") - F.coalesce("last", F.lit(-1))).alias("zeros"), F.lit(None).cast("bigint").alias("d"))
    return nonzero.unionByName(tail)


def changes(o: Ordered, value: str) -> Ordered:
    """Adds ``changed``: the value differs from the row before (the first row counts)."""
    o = o.lag(value, "__prev")
    o = o.with_column("changed", (F.col("rn") == 0) | ~F.col(value).eqNullSafe(F.col("__prev")))
    return o._new(o.df.drop("__prev"))


def runs(o: Ordered, value: str) -> DataFrame:
    """(run, value, length) of equal neighbours."""
    o = changes(o, value).running(F.col("changed").cast("bigint"), "run")
    return o.df.groupBy("run").agg(F.min(value).alias("value"), F.count("*").alias("length"))


def lag_max_delta(o: Ordered, value: str, name: str = "d") -> Ordered:
    """value less the larger of the two before it (less the one before for the second row, less 0 for the first)."""
    o = o.lag(value, "__p1", 1).lag(value, "__p2", 2)
    o = o.with_column(name, F.col(value) - F.coalesce(F.greatest("__p1", "__p2"), F.lit(0)))
    return o._new(o.df.drop("__p1", "__p2"))


def lag_max_restore(groups: DataFrame) -> DataFrame:
    """The inverse of lag_max_delta within row groups: rows (grp, rn, d, p1, p2) with the two values before each group on all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp = a = b = None
        for batch in batches:
            out = []
            for g, d, p1, p2 in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if g != grp:
                    grp, a, b = g, p1, p2
                v = d + (0 if a is None else a if b is None else max(a, b))
                a, b = v, a
                out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.int64())], ["rn", "value"])

    rows = groups.select("grp", "rn", F.col("d").cast("long"), F.col("p1").cast("long"), F.col("p2").cast("long"))
    return rows.repartition("grp").sortWithinPartitions("grp", "rn").mapInArrow(run, "rn long, value long")


def bubble_counts(o: Ordered, value: str = "epoch_s") -> DataFrame:
    """(rn, bubbles): how many earlier rows hold a larger value, for the rows that have any.

    Exact over the whole stream. Inversions within a row group are counted in the group. Two rows of different groups meet on just one
    level k, where their group numbers agree but for the bits up to k and differ in bit k: they lie in the left and the right half
    of a block. On each level a row takes part only if its value reaches beyond the least (or largest) one of the other half, so a nearly sorted stream
    leaves few. All levels are sorted at once, by block and then from the largest value down, and a right row's count is the number of left
    rows before it in its block, by a running sum. So at most log2(groups) copies of a row are sorted, and no key is joined on but the group.
    """
    points = o.df.select("rn", "grp", F.col(value).alias("v"))
    inner = _inversions(points)
    levels = int(points.agg(F.max("grp")).first()[0] or 0).bit_length()
    if not levels:
        return inner.where("bubbles > 0")
    k = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    ends = points.groupBy("grp").agg(F.max("v").alias("top"), F.min("v").alias("low")).select("grp", "top", "low", k.alias("level"))
    ends = ends.withColumn("block", F.expr("shiftright(grp, level + 1)")).withColumn("right", F.expr("shiftright(grp, level) & 1"))
    halves = ends.groupBy("level", "block").agg(F.max(F.when(F.col("right") == 0, F.col("top"))).alias("top_left"), F.min(F.when(F.col("right") == 1, F.col("low"))).alias("low_right"))
    halves = halves.where("top_left > low_right")
    part = ends.join(halves, ["level", "block"]).where("CASE WHEN right = 0 THEN top > low_right ELSE low < top_left END")
    part = part.groupBy("grp").agg(F.collect_list(F.struct("level", "block", "right", "top_left", "low_right")).alias("parts"))  # as many as levels
    rows = points.join(part, "grp").select("rn", "v", F.explode("parts").alias("p")).where("CASE WHEN p.right = 0 THEN v > p.low_right ELSE v < p.top_left END")
    rows = rows.select(F.col("rn").alias("row"), "v", "p.level", "p.block", "p.right")
    sorted_ = Ordered.by(rows, "level", "block", F.col("v").desc(), F.col("right").desc(), group_rows=o.rows)  # of equal values the right ones come first
    counted = sorted_.running((F.col("right") == 0).cast("bigint"), "lefts", inclusive=False).lag("level", "l0").lag("block", "b0")
    begins = F.when(~(F.col("level").eqNullSafe(F.col("l0")) & F.col("block").eqNullSafe(F.col("b0"))), F.col("lefts"))
    counted = counted.running(begins, "base", "last")
    outer = counted.where("right = 1").groupBy(F.col("row").alias("rn")).agg(F.sum(F.col("lefts") - F.col("base")).alias("outer"))
    return inner.join(outer, "rn", "left").select("rn", (F.col("bubbles") + F.coalesce("outer", F.lit(0))).alias("bubbles")).where("bubbles > 0")


def _inversions(points: DataFrame) -> DataFrame:
    """Earlier larger rows within each row group, by merge sort in Arrow batches of whole groups."""
    import numpy as np

    def count(v: np.ndarray) -> np.ndarray:
        n, out = len(v), np.zeros(len(v), "i8")
        order = np.arange(n)
        width = 1
        while width < n:  # runs of width are sorted by value (ties keep their order); count larger ones of the left run
            for s in range(0, n, 2 * width):
                left, right = order[s : s + width], order[s + width : s + 2 * width]
                if len(right):
                    out[right] += len(left) - np.searchsorted(v[left], v[right], side="right")
                    both = np.concatenate((left, right))
                    order[s : s + len(both)] = both[np.argsort(v[both], kind="stable")]
            width *= 2
        return out

    def run(table):
        table = table.sort_by("rn")
        return pa.table({"rn": table["rn"], "bubbles": count(table["v"].to_numpy())})

    return points.groupBy("grp").applyInArrow(run, "rn long, bubbles long")


def front_coded(values: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """(rn, grp, shared, rest) of sorted distinct strings: bytes shared with the string before, and the bytes that follow them.

    Every row group starts with a string in full, so groups are decoded on their own.
    """
    from colonnade.functions.names import prefix_bytes

    o = Ordered.by(values.select(name).distinct(), name, **({"group_rows": group_rows} if group_rows else {}))
    prev = F.lag(name).over(o.within())
    rows = o.df.withColumn("__prev", prev).select("rn", "grp", name, prefix_bytes(F.col(name), F.col("__prev")).alias("shared"))
    raw = F.encode(name, "UTF-8")
    return rows.select("rn", "grp", "shared", F.substring(raw, F.col("shared") + 1, F.octet_length(name)).alias("rest"))


def front_decoded(coded: DataFrame) -> DataFrame:
    """(rn, value): the strings of front_coded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = b""
        for b in batches:
            out = []
            for shared, rest in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                last = last[:shared] + rest
                out.append(last.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["rn", "value"])

    return coded.repartition("grp").sortWithinPartitions("grp", "rn").select("rn", "shared", "rest").mapInArrow(run, "rn long, value string")


def move_to_front(o: Ordered, symbol: str, alphabet: int) -> DataFrame:
    """(rn, grp, code): the position of each symbol in a list by recency, which starts as 0..alphabet-1 anew in every row group."""

    def run(table):
        recent, out = list(range(alphabet)), []
        table = table.sort_by("rn")
        for s in table["s"].to_pylist():
            i = recent.index(s)
            out.append(i)
            recent.insert(0, recent.pop(i))
        return pa.table({"rn": table["rn"], "grp": table["grp"], "code": pa.array(out, pa.int64())})

    return o.df.select("rn", "grp", F.col(symbol).cast("long").alias("s")).groupBy("grp").applyInArrow(run, "rn long, grp long, code long")


def move_from_front(coded: DataFrame, alphabet: int) -> DataFrame:
    """The inverse of move_to_front: (rn, symbol)."""

    def run(table):
        recent, out = list(range(alphabet)), []
        table = table.sort_by("rn")
        for i in table["code"].to_pylist():
            s = recent.pop(i)
            recent.insert(0, s)
            out.append(s)
        return pa.table({"rn": table["rn"], "symbol": pa.array(out, pa.int64())})

    return coded.groupBy("grp").applyInArrow(run, "rn long, symbol long")
