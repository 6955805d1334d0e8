"""Statistics that encodings are chosen by. Tables of symbols have one row for each distinct symbol, as (sym, cnt)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def every() -> WindowSpec:
    """All rows of a table of symbols."""
    return Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


#: A dense histogram of a wider range raises: one bad value would otherwise make rows without end.
MAX_RANGE = 50_000_000


def dense_histogram(df: DataFrame, bucket: str, max_range: int = MAX_RANGE) -> DataFrame:
    """Counts for every integer from the least to the largest bucket, zeros included; the range, of max_range at most, is made in parallel."""
    counts = df.groupBy(bucket).agg(F.count("*").alias("cnt"))
    ends = counts.agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi"))
    step = 4096
    wide = F.lit(f"a histogram of more than {max_range} buckets")
    ends = ends.select("lo", F.when(F.col("hi") - F.col("lo") <= max_range, F.col("hi")).otherwise(F.raise_error(wide).cast("bigint")).alias("hi"))
    cells = ends.where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi", F.lit(step).cast("bigint"))).alias("from"), "hi")
    seconds = cells.repartition("from").select(F.explode(F.sequence("from", F.least("hi", F.col("from") + step - 1))).alias(bucket))
    return seconds.join(counts, bucket, "left").select(bucket, F.coalesce("cnt", F.lit(0)).alias("cnt"))


def expand_histogram(counts: DataFrame, bucket: str, chunk: int = 4096) -> DataFrame:
    """Each bucket as often as its count; a large count is cut into chunks first, so no row holds a long array."""
    parts = counts.where("cnt > 0").select(bucket, "cnt", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("cnt") - 1).cast("bigint"), F.lit(chunk).cast("bigint"))).alias("from"))
    return parts.select(bucket, F.explode(F.array_repeat(F.lit(1), F.least(F.lit(chunk), F.col("cnt") - F.col("from")).cast("int"))).alias("one")).select(bucket)


def cumulative(counts: DataFrame) -> DataFrame:
    """Exclusive running sums over the alphabet."""
    before = Window.partitionBy(F.lit(1)).orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("sym", "cnt", F.coalesce(F.sum("cnt").over(before), F.lit(0)).alias("cum"))


def smoothed(counts: DataFrame, alphabet: int) -> DataFrame:
    """Every symbol of 0..alphabet-1, with a count of one at least."""
    symbols = counts.sparkSession.range(alphabet).withColumnRenamed("id", "sym")
    return symbols.join(counts, "sym", "left").select("sym", F.greatest(F.coalesce("cnt", F.lit(0)), F.lit(1)).alias("cnt"))


def _fitting(counts: DataFrame, scale: int) -> DataFrame:
    """counts, if the scale has room for all symbols; else an error."""
    full = F.raise_error(F.lit(f"more than {scale} symbols")).cast("bigint")
    return counts.select("sym", F.when(F.count("*").over(every()) <= scale, F.col("cnt")).otherwise(full).alias("cnt"))


def normalise_max(counts: DataFrame, scale: int) -> DataFrame:
    """Frequencies that sum to scale: rounded down, at least one; the first most frequent symbol gets what is missing, and gives what is too much.

    It gives down to one, then the next one does. More symbols than scale are an error.
    """
    base = _fitting(counts, scale).withColumn("total", F.sum("cnt").over(every())).withColumn("c", F.greatest(F.expr(f"cnt * {scale} div total"), F.lit(1)))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("c").desc(), "sym")
    given = F.coalesce(F.sum(F.col("c") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # what those before can give
    ranked = base.withColumn("rest", scale - F.sum("c").over(every())).withColumn("rk", F.row_number().over(order)).withColumn("given", given)
    more = F.when(F.col("rk") == 1, F.col("rest")).otherwise(F.lit(0))
    less = F.greatest(F.lit(0), F.least(F.col("c") - 1, -F.col("rest") - F.col("given")))
    return ranked.select("sym", "cnt", (F.col("c") + F.when(F.col("rest") >= 0, more).otherwise(-less)).cast("bigint").alias("freq"))


def normalise_remainders(counts: DataFrame, scale: int) -> DataFrame:
    """Frequencies that sum to scale by largest remainders, each at least one.

    A deficit is dealt out in turns by remainder, count and symbol; a surplus is taken from the smallest remainders first, each drained to one.
    More symbols than scale are an error.
    """
    one = Window.partitionBy(F.lit(1))
    base = _fitting(counts, scale).withColumn("total", F.sum("cnt").over(every())).select("sym", "cnt", F.greatest(F.expr(f"cnt * {scale} div total"), F.lit(1)).alias("c"), F.expr(f"cnt * {scale} % total").alias("rem"))
    up = F.row_number().over(one.orderBy(F.col("rem").desc(), F.col("cnt").desc(), "sym")) - 1
    drained = F.coalesce(F.sum(F.col("c") - 1).over(one.orderBy("rem", "cnt", "sym").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = base.withColumn("need", scale - F.sum("c").over(every())).withColumn("k", F.count("*").over(every())).withColumn("up", up).withColumn("drained", drained)
    more = F.expr("c + need div k + CASE WHEN up < need % k THEN 1 ELSE 0 END")
    less = F.col("c") - F.greatest(F.lit(0), F.least(F.col("c") - 1, -F.col("need") - F.col("drained")))
    return r.select("sym", "cnt", F.when(F.col("need") >= 0, more).otherwise(less).cast("bigint").alias("freq"))


def shares(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p", F.col("cnt") / F.sum("cnt").over(every()))


def entropy(counts: DataFrame) -> DataFrame:
    """Bits a symbol, and the bytes of the whole stream at that rate."""
    return shares(counts).agg(F.sum(-F.col("p") * F.log2("p")).alias("bits"), F.sum("cnt").alias("n")).select("bits", (F.col("bits") * F.col("n") / 8).alias("bytes"))


def transitions(contexts: DataFrame) -> DataFrame:
    """(depth, context, cur, cnt) for contexts of no, one and two symbols before, from rows (cur, p1, p2); one shuffle of partial counts."""
    made = F.array(
        F.struct(F.lit(0).alias("depth"), F.lit("").alias("context")),
        F.struct(F.lit(1).alias("depth"), F.col("p1").alias("context")),
        F.struct(F.lit(2).alias("depth"), F.concat("p2", F.lit(">"), "p1").alias("context")),
    )
    rows = contexts.select("cur", F.explode(made).alias("c")).where("c.context IS NOT NULL")
    return rows.groupBy("c.depth", "c.context", "cur").agg(F.count("*").alias("cnt"))


def context_gain(contexts: DataFrame, best: int = 10) -> DataFrame:
    """The two-symbol contexts that save most bits against one symbol of context: (context, gain), best first."""
    two = contexts.where("p2 IS NOT NULL").groupBy("p2", "p1", "cur").agg(F.count("*").alias("c"))
    one = contexts.where("p1 IS NOT NULL").groupBy("p1", "cur").agg(F.count("*").alias("c1"))
    q2 = two.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("p2", "p1")))
    q1 = one.select("p1", "cur", (F.col("c1") / F.sum("c1").over(Window.partitionBy("p1"))).alias("q"))
    gains = q2.join(q1, ["p1", "cur"]).groupBy("p2", "p1").agg(F.sum(F.col("c") * (F.log2("p") - F.log2("q"))).alias("gain"))
    return gains.where("gain > 0").select(F.concat("p2", F.lit(">"), "p1").alias("context"), "gain").orderBy(F.col("gain").desc(), "context").limit(best)
