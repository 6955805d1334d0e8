"""Structured Streaming variants: late rows kept instead of dropped, tumbling counts, keyed state and encoded micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colonnade.operators.order import Ordered


def parquet_stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def marked_late(stream: DataFrame, path: str) -> DataFrame:
    """(pos, epoch_s, late) of a stream (rn, pos, epoch_s): late rows lie below the largest time of all rows before them, in the order of rn within a batch.

    A watermark would drop them; here every row comes out once. Within a batch the running maximum is that of an ordered table, spread over tasks;
    from batch to batch one number is carried, written with each batch, so that a batch that is run again finds what was before it.
    """
    spark = stream.sparkSession

    def mark(batch: DataFrame, number: int) -> None:
        top = None
        if number:
            top = spark.read.schema("top long").parquet(f"{path}/tops").where(F.col("batch") < number).agg(F.max("top")).first()[0]
        o = Ordered.by(batch.select(F.col("rn").alias("at"), "pos", "epoch_s"), "at")
        o = o.running(F.col("epoch_s"), "before", "max", inclusive=False)
        before = F.greatest("before", F.lit(top).cast("long"))
        o.df.select("pos", "epoch_s", F.coalesce(F.col("epoch_s") < before, F.lit(False)).alias("late")).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        batch.agg(F.max("epoch_s").alias("top")).write.mode("overwrite").parquet(f"{path}/tops/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(mark).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("pos", "epoch_s", "late")


def two_lag_deltas(stream: DataFrame) -> DataFrame:
    """(pos, d): each time less the larger of the key's last two (less the last for the second, less 0 for the first)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p1, p2 = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("rn", kind="stable")
        out = []
        for t in rows["epoch_s"].tolist():
            out.append(t - (0 if p1 is None else p1 if p2 is None else max(p1, p2)))
            p1, p2 = t, p1
        yield pd.DataFrame({"pos": rows["pos"], "d": out})
        state.update((p1, p2))

    return stream.groupBy("repo_id").applyInPandasWithState(step, "pos long, d long", "p1 long, p2 long", "append", GroupStateTimeout.NoTimeout)


def tumbling_counts(stream: DataFrame, width: str) -> DataFrame:
    """(start, n) updates of counts in tumbling windows, start in epoch seconds."""
    timed = stream.withColumn("ts", F.timestamp_seconds("epoch_s"))
    return timed.groupBy(F.window("ts", width)).agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("start"), "n")


def run_available(stream: DataFrame, path: str, complete: bool = False) -> DataFrame:
    """Runs the stream over what is there, to Parquet, and reads the result.

    Aggregations need complete=True and come out whole after the last batch; stateful maps append.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if complete:

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")

        writer.outputMode("complete").foreachBatch(keep).start().awaitTermination()
    else:
        writer.format("parquet").outputMode("append").start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def encoded_batches(stream: DataFrame, codec, path: str) -> DataFrame:
    """Each micro-batch encoded into sections of its own, and all of them decoded again, with the number of the batch.

    The sections lie in one table partitioned by batch, read and decoded at once, so the plan is the same for any number of batches.
    """
    spark = stream.sparkSession

    def encode(batch: DataFrame, number: int) -> None:
        codec.encode(batch).write.mode("overwrite").parquet(f"{path}/sections/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(encode).start().awaitTermination()
    return codec.decode(spark.read.parquet(f"{path}/sections").withColumn("batch", F.col("batch").cast("long")), by="batch")
