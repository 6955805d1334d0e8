"""Event sources: the canonical event view over the events table, and files of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.times import iso
from colonnade.session import table

URL_PREFIX = "https://api.github.com/repos/"

RAW_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("repo", T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("url", T.StringType())])),
        T.StructField("created_at", T.StringType()),
    ]
)


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, event_type, repo_id, owner, suffix, repo_name, epoch_s, pos) over the events table; pos is the input order."""
    e = table(spark, sf_dir, "events")
    owner = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    suffix = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        "event_type",
        F.col("user_id").alias("repo_id"),
        owner.alias("owner"),
        suffix.alias("suffix"),
        F.concat(owner, F.lit("/"), suffix).alias("repo_name"),
        ntz_epoch_seconds("ts").alias("epoch_s"),
        F.col("event_id").alias("pos"),
    )


def ntz_epoch_seconds(column: str):
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON lines: blank lines are skipped, unknown fields ignored; a line that does not parse or lacks a field fails the read.

    ``pos`` grows with the position in each file (and over files in the order they are read).
    """
    rows = spark.read.schema(RAW_EVENT).option("mode", "FAILFAST").json(path).withColumn("pos", F.monotonically_increasing_id())
    whole = F.col("id").isNotNull() & F.col("type").isNotNull() & F.col("created_at").isNotNull() & F.col("repo.id").isNotNull() & F.col("repo.name").isNotNull() & F.col("repo.url").isNotNull()
    checked = rows.select("*", F.assert_true(whole, F.lit("an event lacks a field")).alias("ok")).where("ok IS NULL")
    return checked.select("id", F.col("type").alias("event_type"), "repo", "created_at", "pos")


def key_value(events: DataFrame) -> DataFrame:
    """The flat event view as (key, value) structs, as events travel between a source and an encoder."""
    created = iso(F.col("epoch_s"))
    return events.select(
        F.struct("id", "event_type").alias("key"),
        F.struct(F.struct(F.col("repo_id").alias("id"), F.col("repo_name").alias("name"), derived_url("repo_name").alias("url")).alias("repo"), created.alias("created_at")).alias("value"),
        "pos",
    )


def derived_url(name: str):
    return F.concat(F.lit(URL_PREFIX), F.col(name))
