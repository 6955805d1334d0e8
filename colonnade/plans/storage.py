"""Scans, sinks, containers and reports (S), and streaming semantics (T)."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.codecs import events as C
from colonnade.functions import bits, times
from colonnade.operators.order import Ordered, numbered
from colonnade.plans.registry import query
from colonnade.session import scratch_folder as scratch
from colonnade.session import table
from colonnade.sources.events import events_view, read_json_lines
from colonnade.streaming import late as L

_BACK = "WITH {EV} SELECT id, event_type, repo_id, repo_name, epoch_s::BIGINT AS epoch_s FROM ev"


def improvement(size: Column, baseline: Column) -> Column:
    """Size against a baseline: -x.x%, +x.x% or baseline, rounded half up in whole tenths."""
    return F.get(F.transform(F.array(F.struct(size.alias("n"), baseline.alias("b"))), _tenths), F.lit(0))


def _tenths(s: Column) -> Column:
    gap = F.abs(s["n"] - s["b"])
    t = F.floor((2000 * gap + s["b"]) / (2 * s["b"])).cast("bigint")
    shown = F.concat(F.when(s["n"] > s["b"], "+").otherwise("-"), F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit("%"))
    return F.when(gap == 0, "baseline").otherwise(shown)


def _as_json(events: DataFrame) -> DataFrame:
    """The source format: one JSON object a line."""
    repo = F.struct(F.col("repo_id").alias("id"), F.col("repo_name").alias("name"), F.concat(F.lit("https://api.github.com/repos/"), "repo_name").alias("url"))
    return events.select("id", F.col("event_type").alias("type"), repo.alias("repo"), times.iso(F.col("epoch_s")).alias("created_at"))


def _flat(events: DataFrame) -> DataFrame:
    return events.select("id", "event_type", F.col("repo.id").alias("repo_id"), F.col("repo.name").alias("repo_name"), times.strict_epoch(F.col("created_at")).alias("epoch_s"))


@query("s01_json_lines_scan", _BACK)
def s01(spark, d):
    path = scratch(spark)
    _as_json(events_view(spark, d)).write.json(path)
    return _flat(read_json_lines(spark, path))


@query("s02_source_selection", "SELECT 'events' AS source, count(*)::BIGINT AS n FROM events UNION ALL SELECT 'orders', count(*)::BIGINT FROM orders")
def s02(spark, d):
    """The source is a parameter; the last one named wins over a default."""
    count = lambda name="events": table(spark, d, name).agg(F.lit(name).alias("source"), F.count("*").alias("n"))
    return count().unionByName(count("orders"))


@query("s03_json_array", _BACK)
def s03(spark, d):
    codec = C.CODECS["json"]
    return codec.decode(codec.encode(events_view(spark, d)))


@query("s04_compressed_json", "WITH {EV} SELECT l.level, id, event_type, repo_id, repo_name, epoch_s::BIGINT AS epoch_s FROM ev, (SELECT unnest([9, 22])::INT AS level) l")
def s04(spark, d):
    """Rows as JSON arrays in row groups, each compressed by zstd at a level, written, read again and decoded."""
    out = None
    for level in (9, 22):
        codec, path = C.JsonCodec(f"json_zstd{level}", level), scratch(spark)
        codec.encode(events_view(spark, d)).write.parquet(path)
        back = codec.decode(spark.read.parquet(path)).select(F.lit(level).alias("level"), "*")
        out = back if out is None else out.unionByName(back)
    return out


@query("s05_sections", "WITH {EV}, r AS (SELECT count(*) AS n FROM ev), g AS (SELECT unnest(['id', 'time', 'type', 'repo']) AS section) SELECT 'facts' AS part, section, n::BIGINT AS n FROM r, g UNION ALL SELECT 'types', 'types', count(DISTINCT event_type)::BIGINT FROM ev UNION ALL SELECT 'repos', s, (SELECT count(*) FROM (SELECT DISTINCT repo_id, repo_name FROM ev))::BIGINT FROM (SELECT unnest(['ids', 'names']) AS s)")
def s05(spark, d):
    """A container is a table of named sections; written as Parquet and read again."""
    path = scratch(spark)
    C.CODECS["nibbles_and_u24"].encode(events_view(spark, d)).write.parquet(path)
    return spark.read.parquet(path).groupBy("part", "section").agg(F.sum("n").alias("n"))


@query("s06_row_groups", "WITH {EV}, r AS (SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 2048 AS g FROM ev) SELECT g::BIGINT AS row_group, count(*)::BIGINT AS n, min(pos)::BIGINT AS base_id, min(epoch_s)::BIGINT AS base_ts, min(repo_id)::BIGINT AS base_repo FROM r GROUP BY g")
def s06(spark, d):
    o = Ordered.by(events_view(spark, d), "pos", group_rows=2048).df
    return o.groupBy(F.col("grp").alias("row_group")).agg(F.count("*").alias("n"), F.min("pos").alias("base_id"), F.min("epoch_s").alias("base_ts"), F.min("repo_id").alias("base_repo"))


@query("s07_column_export", "WITH {EV} SELECT 'event_type' AS column_name, count(*)::BIGINT AS n, count(DISTINCT event_type)::BIGINT AS n_distinct FROM ev UNION ALL SELECT 'repo_id', count(*)::BIGINT, count(DISTINCT repo_id)::BIGINT FROM ev UNION ALL SELECT 'epoch_s', count(*)::BIGINT, count(DISTINCT epoch_s)::BIGINT FROM ev")
def s07(spark, d):
    """One file set a column, and their statistics read back."""
    e, path, out = events_view(spark, d), scratch(spark), None
    for c in ("event_type", "repo_id", "epoch_s"):
        e.select(c).write.parquet(f"{path}/{c}")
        s = spark.read.parquet(f"{path}/{c}").agg(F.lit(c).alias("column_name"), F.count("*").alias("n"), F.countDistinct(c).alias("n_distinct"))
        out = s if out is None else out.unionByName(s)
    return out


#: How a container can be damaged, and whether it must be refused.
DAMAGE = {
    "whole": (lambda p: p, False),
    "wrong magic": (lambda p: b"?" + p[1:], True),
    "cut header": (lambda p: p[:7], True),
    "cut body": (lambda p: p[:-1], True),
    "trailing bytes": (lambda p: p + b"\0", True),
    "changed body": (lambda p: p[:-1] + bytes((p[-1] ^ 1,)), True),
    "changed count": (lambda p: p[:8] + bytes((p[8] ^ 1,)) + p[9:], True),
    "another section": (None, True),
}


@query(
    "s08_format_guard",
    "WITH {EV}, g AS (SELECT ((count(*) + 16383) // 16384)::BIGINT AS groups FROM ev), c AS (SELECT unnest(['whole', 'wrong magic', 'cut header', 'cut body', 'trailing bytes', 'changed body', 'changed count', 'another section']) AS damage) SELECT damage, 4 * groups AS sections, CASE WHEN damage = 'whole' THEN 0 ELSE 4 * groups END AS refused FROM g, c",
)
def s08(spark, d):
    """Sections of a container, whole and damaged in several ways: how many of them the reader refuses."""
    from colonnade.codecs.frames import Malformed, unframe

    def judge(batches):
        for b in batches:
            rows = []
            for section, n, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for damage, (make, _) in DAMAGE.items():
                    try:
                        unframe(section if make else section + "x", n, make(payload) if make else payload)
                        rows.append((damage, False))
                    except Malformed:
                        rows.append((damage, True))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["damage", "refused"])

    facts = C.CODECS["nibbles_and_u24"].encode(events_view(spark, d)).where("part = 'facts'").select("section", "n", "payload")
    judged = facts.mapInArrow(judge, "damage string, refused boolean")
    return judged.groupBy("damage").agg(F.count("*").alias("sections"), F.count_if("refused").alias("refused"))


@query(
    "s09_report",
    "SELECT o_orderpriority AS name, format('{:,}', sum(o_custkey)::BIGINT) AS size, (CASE WHEN sum(o_custkey) > 30000000 THEN '+' ELSE '-' END) || t // 10 || '.' || t % 10 || '%' AS gain FROM (SELECT *, (2000 * abs(sum(o_custkey) OVER (PARTITION BY o_orderpriority)::BIGINT - 30000000) + 30000000) // 60000000 AS t FROM orders) GROUP BY o_orderpriority, t",
)
def s09(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.sum("o_custkey").alias("n"))
    return per.select("name", F.format_number("n", 0).alias("size"), improvement(F.col("n"), F.lit(30000000)).alias("gain"))


@query("s09b_codec_report")
def s09b(spark, d):
    """Name, size and gain of every codec over the events against plain JSON."""
    e, out = events_view(spark, d), None
    for name, codec in C.CODECS.items():
        s = codec.encode(e).agg(F.lit(name).alias("name"), F.sum(F.octet_length("payload")).alias("bytes"))
        out = s if out is None else out.unionByName(s)
    from pyspark.sql import Window

    with_base = out.withColumn("base", F.max(F.when(F.col("name") == "json", F.col("bytes"))).over(Window.partitionBy(F.lit(1))))
    return with_base.select("name", F.format_number("bytes", 0).alias("size"), improvement(F.col("bytes"), F.col("base")).alias("gain"))


@query("s09c_codec_bounds", "SELECT unnest([" + ", ".join(f"'{n}'" for n in C.CODECS) + "]) AS name, name <> 'json' AS below_a_third")
def s09c(spark, d):
    """Every codec but plain JSON takes less than a third of it."""
    sizes = s09b(spark, d).select("name", F.regexp_replace("size", ",", "").cast("long").alias("bytes")).checkpoint()
    plain = sizes.where("name = 'json'").first()["bytes"]
    return sizes.select("name", (F.col("bytes") * 3 < plain).alias("below_a_third"))


_WIDTHS = "CASE WHEN z < 128 THEN 1 ELSE (length(bin(z)) + 6) // 7 END"


@query(
    "s10_section_sizes",
    "WITH {EV}, r AS (SELECT id::BIGINT AS id, epoch_s::BIGINT AS t, (row_number() OVER (ORDER BY id::BIGINT, pos) - 1) AS rn FROM ev), g AS (SELECT rn // 16384 AS g, id - coalesce(lag(id) OVER w, 0) AS di, t - coalesce(lag(t) OVER w, 0) AS dt FROM r WINDOW w AS (PARTITION BY rn // 16384 ORDER BY rn)), n AS (SELECT count(*) AS n, count(DISTINCT g) AS k FROM g), "
    "zi AS (SELECT CASE WHEN di >= 0 THEN 2 * di ELSE -2 * di - 1 END AS z FROM g), zt AS (SELECT CASE WHEN dt >= 0 THEN 2 * dt ELSE -2 * dt - 1 END AS z, dt NOT BETWEEN -32767 AND 32767 AS wide FROM g) "
    "SELECT 'type' AS section, (SELECT sum(20 + (c + 1) // 2) FROM (SELECT count(*) AS c FROM g GROUP BY g))::BIGINT AS bytes UNION ALL SELECT 'repo', (20 * k + 3 * n)::BIGINT FROM n UNION ALL SELECT 'id', (SELECT 20 * k FROM n) + sum(" + _WIDTHS + ")::BIGINT FROM zi "
    "UNION ALL SELECT 'time', (SELECT 24 * k FROM n) + sum(CASE WHEN wide THEN 3 ELSE 0 END + " + _WIDTHS + ")::BIGINT FROM zt",
)
def s10(spark, d):
    """Bytes of the sections of one codec's facts without the last compression."""
    stored = replace(C.CODECS["nibbles_and_u24"], level=C.STORED)
    sections = stored.encode(events_view(spark, d)).where("part = 'facts'")
    return C.sizes(sections).select("section", "bytes")


@query("s10b_section_sizes_by_formula", "WITH {EV} SELECT 'repo_id' AS section, sum(greatest(1, (length(bin(repo_id)) + 6) // 7))::BIGINT AS bytes FROM ev UNION ALL SELECT 'repo_name', sum(strlen(repo_name))::BIGINT FROM ev UNION ALL SELECT 'event_type', ((count(*) + 1) // 2)::BIGINT FROM ev")
def s10b(spark, d):
    one = events_view(spark, d).agg(F.sum(bits.varint_length(F.col("repo_id"))).alias("repo_id"), F.sum(F.octet_length("repo_name")).cast("bigint").alias("repo_name"), F.ceil(F.count("*") / 2).alias("event_type"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("bytes")) for c in ("repo_id", "repo_name", "event_type")])).alias("s")).select("s.*")


_LATE = "o AS (SELECT *, row_number() OVER (ORDER BY id, event_type) - 1 AS rn FROM ev), l AS (SELECT pos, coalesce(epoch_s < max(epoch_s) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late FROM o)"


@query("t01_late_rows_kept", "WITH {EV}, " + _LATE + " SELECT pos, late FROM l")
def t01(spark, d):
    """A stream in three batches: rows below the stream's running maximum are marked late, and kept."""
    path = scratch(spark)
    ordered = numbered(events_view(spark, d).select("pos", "epoch_s", "id", "event_type"), "id", "event_type").select("rn", "pos", "epoch_s").checkpoint()
    third = -(-ordered.count() // 3)
    for k in range(3):  # each part of the order is one file, in the order of their times of change
        ordered.where(F.floor(F.col("rn") / third) == k).coalesce(1).write.mode("append").parquet(path)
    return L.marked_late(L.parquet_stream(spark, path, "rn long, pos long, epoch_s long", files=1), scratch(spark)).select("pos", "late")


@query("t02_tumbling_counts", "WITH {EV} SELECT epoch_s::BIGINT AS second, count(*)::BIGINT AS n FROM ev GROUP BY 1")
def t02(spark, d):
    """Counts in tumbling windows of one second over a stream."""
    path = scratch(spark)
    events_view(spark, d).select("epoch_s").write.parquet(path)
    counts = L.tumbling_counts(L.parquet_stream(spark, path, "epoch_s long"), "1 second")
    return L.run_available(counts, scratch(spark), complete=True).select(F.col("start").alias("second"), "n")


@query("t03_stateful_recency", "WITH {EV}, o AS (SELECT *, row_number() OVER (ORDER BY id, event_type) - 1 AS rn FROM ev) SELECT pos, (epoch_s - coalesce(greatest(lag(epoch_s, 1) OVER w, lag(epoch_s, 2) OVER w), 0))::BIGINT AS d FROM o WINDOW w AS (PARTITION BY repo_id ORDER BY rn)")
def t03(spark, d):
    """State of two times for each key of a stream: the two-lag predictor."""
    path = scratch(spark)
    numbered(events_view(spark, d), "id", "event_type").select("rn", "pos", "repo_id", "epoch_s").write.parquet(path)
    return L.run_available(L.two_lag_deltas(L.parquet_stream(spark, path, "rn long, pos long, repo_id long, epoch_s long")), scratch(spark)).select("pos", "d")


@query("t04_micro_batches", "WITH {EV} SELECT count(*)::BIGINT AS n, count(DISTINCT repo_name)::BIGINT AS repos FROM ev")
def t04(spark, d):
    """Row groups encoded batch by batch from a stream, then decoded."""
    path = scratch(spark)
    events_view(spark, d).repartition(4).write.parquet(path)
    schema = "id string, event_type string, repo_id long, owner string, suffix string, repo_name string, epoch_s long, pos long"
    sections = L.encoded_batches(L.parquet_stream(spark, path, schema, files=2), C.CODECS["row_varints"], scratch(spark))
    return sections.agg(F.count("*").alias("n"), F.countDistinct("repo_name").alias("repos"))
