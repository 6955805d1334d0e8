"""Byte codecs (B) and event codecs (X): round trips over whole columns and tables, and payload sizes with closed forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.codecs import entropy as E
from colonnade.codecs import events as C
from colonnade.codecs import integers as I
from colonnade.operators.order import Ordered
from colonnade.plans.registry import query
from colonnade.sources.events import events_view

GROUP = 8192
_BACK = "WITH {EV} SELECT id, event_type, repo_id, repo_name, epoch_s::BIGINT AS epoch_s FROM ev"


def column_sections(o: Ordered, value, encode) -> DataFrame:
    """(grp, n, payload): one payload for each row group of a column."""

    def group(table):
        table = table.sort_by("rn")
        return pa.table({"grp": table["grp"][:1], "n": pa.array([table.num_rows]), "payload": pa.array([encode(table["v"].to_numpy())], pa.binary())})

    return o.df.select("grp", "rn", value.cast("long").alias("v")).groupBy("grp").applyInArrow(group, "grp long, n long, payload binary")


def column_values(sections: DataFrame, decode, group_rows: int) -> DataFrame:
    """(rn, value) of column_sections again."""

    def back(batches):
        for b in batches:
            for g, n, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = np.asarray(decode(p, n)).astype("i8")
                if len(v) != n:
                    raise ValueError("a payload has the wrong number of values")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + g * group_rows), pa.array(v)], ["rn", "value"])

    return sections.mapInArrow(back, "rn long, value long")


#: name: (order keys, value in SQL, layout)
_S = ("id", "event_type")
_P = ("pos",)
COLUMN_CODECS = {
    "b01_varint": (_S, "pos", C.DELTA_VARINT),
    "b02_prefix_varint": (_S, "pos", C.DELTA_PREFIX),
    "b03_reverse_varint": (_S, "repo_id", (I.reverse_varints_encode, I.reverse_varints_decode)),
    "b04_bitpack": (_S, "repo_id", C.PACKED),
    "b04b_bitpack_blocks": (_S, "epoch_s", C.DELTA_BLOCKS),
    "b05_u32_list": (_S, "repo_id", C.U32),
    "b06_u24": (_S, "repo_id", C.U24),
    "b06b_byte_planes": (_S, "epoch_s", (lambda v: I.planes_encode(v, 5), lambda b, n: I.planes_decode(b, n, 5))),
    "b06c_nibbles": (_S, "repo_id % 16", C.NIBBLES),
    "b07_categories": (_P, "epoch_s", C.DELTA_CATEGORIES),
    "b08_bitmap": (_S, "repo_id % 2", (lambda v: I.bitmap_encode(v), I.bitmap_decode)),
    "b09_interpolative": (_P, "pos * 3", (I.interpolative_encode, I.interpolative_decode)),
    "b10_arithmetic": (_S, "repo_id", C.ARITHMETIC),
    "b11_adaptive": (_S, "repo_id % 256", (E.adaptive_encode, E.adaptive_decode)),
    "b12_ans_bytes": (_S, "repo_id % 256", (lambda v: E.ans_encode(v, 12, 16, 256), E.ans_decode)),
    "b13_ans_ranked": (_S, "epoch_s % 5000", (E.ranked_ans_encode, E.ranked_ans_decode)),
    "b14_ans_wide": (_S, "repo_id", (lambda v: E.ans_encode(v, 14, 20, 1024), lambda b, n: E.ans_decode(b, n, 14, 20))),
    "b15_ans_escape": (_S, "repo_id * 7", (E.escape_ans_encode, E.escape_ans_decode)),
    "b16_ans_u16": (_S, "repo_id * 31", (lambda v: E.ans_encode(v, 16, 24), lambda b, n: E.ans_decode(b, n, 16, 24))),
    "b17_small_delta": (_S, "repo_id * 2 - 151", (E.small_delta_encode, E.small_delta_decode)),
    "b18_top_k_ans": (_S, "repo_id * 1000", (E.top_k_ans_encode, E.top_k_ans_decode)),
    "b19_context_ans": (_S, "repo_id % 5", (E.context_ans_encode, E.context_ans_decode)),
    "b20_timestamps": (_S, "epoch_s", C.TIMES),
    "b21_event_ids": (_P, "pos", C.IDS),
    "b24_numeric": (_S, "epoch_s", C.NUMERIC),
    "b25_frequency_table": (_P, "repo_id", (lambda v: E.table_encode(v), lambda b, n: E.table_decode(b)[0])),
    "b26_hybrid": (_S, "repo_id * 1000", C.HYBRID),
    "b27_permuted_times": (_S, "epoch_s - epoch_s % 60", C.PERMUTED),
    "b27b_second_counts": (_P, "epoch_s", (E.second_counts_encode, E.second_counts_decode)),
    "b16c_limited_recency": (_S, "repo_id", C.LIMITED_MTF),
    "b07b_change_markers": (_S, "repo_id % 3", C.MARKERS),
    "b10b_late_split": (_S, "epoch_s - epoch_s % 60", C.LATE_SPLIT),
    "b12b_back_references": (_S, "repo_id", C.BACK_REFS),
    "b02b_signal_deltas": (_S, "pos", C.SIGNALS),
    "b11b_adaptive_ids": (_P, "pos", C.ADAPTIVE_IDS),
    "b01b_short_deltas": (_S, "epoch_s", C.SHORT_DELTAS),
    "b10c_two_lag": (_S, "epoch_s", C.TWO_LAG),
}


def _column_query(name, keys, value, layout):
    @query(f"{name}_round_trip", "WITH {EV} SELECT row_number() OVER (ORDER BY " + ", ".join(keys) + ") - 1 AS rn, (" + value + ")::BIGINT AS value FROM ev")
    def run(spark, d):
        e = events_view(spark, d).select("id", "event_type", "pos", F.expr(value).alias("value"))  # the value alone is carried beside the order
        o = Ordered.by(e, *keys, group_rows=GROUP)
        return column_values(column_sections(o, F.col("value"), layout[0]), layout[1], GROUP)

    return run


for _n, _a in COLUMN_CODECS.items():
    _column_query(_n, *_a)


def _sizes(spark, d, value, encode, rows=GROUP):
    o = Ordered.by(events_view(spark, d), "pos", group_rows=rows)
    return column_sections(o, value, encode).select("grp", "n", F.octet_length("payload").cast("bigint").alias("bytes"))


_GRP = "WITH {EV}, r AS (SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 8192 AS grp FROM ev) SELECT grp::BIGINT AS grp, count(*)::BIGINT AS n, "


@query("b01_varint_size", _GRP + "sum(greatest(1, (length(bin(repo_id * 300)) + 6) // 7))::BIGINT AS bytes FROM r GROUP BY grp")
def b01_size(spark, d):
    return _sizes(spark, d, F.col("repo_id") * 300, I.varint_encode)


@query("b02_prefix_varint_size", _GRP + "sum(CASE WHEN length(bin(repo_id * 300)) > 56 THEN 9 ELSE greatest(1, (length(bin(repo_id * 300)) + 6) // 7) END)::BIGINT AS bytes FROM r GROUP BY grp")
def b02_size(spark, d):
    return _sizes(spark, d, F.col("repo_id") * 300, I.prefix_varint_encode)


@query("b04_bitpack_size", _GRP + "(1 + (count(*) * max(greatest(1, length(bin(repo_id)))) + 7) // 8)::BIGINT AS bytes FROM r GROUP BY grp")
def b04_size(spark, d):
    return _sizes(spark, d, F.col("repo_id"), I.bitpack_encode)


@query("b05_u32_size", _GRP + "(4 + 4 * count(*))::BIGINT AS bytes FROM r GROUP BY grp")
def b05_size(spark, d):
    return _sizes(spark, d, F.col("repo_id"), I.u32_list_encode)


@query("b08_bitmap_size", _GRP + "((count(*) + 7) // 8)::BIGINT AS bytes FROM r GROUP BY grp")
def b08_size(spark, d):
    return _sizes(spark, d, F.col("repo_id") % 2, I.bitmap_encode)


@query("b22_context_mixing", "WITH {EV} SELECT pos, repo_name FROM ev")
def b22(spark, d):
    """Names by the context-mixing coder in row groups."""
    return _strings(spark, d, C.MIXED)


@query("b22b_lzma", "WITH {EV} SELECT pos, repo_name FROM ev")
def b22b(spark, d):
    return _strings(spark, d, C.LZMA)


@query("b23_zstd_round_trip", "WITH {EV} SELECT pos, repo_name FROM ev")
def b23(spark, d):
    return _strings(spark, d, 22)


def _strings(spark, d, level):
    o = Ordered.by(events_view(spark, d), "pos", group_rows=GROUP)

    def group(table):
        table = table.sort_by("rn")
        return pa.table({"grp": table["grp"][:1], "payload": pa.array([C.compress("\n".join(table["repo_name"].to_pylist()).encode(), level)], pa.binary())})

    def back(batches):
        for b in batches:
            for g, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                names = C.expand(p, level).decode().split("\n")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names)) + g * GROUP), pa.array(names)], ["rn", "repo_name"])

    packed = o.df.select("grp", "rn", "repo_name").groupBy("grp").applyInArrow(group, "grp long, payload binary")
    return packed.mapInArrow(back, "rn long, repo_name string").join(o.df.select("rn", "pos"), "rn").select("pos", "repo_name")


#: Settings of the compressor: level, window (log2), checksum, content size stored.
_SETTINGS = {"level 1": (1, 0, False, True), "level 9": (9, 0, False, True), "level 22": (22, 0, False, True), "window 17": (19, 17, False, True), "window 24": (19, 24, False, True), "window 30": (19, 30, False, True), "checksum": (19, 0, True, True), "plain": (19, 0, False, True), "size unknown": (19, 0, False, False)}


def _zstd(data: bytes, level: int, window: int, checksum: bool, sized: bool) -> bytes:
    import zstandard

    options = {"window_log": window} if window else {}
    made = zstandard.ZstdCompressionParameters.from_level(level, write_checksum=checksum, write_content_size=sized, **options)
    return zstandard.ZstdCompressor(compression_params=made).compress(data)


def _unzstd(data: bytes, size: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor(max_window_size=1 << 31).decompress(data, max_output_size=size)


@query(
    "b28_compression_parameters",
    "WITH {EV}, g AS (SELECT (count(*) + 8191) // 8192 AS groups, count(*) AS n FROM ev), s AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in _SETTINGS) + "]) AS setting) SELECT setting, l.layout, n::BIGINT AS restored, CASE setting WHEN 'checksum' THEN 4 * groups * l.streams END::BIGINT AS added FROM g, s, (VALUES ('columns', 3), ('combined', 1)) l(layout, streams)",
)
def b28(spark, d):
    """Settings of the compressor over three columns, each on its own and all in one stream: rows that come back, and the bytes a checksum adds to the plain form."""
    o = Ordered.by(events_view(spark, d).select("pos", "epoch_s", "repo_id"), "pos", group_rows=GROUP)

    def group(table):
        table, rows = table.sort_by("rn"), []
        columns = [C.DELTA_VARINT[0](table[c].to_numpy()) for c in ("pos", "epoch_s", "repo_id")]
        for layout, streams in (("columns", columns), ("combined", [b"".join(columns)])):
            size = {}
            for name, options in _SETTINGS.items():
                packed = [_zstd(s, *options) for s in streams]
                size[name] = sum(map(len, packed))
                right = all(_unzstd(p, len(s)) == s for p, s in zip(packed, streams, strict=True))
                rows.append([name, layout, table.num_rows if right else 0, None])
            next(r for r in rows if r[:2] == ["checksum", layout])[3] = size["checksum"] - size["plain"]
        return pa.table([[r[k] for r in rows] for k in range(4)], schema=pa.schema([("setting", pa.string()), ("layout", pa.string()), ("restored", pa.int64()), ("added", pa.int64())]))

    per = o.df.groupBy("grp").applyInArrow(group, "setting string, layout string, restored long, added long")
    return per.groupBy("setting", "layout").agg(F.sum("restored").alias("restored"), F.sum("added").alias("added"))


@query(
    "b29_layout_sizes",
    "WITH {EV}, r AS (SELECT repo_id AS v FROM ev) SELECT 'varint' AS layout, sum(greatest(1, (length(bin(v)) + 6) // 7))::BIGINT AS bytes FROM r UNION ALL SELECT 'byte or exception', sum(CASE WHEN v < 128 THEN 1 ELSE 5 END)::BIGINT FROM r "
    + "".join(f"UNION ALL SELECT '{w} bits', ((count(*) * {w} + 7) // 8)::BIGINT FROM r " for w in (18, 19, 20, 24)),
)
def b29(spark, d):
    """Sizes of several layouts of one column from one pass, by formula."""
    from colonnade.functions import bits

    v = F.col("repo_id")
    one = events_view(spark, d).agg(F.sum(bits.varint_length(v)).alias("varint"), F.sum(F.when(v < 128, 1).otherwise(5)).alias("bytes"), F.count("*").alias("n"))
    rows = [F.struct(F.lit("varint").alias("layout"), F.col("varint").alias("bytes")), F.struct(F.lit("byte or exception").alias("layout"), F.col("bytes").alias("bytes"))]
    rows += [F.struct(F.lit(f"{w} bits").alias("layout"), F.ceil(F.col("n") * w / 8).alias("bytes")) for w in (18, 19, 20, 24)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.layout", "r.bytes")


def _codec_query(name):
    @query(f"x01_codec_{name}", _BACK)
    def run(spark, d):
        codec = C.CODECS[name]
        return codec.decode(codec.encode(events_view(spark, d)))

    return run


for _n in C.CODECS:
    _codec_query(_n)


@query("x02_transform_composition", "WITH {EV} SELECT row_number() OVER (ORDER BY id, event_type) - 1 AS rn, pos AS value FROM ev")
def x02(spark, d):
    """Two reversible steps composed, applied and reverted."""
    step = C.Transform(lambda v: I.delta(v), lambda v: I.undelta(v)).then(C.Transform(lambda v: I.zigzag(v), lambda u: I.unzigzag(u)))
    o = Ordered.by(events_view(spark, d), "id", "event_type", group_rows=GROUP)
    return column_values(column_sections(o, F.col("pos"), lambda v: step.apply(v).tobytes()), lambda b, n: step.revert(np.frombuffer(b, "u8")), GROUP)


@query("x03_parse_and_restore", "WITH {EV} SELECT pos, id, event_type, repo_id, repo_name, 'https://api.github.com/repos/' || repo_name AS url, epoch_s::BIGINT AS epoch_s FROM ev")
def x03(spark, d):
    """A projection into typed columns and its inverse."""
    from colonnade.functions.names import join_name, split_name
    from colonnade.sources.events import derived_url

    e = events_view(spark, d)
    owner, rest = split_name(F.col("repo_name"))
    parsed = e.select("pos", F.col("id").cast("long").alias("n"), "event_type", "repo_id", owner.alias("owner"), rest.alias("suffix"), "epoch_s")
    back = parsed.select("pos", F.col("n").cast("string").alias("id"), "event_type", "repo_id", join_name(F.col("owner"), F.col("suffix"), "owner").alias("repo_name"), "epoch_s")
    return back.withColumn("url", derived_url("repo_name"))
