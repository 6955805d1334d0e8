"""Aggregations: frequencies, histograms, normalisation, entropy and size statistics."""

from __future__ import annotations


from pyspark.sql import functions as F

from colonnade.functions import bits
from colonnade.operators import dictionaries as D
from colonnade.operators import statistics as S
from colonnade.operators.order import Ordered
from colonnade.plans.registry import query
from colonnade.session import table
from colonnade.sources.events import events_view

_RN = "o AS (SELECT *, row_number() OVER (ORDER BY id, event_type) - 1 AS rn FROM ev)"
_D = "g AS (SELECT rn, pos, (epoch_s - coalesce(lag(epoch_s) OVER (ORDER BY rn), 0))::BIGINT AS d FROM o)"


@query("a01_count_by_type", "SELECT event_type, count(*)::BIGINT AS cnt FROM events GROUP BY event_type")
def a01(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("cnt"))


@query("a02_count_by_repo", "WITH {EV} SELECT repo_id, repo_name, count(*)::BIGINT AS cnt FROM ev GROUP BY repo_id, repo_name")
def a02(spark, d):
    return events_view(spark, d).groupBy("repo_id", "repo_name").agg(F.count("*").alias("cnt"))


@query("a03_count_over_dimension", "WITH {EV}, r AS (SELECT DISTINCT repo_id, owner, suffix FROM ev) SELECT 'owner' AS part, owner AS value, count(*)::BIGINT AS cnt FROM r GROUP BY owner UNION ALL SELECT 'suffix', suffix, count(*)::BIGINT FROM r GROUP BY suffix")
def a03(spark, d):
    r = events_view(spark, d).select("repo_id", "owner", "suffix").distinct()
    parts = r.select(F.explode(F.array(F.struct(F.lit("owner").alias("part"), F.col("owner").alias("value")), F.struct(F.lit("suffix").alias("part"), F.col("suffix").alias("value")))).alias("p"))
    return parts.groupBy("p.part", "p.value").agg(F.count("*").alias("cnt"))


@query("a04_symbol_histogram", "SELECT (l_partkey & 255)::BIGINT AS sym, count(*)::BIGINT AS cnt FROM lineitem GROUP BY 1")
def a04(spark, d):
    return table(spark, d, "lineitem").groupBy(bits.byte_plane(F.col("l_partkey"), 0).alias("sym")).agg(F.count("*").alias("cnt"))


@query("a05_distinct", "SELECT DISTINCT event_type FROM events")
def a05(spark, d):
    return table(spark, d, "events").select("event_type").distinct()


@query("a06_distinct_tuples", "WITH {EV} SELECT DISTINCT repo_id, repo_name FROM ev")
def a06(spark, d):
    return events_view(spark, d).select("repo_id", "repo_name").distinct()


@query("a07_first_occurrence", "WITH {EV} SELECT repo_name, min(pos)::BIGINT AS first_pos FROM ev GROUP BY repo_name")
def a07(spark, d):
    return events_view(spark, d).groupBy("repo_name").agg(F.min("pos").alias("first_pos"))


@query("a08_collect_sets", "WITH {EV} SELECT repo_id, array_to_string(list_sort(list(DISTINCT repo_name)), ' ') AS names, count(DISTINCT repo_name)::INT AS n FROM ev GROUP BY repo_id")
def a08(spark, d):
    sets = events_view(spark, d).groupBy("repo_id").agg(F.sort_array(F.collect_set("repo_name")).alias("vs"))
    return sets.select("repo_id", F.array_join("vs", " ").alias("names"), F.size("vs").alias("n"))


@query("a09_having_several", "WITH {EV} SELECT suffix, count(DISTINCT repo_id)::BIGINT AS ids FROM ev GROUP BY suffix HAVING count(DISTINCT repo_id) > 70")
def a09(spark, d):
    return events_view(spark, d).select("suffix", "repo_id").distinct().groupBy("suffix").agg(F.count("*").alias("ids")).where("ids > 70")


@query("a10_min_max", "SELECT l_returnflag, min(l_partkey) AS lo, max(l_partkey) AS hi, min(l_shipdate)::VARCHAR AS first_day, max(l_orderkey) AS last_order FROM lineitem GROUP BY 1")
def a10(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi"), F.min("l_shipdate").cast("string").alias("first_day"), F.max("l_orderkey").alias("last_order"))


@query("a11_block_widths", "WITH {EV}, r AS (SELECT (row_number() OVER (ORDER BY pos) - 1) // 64 AS block, repo_id FROM ev) SELECT block::BIGINT AS block, max(greatest(1, length(bin(repo_id))))::INT AS width, (1 + (count(*) * max(greatest(1, length(bin(repo_id)))) + 7) // 8)::BIGINT AS bytes FROM r GROUP BY block")
def a11(spark, d):
    o = Ordered.by(events_view(spark, d), "pos", group_rows=64).df
    return o.groupBy(F.col("grp").alias("block")).agg(F.max(bits.bit_width(F.col("repo_id"))).alias("width"), F.count("*").alias("n")).select("block", "width", bits.packed_bytes(F.col("n"), F.col("width")).alias("bytes"))


_SEC = "s AS (SELECT epoch_s::BIGINT AS sec, count(*)::BIGINT AS cnt FROM ev GROUP BY 1), r AS (SELECT unnest(range((SELECT min(sec) FROM s), (SELECT max(sec) + 1 FROM s))) AS sec), h AS (SELECT r.sec, coalesce(cnt, 0) AS cnt FROM r LEFT JOIN s USING (sec))"


@query("a12_dense_histogram", "WITH {EV}, " + _SEC + " SELECT (sec // 86400)::BIGINT AS day, count(*)::BIGINT AS seconds, sum(cnt)::BIGINT AS events, count(*) FILTER (cnt = 0)::BIGINT AS empty FROM h GROUP BY 1")
def a12(spark, d):
    """Counts for every second, empty ones included, summed up by day."""
    h = S.dense_histogram(events_view(spark, d).select(F.col("epoch_s").alias("sec")), "sec")
    return h.groupBy(F.floor(F.col("sec") / 86400).alias("day")).agg(F.count("*").alias("seconds"), F.sum("cnt").alias("events"), F.count_if(F.col("cnt") == 0).alias("empty"))


@query("a13_histogram_expansion", "WITH {EV} SELECT epoch_s::BIGINT AS sec FROM ev")
def a13(spark, d):
    counts = events_view(spark, d).groupBy(F.col("epoch_s").alias("sec")).agg(F.count("*").alias("cnt"))
    return S.expand_histogram(counts, "sec")


@query("a14_cumulative_frequency", "SELECT sym, cnt, coalesce(sum(cnt) OVER (ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM (SELECT (l_partkey & 255)::BIGINT AS sym, count(*)::BIGINT AS cnt FROM lineitem GROUP BY 1)")
def a14(spark, d):
    return S.cumulative(a04(spark, d))


@query("a15_floor_smoothing", "WITH c AS (SELECT (l_suppkey & 255)::BIGINT AS sym, count(*)::BIGINT AS cnt FROM lineitem GROUP BY 1) SELECT i::BIGINT AS sym, greatest(coalesce(cnt, 0), 1)::BIGINT AS cnt FROM (SELECT unnest(range(256)) AS i) LEFT JOIN c ON sym = i")
def a15(spark, d):
    counts = table(spark, d, "lineitem").groupBy(bits.byte_plane(F.col("l_suppkey"), 0).alias("sym")).agg(F.count("*").alias("cnt"))
    return S.smoothed(counts, 256)


_CNT = "c AS (SELECT event_type || '/' || suffix AS k, count(*)::BIGINT AS cnt FROM ev GROUP BY 1), i AS (SELECT row_number() OVER (ORDER BY k) - 1 AS sym, cnt FROM c), t AS (SELECT sum(cnt)::BIGINT AS total FROM i)"


@query(
    "a16_normalise_max_fixup",
    "WITH {EV}, " + _CNT + ", f AS (SELECT sym, cnt, greatest(cnt * 4096 // total, 1) AS c FROM i, t), m AS (SELECT 4096 - sum(c) AS rest FROM f), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, sym) AS rk FROM f) SELECT sym::BIGINT AS sym, cnt, (c + CASE WHEN rk = 1 THEN rest ELSE 0 END)::BIGINT AS freq FROM r, m",
)
def a16(spark, d):
    return S.normalise_max(_pair_counts(spark, d), 4096)


def _pair_counts(spark, d):
    c = events_view(spark, d).groupBy(F.concat("event_type", F.lit("/"), "suffix").alias("k")).agg(F.count("*").alias("cnt"))
    from colonnade.operators.order import numbered

    return numbered(c, "k", name="sym").select("sym", "cnt")


@query(
    "a17_normalise_remainders",
    "WITH {EV}, " + _CNT + ", f AS (SELECT sym, cnt, greatest(cnt * 16384 // total, 1) AS c, cnt * 16384 % total AS rem FROM i, t), n AS (SELECT 16384 - sum(c) AS need, count(*) AS k FROM f), r AS (SELECT *, row_number() OVER (ORDER BY rem DESC, cnt DESC, sym) - 1 AS up, coalesce(sum(c - 1) OVER (ORDER BY rem, cnt, sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS drained FROM f) "
    "SELECT sym::BIGINT AS sym, cnt, (CASE WHEN need >= 0 THEN c + need // k + CASE WHEN up < need % k THEN 1 ELSE 0 END ELSE c - greatest(0, least(c - 1, -need - drained)) END)::BIGINT AS freq FROM r, n",
)
def a17(spark, d):
    return S.normalise_remainders(_pair_counts(spark, d), 16384)


_T = "y AS (SELECT rn, event_type AS cur, lag(event_type, 1) OVER (ORDER BY rn) AS p1, lag(event_type, 2) OVER (ORDER BY rn) AS p2 FROM o)"


def _contexts(spark, d):
    o = Ordered.by(events_view(spark, d).select("id", "event_type"), "id", "event_type").lag("event_type", "p1", 1).lag("event_type", "p2", 2)
    return o.df.select("rn", F.col("event_type").alias("cur"), "p1", "p2")


@query("a18_transitions", "WITH {EV}, " + _RN + ", " + _T + " SELECT 0 AS depth, '' AS context, cur, count(*)::BIGINT AS cnt FROM y GROUP BY cur UNION ALL SELECT 1, p1, cur, count(*)::BIGINT FROM y WHERE p1 IS NOT NULL GROUP BY p1, cur UNION ALL SELECT 2, p2 || '>' || p1, cur, count(*)::BIGINT FROM y WHERE p2 IS NOT NULL GROUP BY p2, p1, cur")
def a18(spark, d):
    return S.transitions(_contexts(spark, d))


_GAIN = (
    "c1 AS (SELECT p1, cur, count(*) AS c FROM y WHERE p1 IS NOT NULL GROUP BY p1, cur), c2 AS (SELECT p2, p1, cur, count(*) AS c FROM y WHERE p2 IS NOT NULL GROUP BY p2, p1, cur), "
    "q1 AS (SELECT *, c::DOUBLE / sum(c) OVER (PARTITION BY p1) AS p FROM c1), q2 AS (SELECT *, c::DOUBLE / sum(c) OVER (PARTITION BY p2, p1) AS p FROM c2), "
    "gain AS (SELECT q2.p2, q2.p1, sum(q2.c * (log2(q2.p) - log2(q1.p))) AS gain FROM q2 JOIN q1 ON q1.p1 = q2.p1 AND q1.cur = q2.cur GROUP BY q2.p2, q2.p1)"
)


@query("a19_context_gain", "WITH {EV}, " + _RN + ", " + _T + ", " + _GAIN + " SELECT p2 || '>' || p1 AS context, round(gain, 6) AS gain FROM gain WHERE gain > 0 ORDER BY gain DESC, context LIMIT 10")
def a19(spark, d):
    return S.context_gain(_contexts(spark, d)).select("context", F.round("gain", 6).alias("gain"))


_P = "c AS (SELECT (l_partkey & 255)::BIGINT AS sym, count(*)::BIGINT AS cnt FROM lineitem GROUP BY 1), p AS (SELECT cnt, cnt::DOUBLE / sum(cnt) OVER () AS p FROM c)"


@query("a20_entropy", "WITH " + _P + " SELECT round(sum(-p * log2(p)), 6) AS bits, round(sum(-p * log2(p)) * sum(cnt) / 8, 3) AS bytes FROM p")
def a20(spark, d):
    return S.entropy(a04(spark, d)).select(F.round("bits", 6).alias("bits"), F.round("bytes", 3).alias("bytes"))


@query("a21_huffman_estimate", "WITH " + _P + " SELECT sum(cnt * CASE WHEN p >= 0.5 THEN 1 ELSE least(ceil(-log2(p)), 8) END)::BIGINT AS bits FROM p")
def a21(spark, d):
    p = S.shares(a04(spark, d))
    return p.agg(F.sum(F.col("cnt") * F.when(F.col("p") >= 0.5, F.lit(1)).otherwise(F.least(F.ceil(-F.log2("p")), F.lit(8)))).cast("bigint").alias("bits"))


_FITS = [("zero", 0, 0), ("i8", -128, 127), ("i16", -32768, 32767), ("u8", 0, 255), ("u16", 0, 65535), ("u32", 0, 4294967295)]


@query("a22_fitting_shares", "WITH {EV}, " + _RN + ", " + _D + " SELECT " + ", ".join(f"round(avg(CASE WHEN d BETWEEN {a} AND {b} THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_{n}" for n, a, b in _FITS) + " FROM g")
def a22(spark, d):
    o = Ordered.by(events_view(spark, d).select("id", "event_type", "epoch_s"), "id", "event_type").delta("epoch_s", "d").df
    return o.agg(*[F.round(F.avg(F.when(F.col("d").between(a, b), 100.0).otherwise(0.0)), 6).alias(f"pct_{n}") for n, a, b in _FITS])


@query("a23_size_estimate", "WITH {EV}, " + _RN + ", " + _D + ", z AS (SELECT CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z FROM g) SELECT sum(greatest(1, (length(bin(z)) + 6) // 7))::BIGINT AS varint_bytes, (SELECT sum(greatest(1, (length(bin(epoch_s::BIGINT)) + 6) // 7)) FROM ev)::BIGINT AS plain_bytes, count(*)::BIGINT * 8 AS raw_bytes FROM z")
def a23(spark, d):
    o = Ordered.by(events_view(spark, d).select("id", "event_type", "epoch_s"), "id", "event_type").delta("epoch_s", "d").df
    return o.agg(F.sum(bits.varint_length(bits.zigzag(F.col("d")))).alias("varint_bytes"), F.sum(bits.varint_length(F.col("epoch_s"))).alias("plain_bytes"), (F.count("*") * 8).alias("raw_bytes"))


@query("a24_frequency_of_frequency", "WITH {EV}, c AS (SELECT repo_name, count(*) AS k FROM ev GROUP BY repo_name) SELECT CASE WHEN k = 1 THEN '1' WHEN k <= 10 THEN '2-10' WHEN k <= 100 THEN '11-100' ELSE '101+' END AS bucket, count(*)::BIGINT AS repos, sum(k)::BIGINT AS events FROM c GROUP BY 1")
def a24(spark, d):
    c = events_view(spark, d).groupBy("repo_name").agg(F.count("*").alias("k"))
    bucket = F.when(F.col("k") == 1, "1").when(F.col("k") <= 10, "2-10").when(F.col("k") <= 100, "11-100").otherwise("101+")
    return c.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("repos"), F.sum("k").alias("events"))


@query("a25_distinct_ratio", "WITH {EV} SELECT count(DISTINCT repo_name)::BIGINT AS repos, count(DISTINCT event_type)::BIGINT AS types, round(count(*)::DOUBLE / count(DISTINCT repo_name), 6) AS events_per_repo FROM ev")
def a25(spark, d):
    return events_view(spark, d).agg(F.countDistinct("repo_name").alias("repos"), F.countDistinct("event_type").alias("types"), F.count("*").alias("n")).select("repos", "types", F.round(F.col("n") / F.col("repos"), 6).alias("events_per_repo"))


@query("a26_ordered_concat", "WITH {EV} SELECT event_type, string_agg(DISTINCT suffix, chr(10) ORDER BY suffix) AS joined FROM ev GROUP BY event_type")
def a26(spark, d):
    return events_view(spark, d).select("event_type", "suffix").distinct().groupBy("event_type").agg(F.expr("listagg(suffix, '\n') WITHIN GROUP (ORDER BY suffix)").alias("joined"))


@query("a27_mismatches", "WITH {EV} SELECT count(*) FILTER (repo_id % 50 = 7)::BIGINT AS mismatches, min(pos) FILTER (repo_id % 50 = 7)::BIGINT AS first_pos FROM ev")
def a27(spark, d):
    e = events_view(spark, d).select("pos", "repo_id")
    other = e.select("pos", F.when(F.col("repo_id") % 50 == 7, F.lit(-1)).otherwise(F.col("repo_id")).alias("other_id"))
    differs = ~F.col("repo_id").eqNullSafe(F.col("other_id"))
    return e.join(other, "pos", "full").agg(F.count_if(differs).alias("mismatches"), F.min(F.when(differs, F.col("pos"))).alias("first_pos"))


@query(
    "a28_best_candidate",
    "WITH r AS (SELECT o_orderkey AS v, (row_number() OVER (ORDER BY o_orderkey) - 1) AS rn FROM orders), b(size) AS (VALUES (16), (32), (64), (128), (256)), w AS (SELECT size, rn // size AS blk, count(*) AS n, max(greatest(1, length(bin(v - 0)))) AS w0, min(v) AS lo, max(v) AS hi FROM r, b GROUP BY 1, 2), s AS (SELECT size, sum(9 + (n * greatest(1, length(bin(hi - lo))) + 7) // 8)::BIGINT AS bytes FROM w GROUP BY 1) SELECT size::INT AS block_rows, bytes FROM s ORDER BY bytes, size LIMIT 1",
)
def a28(spark, d):
    """All parameters at once; the smallest result wins, the first parameter among equals."""
    o = Ordered.by(table(spark, d, "orders").select(F.col("o_orderkey").alias("v")), "v").df
    tried = o.select("v", "rn", F.explode(F.array(*map(F.lit, (16, 32, 64, 128, 256)))).alias("size"))
    blocks = tried.groupBy("size", F.floor(F.col("rn") / F.col("size")).alias("blk")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sizes = blocks.groupBy("size").agg(F.sum(8 + bits.packed_bytes(F.col("n"), bits.bit_width(F.col("hi") - F.col("lo")))).alias("bytes"))
    return sizes.agg(F.min(F.struct("bytes", "size")).alias("m")).select(F.col("m.size").alias("block_rows"), F.col("m.bytes").alias("bytes"))


@query(
    "flagship_delta_summary",
    "WITH {EV}, " + _RN + ", " + _D + ", t AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS code FROM ev GROUP BY event_type), z AS (SELECT o.event_type, t.code, CASE WHEN g.d >= 0 THEN 2 * g.d ELSE -2 * g.d - 1 END AS z FROM g JOIN o USING (rn) JOIN t USING (event_type)) "
    "SELECT event_type, code::BIGINT AS code, count(*)::BIGINT AS n, sum(greatest(1, (length(bin(z)) + 6) // 7))::BIGINT AS bytes, max(greatest(1, length(bin(z))))::INT AS max_bits FROM z GROUP BY event_type, code",
)
def flagship(spark, d):
    """Dictionary and delta summary: encoded sizes of time deltas in string-id order by event type."""
    e = events_view(spark, d)
    o = Ordered.by(e.select("id", "event_type", "epoch_s"), "id", "event_type").delta("epoch_s", "d").df.select("event_type", bits.zigzag(F.col("d")).alias("z"))
    per = o.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(bits.varint_length(F.col("z"))).alias("bytes"), F.max(bits.bit_width(F.col("z"))).alias("max_bits"))
    codes = D.frequency_dictionary(e, "event_type").select("event_type", F.col("idx").alias("code"))
    return per.join(codes, "event_type").select("event_type", "code", "n", "bytes", "max_bits")


