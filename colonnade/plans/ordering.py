"""Ordered-stream operators (W) and sorts and limits (O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from colonnade.operators import dictionaries as D
from colonnade.operators import ordered as R
from colonnade.operators.late import split_late
from colonnade.operators.order import Ordered, numbered
from colonnade.plans.registry import query
from colonnade.session import table
from colonnade.sources.events import events_view

_RN = "o AS (SELECT *, row_number() OVER (ORDER BY id, event_type) - 1 AS rn FROM ev)"
_D = "g AS (SELECT rn, pos, event_type, epoch_s::BIGINT AS epoch_s, (epoch_s - coalesce(lag(epoch_s) OVER (ORDER BY rn), 0))::BIGINT AS d FROM o)"
_LATE = _RN + ", l AS (SELECT *, coalesce(epoch_s < max(epoch_s) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late FROM o), p AS (SELECT *, coalesce(sum(CASE WHEN late THEN 0 ELSE 1 END) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS insert_position FROM l)"
GROUP = 2048


def stream(spark, d, *cols: str) -> Ordered:
    """Events in the canonical (string) order; only the order's and the named columns are carried."""
    return Ordered.by(events_view(spark, d).select("id", "event_type", *cols), "id", "event_type", group_rows=GROUP)


@query("w01_id_delta", "WITH {EV}, " + _RN + ", " + _D + " SELECT pos, rn::BIGINT AS rn, (pos - coalesce(lag(pos) OVER (ORDER BY rn), 0))::BIGINT AS id_delta, d AS ts_delta FROM g")
def w01(spark, d):
    o = stream(spark, d, "pos", "epoch_s").delta("pos", "id_delta").delta("epoch_s", "ts_delta")
    return o.df.select("pos", "rn", "id_delta", "ts_delta")


@query("w02_inverse_delta", "WITH {EV}, " + _RN + " SELECT rn::BIGINT AS rn, pos AS id, epoch_s::BIGINT AS epoch_s FROM o")
def w02(spark, d):
    o = Ordered(w01(spark, d).select("rn", "id_delta", "ts_delta"), GROUP)
    return o.running(F.col("id_delta"), "id").running(F.col("ts_delta"), "epoch_s").df.select("rn", "id", "epoch_s")


@query("w03_sorted_index", "WITH {EV} SELECT repo_id, repo_name, row_number() OVER (ORDER BY repo_id, repo_name) - 1 AS idx FROM (SELECT DISTINCT repo_id, repo_name FROM ev)")
def w03(spark, d):
    return D.sorted_dictionary(events_view(spark, d), "repo_id", "repo_name").select("repo_id", "repo_name", "idx")


@query("w04_frequency_index", "WITH {EV} SELECT suffix, count(*)::BIGINT AS cnt, row_number() OVER (ORDER BY count(*) DESC, suffix) - 1 AS idx FROM ev GROUP BY suffix")
def w04(spark, d):
    return D.frequency_dictionary(events_view(spark, d), "suffix").select("suffix", "cnt", "idx")


@query("w05_first_seen_index", "WITH {EV} SELECT repo_name, min(pos)::BIGINT AS first_pos, row_number() OVER (ORDER BY min(pos), repo_name) - 1 AS idx FROM ev GROUP BY repo_name")
def w05(spark, d):
    return D.first_seen_dictionary(events_view(spark, d), "repo_name").select("repo_name", "first_pos", "idx")


@query("w06_first_value", "WITH {EV}, r AS (SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 2048 AS g FROM ev) SELECT g::BIGINT AS row_group, arg_min(epoch_s, pos)::BIGINT AS base_ts, arg_min(id, pos) AS base_id FROM r GROUP BY g")
def w06(spark, d):
    o = Ordered.by(events_view(spark, d), "pos", group_rows=GROUP).df
    return o.groupBy(F.col("grp").alias("row_group")).agg(F.min_by("epoch_s", "rn").alias("base_ts"), F.min_by("id", "rn").alias("base_id"))


@query("w07_change_points", "WITH {EV}, " + _RN + " SELECT rn::BIGINT AS rn, event_type FROM (SELECT rn, event_type, lag(event_type) OVER (ORDER BY rn) AS p FROM o) WHERE p IS DISTINCT FROM event_type")
def w07(spark, d):
    return R.changes(stream(spark, d), "event_type").where("changed").select("rn", "event_type")


@query("w07b_forward_fill", "WITH {EV}, " + _RN + " SELECT rn::BIGINT AS rn, event_type FROM o")
def w07b(spark, d):
    """Markers spread over the rows after them."""
    o = R.changes(stream(spark, d), "event_type").with_column("marker", F.when(F.col("changed"), F.col("event_type")))
    return o._new(o.df.select("rn", "grp", "marker")).running(F.col("marker"), "event_type", "last").df.select("rn", "event_type")


@query("w08_zero_runs", "WITH {EV}, s AS (SELECT (row_number() OVER (ORDER BY repo_id, pos) - 1) AS rn, repo_id FROM ev), g AS (SELECT rn, repo_id - coalesce(lag(repo_id) OVER (ORDER BY rn), 0) AS d FROM s), z AS (SELECT rn, d, rn - coalesce(lag(rn) OVER (ORDER BY rn), -1) - 1 AS zeros FROM g WHERE d <> 0) SELECT rn::BIGINT AS rn, zeros::BIGINT AS zeros, d::BIGINT AS d FROM z UNION ALL SELECT NULL, (SELECT max(rn) FROM g) - (SELECT max(rn) FROM z), NULL")
def w08(spark, d):
    return R.zero_runs(Ordered.by(events_view(spark, d), "repo_id", "pos", group_rows=GROUP).delta("repo_id", "d"))


@query("w09_run_lengths", "WITH {EV}, " + _RN + ", c AS (SELECT rn, event_type, CASE WHEN lag(event_type) OVER (ORDER BY rn) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS ch FROM o), r AS (SELECT *, sum(ch) OVER (ORDER BY rn) AS run FROM c), l AS (SELECT run, count(*) AS n FROM r GROUP BY run) SELECT count(*)::BIGINT AS runs, round(avg(n), 6) AS mean, max(n)::BIGINT AS longest, count(*) FILTER (n = 1)::BIGINT AS ones, count(*) FILTER (n BETWEEN 2 AND 5)::BIGINT AS two_to_five, count(*) FILTER (n > 5)::BIGINT AS more FROM l")
def w09(spark, d):
    n = F.col("length")
    return R.runs(stream(spark, d), "event_type").agg(F.count("*").alias("runs"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("longest"), F.count_if(n == 1).alias("ones"), F.count_if(n.between(2, 5)).alias("two_to_five"), F.count_if(n > 5).alias("more"))


@query("w10_two_lag_max", "WITH {EV}, " + _RN + " SELECT rn::BIGINT AS rn, (epoch_s - coalesce(greatest(lag(epoch_s, 1) OVER (ORDER BY rn), lag(epoch_s, 2) OVER (ORDER BY rn)), 0))::BIGINT AS d FROM o")
def w10(spark, d):
    return R.lag_max_delta(stream(spark, d, "epoch_s"), "epoch_s").df.select("rn", "d")


@query("w10b_two_lag_max_inverse", "WITH {EV}, " + _RN + " SELECT rn::BIGINT AS rn, epoch_s::BIGINT AS value FROM o")
def w10b(spark, d):
    """Each row group restores from the two values before it, which are stored with the group."""
    o = R.lag_max_delta(stream(spark, d, "epoch_s"), "epoch_s").lag("epoch_s", "p1", 1).lag("epoch_s", "p2", 2)
    first = o.df.where(F.col("rn") % GROUP == 0).select("grp", "p1", "p2")
    return R.lag_max_restore(o.df.select("grp", "rn", "d").join(first, "grp"))


@query("w11_late_split", "WITH {EV}, " + _LATE + " SELECT pos, late, insert_position FROM p")
def w11(spark, d):
    return split_late(stream(spark, d, "pos", "epoch_s")).df.select("pos", "late", "insert_position")


@query("w12_late_offset", "WITH {EV}, " + _LATE + ", c AS (SELECT row_number() OVER (ORDER BY rn) AS n, epoch_s FROM p WHERE NOT late) SELECT p.pos, greatest(c.epoch_s - p.epoch_s, 0)::BIGINT AS behind FROM p LEFT JOIN c ON c.n = p.insert_position WHERE late")
def w12(spark, d):
    o = split_late(stream(spark, d, "pos", "epoch_s")).running(F.when(~F.col("late"), F.col("epoch_s")), "clean_s", "last", inclusive=False)
    return o.where("late").select("pos", F.greatest(F.col("clean_s") - F.col("epoch_s"), F.lit(0)).alias("behind"))


@query("w13_insertion_log", "WITH {EV}, o AS (SELECT *, row_number() OVER (ORDER BY id, event_type) - 1 AS rn FROM ev), b AS (SELECT a.rn, count(*) AS bubbles FROM o a JOIN o b ON b.rn < a.rn AND b.epoch_s > a.epoch_s GROUP BY a.rn) SELECT rn::BIGINT AS rn, bubbles::BIGINT AS bubbles, (rn - coalesce(lag(rn) OVER (ORDER BY rn), -1) - 1)::BIGINT AS advance FROM b")
def w13(spark, d):
    """Bubbling rows with the gap since the one before."""
    o = stream(spark, d, "epoch_s")
    moved = R.bubble_counts(o)
    log = Ordered(numbered(moved, F.col("rn"), name="k").withColumnRenamed("rn", "at").withColumnRenamed("k", "rn"), GROUP).lag("at", "before")
    return log.df.select(F.col("at").alias("rn"), "bubbles", (F.col("at") - F.coalesce("before", F.lit(-1)) - 1).alias("advance"))


@query(
    "w15_front_coding",
    "WITH n AS (SELECT s, row_number() OVER (ORDER BY encode(s)) - 1 AS rn FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS s FROM documents)), p AS (SELECT rn, s, CASE WHEN rn % 16 > 0 THEN lag(s) OVER (ORDER BY rn) END AS q FROM n), "
    "c AS (SELECT rn, s, (CASE WHEN q IS NULL THEN 0 ELSE coalesce((SELECT min(i) FROM (SELECT unnest(range(1, least(strlen(s), strlen(q)) + 1)) AS i) WHERE substr(hex(encode(s)), 2 * i - 1, 2) <> substr(hex(encode(q)), 2 * i - 1, 2)) - 1, least(strlen(s), strlen(q))) END)::INT AS shared FROM p) "
    "SELECT rn::BIGINT AS rn, shared, substr(hex(encode(s)), 2 * shared + 1) AS rest, s AS value FROM c",
)
def w15(spark, d):
    """The documents' words in blocks of 16: bytes shared with the word before, the rest, and the words decoded from these."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("s"))
    coded = R.front_coded(words, "s", 16)
    return coded.select("rn", "shared", F.hex("rest").alias("rest")).join(R.front_decoded(coded), "rn")


_MTF = "s AS (SELECT rn, rn // 2048 AS grp, repo_id % 16 AS s FROM o), x AS (SELECT *, max(rn) OVER (PARTITION BY grp, s ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s)"


@query("w16_move_to_front", "WITH {EV}, " + _RN + ", " + _MTF + ", f AS (SELECT grp, s, min(rn) AS first FROM s GROUP BY 1, 2) SELECT x.rn::BIGINT AS rn, (CASE WHEN last IS NOT NULL THEN (SELECT count(DISTINCT y.s) FROM s y WHERE y.grp = x.grp AND y.rn > x.last AND y.rn < x.rn) ELSE x.s + (SELECT count(*) FROM f WHERE f.grp = x.grp AND f.first < x.rn AND f.s > x.s) END)::BIGINT AS code FROM x")
def w16(spark, d):
    return R.move_to_front(stream(spark, d, "repo_id").with_column("s", F.col("repo_id") % 16), "s", 16).select("rn", "code")


@query("w16b_move_to_front_inverse", "WITH {EV}, " + _RN + " SELECT rn::BIGINT AS rn, (repo_id % 16)::BIGINT AS symbol FROM o")
def w16b(spark, d):
    return R.move_from_front(R.move_to_front(stream(spark, d, "repo_id").with_column("s", F.col("repo_id") % 16), "s", 16), 16)


@query(
    "w17_limited_move_to_front",
    "WITH {EV}, " + _RN + ", t AS (SELECT repo_name, row_number() OVER (ORDER BY count(*) DESC, repo_name) - 1 AS sym FROM ev GROUP BY repo_name QUALIFY sym < 64), s AS (SELECT rn, rn // 2048 AS grp, sym AS s, repo_name FROM o JOIN t USING (repo_name)), "
    "x AS (SELECT *, max(rn) OVER (PARTITION BY grp, s ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s), f AS (SELECT grp, s, min(rn) AS first FROM s GROUP BY 1, 2) "
    "SELECT x.rn::BIGINT AS rn, repo_name, (CASE WHEN last IS NOT NULL THEN (SELECT count(DISTINCT y.s) FROM s y WHERE y.grp = x.grp AND y.rn > x.last AND y.rn < x.rn) ELSE x.s + (SELECT count(*) FROM f WHERE f.grp = x.grp AND f.first < x.rn AND f.s > x.s) END)::BIGINT AS code FROM x "
    "UNION ALL SELECT rn::BIGINT, repo_name, NULL FROM o WHERE repo_name NOT IN (SELECT repo_name FROM t)",
)
def w17(spark, d):
    """Move-to-front over the most frequent symbols only: their codes, and the names decoded from these; the rest is kept as it is."""
    o = numbered(events_view(spark, d).select("id", "event_type", "repo_name"), "id", "event_type")
    best = D.top_k(o, "repo_name", 64)
    head, rest = D.split_by(o, best, "repo_name")
    coded = R.move_to_front(Ordered(head, GROUP), "sym", 64)
    back = R.move_from_front(coded, 64).join(F.broadcast(best.select(F.col("sym").alias("symbol"), "repo_name")), "symbol").join(coded.select("rn", "code"), "rn")
    return back.select("rn", "repo_name", "code").unionByName(rest.select("rn", "repo_name", F.lit(None).cast("bigint").alias("code")))


@query(
    "w18_context_choice",
    "WITH {EV}, " + _RN + ", y AS (SELECT rn, event_type AS cur, lag(event_type, 1) OVER (ORDER BY rn) AS p1, lag(event_type, 2) OVER (ORDER BY rn) AS p2 FROM o), c1 AS (SELECT p1, cur, count(*) AS c FROM y WHERE p1 IS NOT NULL GROUP BY p1, cur), c2 AS (SELECT p2, p1, cur, count(*) AS c FROM y WHERE p2 IS NOT NULL GROUP BY p2, p1, cur), "
    "q1 AS (SELECT *, c::DOUBLE / sum(c) OVER (PARTITION BY p1) AS p FROM c1), q2 AS (SELECT *, c::DOUBLE / sum(c) OVER (PARTITION BY p2, p1) AS p FROM c2), best AS (SELECT q2.p2, q2.p1 FROM q2 JOIN q1 ON q1.p1 = q2.p1 AND q1.cur = q2.cur GROUP BY q2.p2, q2.p1 HAVING sum(q2.c * (log2(q2.p) - log2(q1.p))) > 0 ORDER BY sum(q2.c * (log2(q2.p) - log2(q1.p))) DESC, q2.p2 || '>' || q2.p1 LIMIT 10) "
    "SELECT rn::BIGINT AS rn, CASE WHEN y.p1 IS NULL THEN 'start' WHEN b.p1 IS NOT NULL THEN y.p2 || '>' || y.p1 ELSE y.p1 END AS model FROM y LEFT JOIN best b ON b.p1 = y.p1 AND b.p2 = y.p2",
)
def w18(spark, d):
    from colonnade.operators.statistics import context_gain

    y = stream(spark, d).lag("event_type", "p1", 1).lag("event_type", "p2", 2).df.select("rn", F.col("event_type").alias("cur"), "p1", "p2")
    best = F.broadcast(context_gain(y).select("context", F.lit(True).alias("chosen")))  # ten rows
    two = F.concat("p2", F.lit(">"), "p1")
    joined = y.withColumn("context", two).join(best, "context", "left")
    return joined.select("rn", F.when(F.col("p1").isNull(), "start").when(F.col("chosen"), F.col("context")).otherwise(F.col("p1")).alias("model"))


@query("w19_row_groups", "WITH {EV}, r AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS rn FROM ev) SELECT rn // 64 AS block, count(*)::BIGINT AS n, min(rn)::BIGINT AS first_rn, max(rn)::BIGINT AS last_rn FROM r GROUP BY 1")
def w19(spark, d):
    return Ordered.by(events_view(spark, d), "pos", group_rows=64).df.groupBy(F.col("grp").alias("block")).agg(F.count("*").alias("n"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"))


@query("w20_duplicate_ids", "WITH {EV}, r AS (SELECT repo_id, row_number() OVER (ORDER BY repo_id, repo_name) - 1 AS rn FROM (SELECT DISTINCT repo_id, repo_name FROM ev)), x AS (SELECT rn, repo_id, repo_id IS NOT DISTINCT FROM lag(repo_id) OVER (ORDER BY rn) AS dup FROM r) SELECT rn::BIGINT AS rn, (rn - coalesce(lag(rn) OVER (ORDER BY rn), 0))::BIGINT AS gap FROM x WHERE dup")
def w20(spark, d):
    o = Ordered(D.sorted_dictionary(events_view(spark, d), "repo_id", "repo_name", index="rn"), GROUP).lag("repo_id", "before")
    o = o.running(F.when(F.col("repo_id") == F.col("before"), F.col("rn")), "prev_dup", "last", inclusive=False)
    return o.where("repo_id = before").select("rn", (F.col("rn") - F.coalesce("prev_dup", F.lit(0))).alias("gap"))


@query("w21_difference_statistics", "WITH {EV}, " + _RN + ", " + _D + " SELECT min(d)::BIGINT AS lo, max(d)::BIGINT AS hi, round(avg(CASE WHEN d = 0 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_zero, round(avg(CASE WHEN d BETWEEN -128 AND 127 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_i8 FROM g WHERE rn > 0")
def w21(spark, d):
    o = stream(spark, d, "epoch_s").delta("epoch_s", "d").where("rn > 0")
    share = lambda c: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 6)
    return o.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), share(F.col("d") == 0).alias("pct_zero"), share(F.col("d").between(-128, 127)).alias("pct_i8"))


@query("w22_positions", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS rn FROM lineitem")
def w22(spark, d):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return numbered(table(spark, d, "lineitem").select(*cols, "l_quantity", "l_shipdate"), *cols, "l_quantity", "l_shipdate").select(*cols, "rn")



@query("o01_canonical_sort", "WITH {EV} SELECT id, event_type, row_number() OVER (ORDER BY id, event_type) - 1 AS rn FROM ev")
def o01(spark, d):
    return numbered(events_view(spark, d).select("id", "event_type"), "id", "event_type")


@query("o02_type_then_id", "WITH {EV} SELECT id, event_type, row_number() OVER (ORDER BY event_type, id) - 1 AS rn FROM ev")
def o02(spark, d):
    return numbered(events_view(spark, d).select("id", "event_type"), "event_type", "id")


@query("o03_numeric_id", "WITH {EV} SELECT id, row_number() OVER (ORDER BY id::BIGINT, pos) - 1 AS rn FROM ev")
def o03(spark, d):
    return numbered(events_view(spark, d).select("id", "pos"), F.col("id").cast("bigint"), "pos").select("id", "rn")


@query("o04_sort_in_row_group", "WITH {EV}, " + _RN + ", r AS (SELECT *, rn // 2048 AS g FROM o) SELECT pos, g::BIGINT AS row_group, (row_number() OVER (PARTITION BY g ORDER BY epoch_s, rn) - 1)::BIGINT AS place FROM r")
def o04(spark, d):
    w = Window.partitionBy("grp").orderBy("epoch_s", "rn")
    return stream(spark, d, "pos", "epoch_s").df.select("pos", F.col("grp").alias("row_group"), (F.row_number().over(w) - 1).cast("bigint").alias("place"))


@query("o05_gather", "WITH {EV}, " + _RN + ", r AS (SELECT *, rn // 2048 AS g FROM o) SELECT g::BIGINT AS row_group, (row_number() OVER (PARTITION BY g ORDER BY epoch_s, rn) - 1)::BIGINT AS place, id, repo_name FROM r")
def o05(spark, d):
    """One permutation applied to columns stored apart."""
    o = stream(spark, d, "epoch_s", "repo_name").df
    order = o.select("rn", "grp", (F.row_number().over(Window.partitionBy("grp").orderBy("epoch_s", "rn")) - 1).cast("bigint").alias("place"))
    return order.join(o.select("rn", "id"), "rn").join(o.select("rn", "repo_name"), "rn").select(F.col("grp").alias("row_group"), "place", "id", "repo_name")


@query("o06_sorted_dimension", "WITH {EV} SELECT repo_id, owner, suffix, row_number() OVER (ORDER BY repo_id, owner, suffix) - 1 AS idx FROM (SELECT DISTINCT repo_id, owner, suffix FROM ev)")
def o06(spark, d):
    return D.sorted_dictionary(events_view(spark, d), "repo_id", "owner", "suffix").select("repo_id", "owner", "suffix", "idx")


@query("o07_top_k", "WITH {EV} SELECT repo_name, count(*)::BIGINT AS cnt FROM ev GROUP BY repo_name ORDER BY cnt DESC, repo_name LIMIT 10")
def o07(spark, d):
    return events_view(spark, d).groupBy("repo_name").agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), "repo_name").limit(10)


@query("o08_take", "SELECT l_orderkey, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 3")
def o08(spark, d):
    return table(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(3).select("l_orderkey", "l_partkey")


@query("o09_input_order", "WITH {EV} SELECT pos, id FROM ev")
def o09(spark, d):
    """Sorted one way and back by the carried position."""
    o = numbered(events_view(spark, d).select("id", "event_type", "pos"), "id", "event_type")
    return numbered(o.select("pos", "id"), "pos").select("pos", "id")


