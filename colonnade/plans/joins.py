"""Joins and set operations of the encoders: dictionary look-ups, splits, positional zips, merges, as-of and back-references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colonnade.operators import dictionaries as D
from colonnade.operators.late import split_late
from colonnade.operators.order import Ordered, numbered
from colonnade.plans.registry import query
from colonnade.session import table
from colonnade.sources.events import events_view

_TYPES = "td AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS idx FROM (SELECT DISTINCT event_type FROM ev))"
_REPOS = "rd AS (SELECT repo_id, repo_name, row_number() OVER (ORDER BY repo_id, repo_name) - 1 AS idx FROM (SELECT DISTINCT repo_id, repo_name FROM ev))"
_RN = "o AS (SELECT *, row_number() OVER (ORDER BY id, event_type) - 1 AS rn FROM ev)"


@query("j01_dictionary_encode", "WITH {EV}, " + _TYPES + " SELECT pos, idx::BIGINT AS idx FROM ev JOIN td USING (event_type)")
def j01(spark, d):
    e = events_view(spark, d)
    return D.encode(e, D.sorted_dictionary(e, "event_type"), "event_type").select("pos", "idx")


@query("j02_composite_lookup", "WITH {EV}, " + _REPOS + " SELECT pos, idx::BIGINT AS idx FROM ev JOIN rd USING (repo_id, repo_name)")
def j02(spark, d):
    e = events_view(spark, d)
    return D.encode(e, D.sorted_dictionary(e, "repo_id", "repo_name"), "repo_id", "repo_name").select("pos", "idx")


@query("j03_dictionary_decode", "WITH {EV} SELECT pos, repo_id, repo_name FROM ev")
def j03(spark, d):
    e = events_view(spark, d)
    dim = D.sorted_dictionary(e, "repo_id", "repo_name")
    coded = D.encode(e, dim, "repo_id", "repo_name").select("pos", "idx")
    return D.decode(coded, dim).select("pos", "repo_id", "repo_name")


@query("j04_variant_lookup", "WITH {EV}, v AS (SELECT repo_id, repo_name, row_number() OVER (PARTITION BY repo_id ORDER BY repo_name) - 1 AS variant FROM (SELECT DISTINCT repo_id, repo_name FROM ev)) SELECT pos, repo_id, variant::INT AS variant FROM ev JOIN v USING (repo_id, repo_name)")
def j04(spark, d):
    e = events_view(spark, d)
    return e.join(D.variants(e, "repo_id", "repo_name"), ["repo_id", "repo_name"]).select("pos", "repo_id", "variant")


@query("j05_exception_only_join", "WITH {EV}, n AS (SELECT suffix, count(DISTINCT repo_id) AS k FROM ev GROUP BY suffix), v AS (SELECT suffix, repo_id, row_number() OVER (PARTITION BY suffix ORDER BY repo_id) - 1 AS variant FROM (SELECT DISTINCT suffix, repo_id FROM ev)) SELECT pos, CASE WHEN k > 1 THEN variant END::INT AS variant FROM ev JOIN n USING (suffix) JOIN v USING (suffix, repo_id)")
def j05(spark, d):
    """Only names that stand for several ids carry a variant."""
    e = events_view(spark, d)
    v = D.variants(e, "suffix", "repo_id")
    many = v.groupBy("suffix").agg(F.count("*").alias("k")).where("k > 1").select("suffix")
    return e.join(v.join(many, "suffix"), ["suffix", "repo_id"], "left").select("pos", "variant")


@query("j06_top_k_split", "WITH {EV}, t AS (SELECT repo_name, row_number() OVER (ORDER BY count(*) DESC, repo_name) - 1 AS sym FROM ev GROUP BY repo_name QUALIFY sym < 64) SELECT pos, sym::BIGINT AS sym, sym IS NOT NULL AS in_head FROM ev LEFT JOIN t USING (repo_name)")
def j06(spark, d):
    e = events_view(spark, d)
    head, rest = D.split_by(e, D.top_k(e, "repo_name", 64), "repo_name")
    return head.select("pos", "sym", F.lit(True).alias("in_head")).unionByName(rest.select("pos", F.lit(None).cast("bigint").alias("sym"), F.lit(False).alias("in_head")))


@query("j07_positional_zip", "WITH {EV}, " + _RN + " SELECT rn::BIGINT AS rn, id, epoch_s::BIGINT AS epoch_s, repo_id FROM o")
def j07(spark, d):
    """Columns that were stored apart are joined by position."""
    o = numbered(events_view(spark, d), "id", "event_type")
    a, b, c = (o.select("rn", x) for x in ("id", "epoch_s", "repo_id"))
    return a.join(b, "rn").join(c, "rn")


@query("j08_interleave", "WITH {EV}, " + _RN + " SELECT rn::BIGINT AS rn, repo_id % 3 = 0 AS flag, repo_id AS value FROM o")
def j08(spark, d):
    """Two streams merged again by a flag: the k-th row of a flag takes the k-th value of its stream."""
    o = Ordered.by(events_view(spark, d), "id", "event_type").with_column("flag", F.col("repo_id") % 3 == 0)
    ranked = o.running(F.col("flag").cast("bigint"), "yes", inclusive=False).df.withColumn("k", F.when(F.col("flag"), F.col("yes")).otherwise(F.col("rn") - F.col("yes")))
    streams = ranked.select("flag", "k", F.col("repo_id").alias("value"))
    return ranked.select("rn", "flag", "k").join(streams, ["flag", "k"]).select("rn", "flag", "value")


_LATE = _RN + ", l AS (SELECT *, coalesce(epoch_s < max(epoch_s) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late FROM o), p AS (SELECT *, coalesce(sum(CASE WHEN late THEN 0 ELSE 1 END) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS insert_position FROM l)"


@query("j09_as_of", "WITH {EV}, " + _LATE + ", c AS (SELECT row_number() OVER (ORDER BY rn) AS n, epoch_s FROM p WHERE NOT late) SELECT p.pos, c.epoch_s::BIGINT AS reference_s FROM p LEFT JOIN c ON c.n = p.insert_position WHERE late")
def j09(spark, d):
    """The time of the last clean row before each late one."""
    o = split_late(Ordered.by(events_view(spark, d), "id", "event_type"))
    o = o.running(F.when(~F.col("late"), F.col("epoch_s")), "reference_s", "last", inclusive=False)
    return o.where("late").select("pos", "reference_s")


@query("j10_positional_insert", "WITH {EV}, " + _RN + " SELECT rn::BIGINT AS rn, pos FROM o")
def j10(spark, d):
    """Late rows go back before the clean row at their position: the original order."""
    o = split_late(Ordered.by(events_view(spark, d), "id", "event_type")).df
    late = o.where("late").select("insert_position", F.lit(0).alias("clean"), F.col("rn").alias("seq"), "pos")
    clean = o.where("NOT late").select("insert_position", F.lit(1).alias("clean"), F.col("insert_position").alias("seq"), "pos")
    return numbered(late.unionByName(clean), "insert_position", "clean", "seq").select("rn", "pos")


_LINES = "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS rn"


@query(
    "j11_compare_tables",
    f"WITH a AS (SELECT l_orderkey, l_partkey, {_LINES} FROM lineitem), x AS (SELECT rn, l_orderkey || ':' || l_partkey AS left_row, l_orderkey || ':-' || l_partkey AS right_row FROM a WHERE l_partkey % 100 = 7) "
    "SELECT 'rows' AS kind, (SELECT count(*) FROM a)::BIGINT AS at, NULL AS left_row, NULL AS right_row UNION ALL SELECT 'differing', count(*)::BIGINT, NULL, NULL FROM x UNION ALL (SELECT 'example', rn::BIGINT, left_row, right_row FROM x ORDER BY rn LIMIT 3)",
)
def j11(spark, d):
    """Two tables compared row by row at the same position: how many differ, and the first three that do."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    left = numbered(table(spark, d, "lineitem").select(*keys), *keys).select("rn", "l_orderkey", "l_partkey")
    right = left.withColumn("l_partkey", F.when(F.col("l_partkey") % 100 == 7, -F.col("l_partkey")).otherwise(F.col("l_partkey")))
    return compared(left, right, "rn")


def compared(left, right, at: str, examples: int = 3):
    """(kind, at, left_row, right_row): the number of rows, of differing ones, and the first of these by position; a row that one table lacks differs."""
    row = lambda df: F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns if c != at])
    both = left.select(at, row(left).alias("left_row")).join(right.select(at, row(right).alias("right_row")), at, "full")
    differing = both.where(~F.col("left_row").eqNullSafe(F.col("right_row")))
    none = F.lit(None).cast("string")
    total = lambda df, kind: df.agg(F.count("*").alias("at")).select(F.lit(kind).alias("kind"), "at", none.alias("left_row"), none.alias("right_row"))
    first = differing.orderBy(at).limit(examples).select(F.lit("example").alias("kind"), F.col(at).alias("at"), "left_row", "right_row")
    return total(both, "rows").unionByName(total(differing, "differing")).unionByName(first)


_BACK = _RN + ", fr AS (SELECT repo_name, min(rn) AS first_rn FROM o GROUP BY repo_name), fo AS (SELECT owner, min(rn) AS first_rn FROM o GROUP BY owner), ri AS (SELECT repo_name, first_rn, row_number() OVER (ORDER BY first_rn) - 1 AS i FROM fr), oi AS (SELECT owner, first_rn, row_number() OVER (ORDER BY first_rn) - 1 AS i FROM fo)"


@query("j12_back_reference", "WITH {EV}, " + _BACK + " SELECT o.pos, (CASE WHEN o.rn > ri.first_rn THEN 2 * ri.i + 2 WHEN o.rn > oi.first_rn THEN 2 * oi.i + 1 ELSE 0 END)::BIGINT AS ref FROM o JOIN ri USING (repo_name) JOIN oi USING (owner)")
def j12(spark, d):
    return back_references(events_view(spark, d)).select("pos", "ref")


def back_references(events):
    """0: new repository and owner; 2n+1: new repository of owner n; 2n+2: repository n again."""
    o = numbered(events, "id", "event_type")
    repos = D.first_seen_dictionary(o, "repo_name", at="rn").select("repo_name", F.col("idx").alias("repo_idx"), F.col("first_pos").alias("repo_first"))
    owners = D.first_seen_dictionary(o, "owner", at="rn").select("owner", F.col("idx").alias("owner_idx"), F.col("first_pos").alias("owner_first"))
    ref = F.when(F.col("rn") > F.col("repo_first"), 2 * F.col("repo_idx") + 2).when(F.col("rn") > F.col("owner_first"), 2 * F.col("owner_idx") + 1).otherwise(F.lit(0)).cast("bigint")
    return o.join(repos, "repo_name").join(owners, "owner").withColumn("ref", ref)


@query("w14_back_reference_stream", "WITH {EV}, " + _BACK + ", x AS (SELECT o.rn, CASE WHEN o.rn > ri.first_rn THEN 'repo again' WHEN o.rn > oi.first_rn THEN 'owner again' ELSE 'new' END AS kind FROM o JOIN ri USING (repo_name) JOIN oi USING (owner)) SELECT kind, count(*)::BIGINT AS n, min(rn)::BIGINT AS first_rn FROM x GROUP BY kind")
def w14(spark, d):
    kind = F.when(F.col("ref") == 0, "new").when(F.col("ref") % 2 == 1, "owner again").otherwise("repo again")
    return back_references(events_view(spark, d)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("rn").alias("first_rn"))


@query("u01_union_all", "SELECT 'orders' AS section, o_orderkey AS v FROM orders UNION ALL SELECT 'customer', c_custkey FROM customer UNION ALL SELECT 'part', p_partkey FROM part")
def u01(spark, d):
    part = lambda t, c: table(spark, d, t).select(F.lit(t).alias("section"), F.col(c).alias("v"))
    return part("orders", "o_orderkey").unionByName(part("customer", "c_custkey")).unionByName(part("part", "p_partkey"))


@query("u02_union_distinct", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer UNION SELECT p_name FROM part")
def u02(spark, d):
    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("name"))
    return one("nation", "n_name").union(one("region", "r_name")).union(one("customer", "c_mktsegment")).union(one("part", "p_name")).distinct()


@query("u03_disjoint_split", "SELECT l_quantity >= 45 AS in_head, count(*)::BIGINT AS n, (SELECT count(*) FROM lineitem)::BIGINT AS total FROM lineitem GROUP BY 1")
def u03(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity")
    head, rest = li.where("l_quantity >= 45"), li.where("NOT (l_quantity >= 45)")
    both = head.select(F.lit(True).alias("in_head")).unionByName(rest.select(F.lit(False).alias("in_head"))).groupBy("in_head").agg(F.count("*").alias("n"))
    return both.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
