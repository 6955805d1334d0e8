"""Projections, filters and scalar functions over the event view and other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.codecs.events import STATIC_TYPES
from colonnade.functions import bits, names, times
from colonnade.operators.order import Ordered
from colonnade.plans.registry import query
from colonnade.session import table
from colonnade.sources.events import derived_url, events_view, key_value, ntz_epoch_seconds

ISO_SQL = "strftime(make_timestamp(epoch_s * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


@query("p01_flatten", "WITH {EV} SELECT id AS key_id, event_type AS key_type, repo_id, repo_name, 'https://api.github.com/repos/' || repo_name AS repo_url, " + ISO_SQL + " AS created_at FROM ev")
def p01(spark, d):
    kv = key_value(events_view(spark, d))
    return kv.select(F.col("key.id").alias("key_id"), F.col("key.event_type").alias("key_type"), F.col("value.repo.id").alias("repo_id"), F.col("value.repo.name").alias("repo_name"), F.col("value.repo.url").alias("repo_url"), F.col("value.created_at").alias("created_at"))


@query(
    "p02_timestamp_to_epoch",
    "WITH {EV}, t AS (SELECT pos, CASE WHEN pos % 7 = 3 THEN 'not a time' ELSE " + ISO_SQL + " END AS txt, epoch_s FROM ev) SELECT pos, CASE WHEN pos % 7 = 3 THEN 0 ELSE epoch_s END::BIGINT AS lenient, epoch_s::BIGINT AS strict FROM t",
)
def p02(spark, d):
    e = events_view(spark, d)
    text = times.iso(F.col("epoch_s"))
    return e.select("pos", times.lenient_epoch(F.when(F.col("pos") % 7 == 3, F.lit("not a time")).otherwise(text)).alias("lenient"), times.strict_epoch(text).alias("strict"))


@query("p02b_ntz_to_epoch", "SELECT event_id, (epoch_us(ts) // 1000000)::BIGINT AS epoch_s FROM events")
def p02b(spark, d):
    return table(spark, d, "events").select("event_id", ntz_epoch_seconds("ts").alias("epoch_s"))


@query("p03_epoch_to_iso", "WITH {EV} SELECT pos, " + ISO_SQL + " AS created_at FROM ev")
def p03(spark, d):
    return events_view(spark, d).select("pos", times.iso(F.col("epoch_s")).alias("created_at"))


@query("p04_id_to_integer", "WITH {EV}, t AS (SELECT pos, CASE WHEN pos % 5 = 0 THEN 'x' || id ELSE id END AS id FROM ev) SELECT pos, coalesce(TRY_CAST(id AS BIGINT), 0)::BIGINT AS n FROM t")
def p04(spark, d):
    e = events_view(spark, d).select("pos", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"))
    return e.select("pos", F.coalesce(F.expr("try_cast(id AS BIGINT)"), F.lit(0)).alias("n"))


@query("p05_integer_to_id", "SELECT event_id, CAST(event_id AS VARCHAR) AS id FROM events")
def p05(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("id"))


_URLS = "urls AS (SELECT page_id, replace(replace(url, 'https://', ''), 'http://', '') AS name FROM pages)"


def _page_names(spark, d):
    return table(spark, d, "pages").select("page_id", F.replace(F.replace("url", F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")).alias("name"))


@query(
    "p06_split_owner",
    f"WITH {_URLS} SELECT page_id, CASE WHEN instr(name, '/') > 0 THEN substr(name, 1, instr(name, '/') - 1) ELSE name END AS owner_a, CASE WHEN instr(name, '/') > 0 THEN substr(name, instr(name, '/') + 1) ELSE '' END AS rest_a, "
    "CASE WHEN instr(name, '/') > 0 THEN substr(name, 1, instr(name, '/') - 1) ELSE '' END AS owner_b, CASE WHEN instr(name, '/') > 0 THEN substr(name, instr(name, '/') + 1) ELSE name END AS rest_b FROM urls",
)
def p06(spark, d):
    n = F.col("name")
    a, b = names.split_name(n, "owner"), names.split_name(n, "rest")
    return _page_names(spark, d).select("page_id", a[0].alias("owner_a"), a[1].alias("rest_a"), b[0].alias("owner_b"), b[1].alias("rest_b"))


@query(
    "p07_join_owner",
    f"WITH {_URLS}, e AS (SELECT page_id * 10 + k AS row, CASE k WHEN 0 THEN name WHEN 1 THEN name || '/' WHEN 2 THEN '/' || name WHEN 3 THEN '/' ELSE '' END AS name FROM urls, (SELECT unnest(range(5)) AS k)) "
    "SELECT row, CASE WHEN instr(name, '/') > 0 AND instr(name, '/') = length(name) THEN left(name, -1) ELSE name END AS kept_owner, CASE WHEN starts_with(name, '/') THEN substr(name, 2) ELSE name END AS kept_rest, CASE WHEN instr(name, '/') > 0 THEN name ELSE name || '/' END AS plain FROM e",
)
def p07(spark, d):
    """Every name as it is, with a slash behind or before it, a slash alone and nothing: a slash at either end is lost by one of the two ways."""
    n = F.col("name")
    odd = F.array(n, F.concat(n, F.lit("/")), F.concat(F.lit("/"), n), F.lit("/"), F.lit(""))
    p = _page_names(spark, d).select("page_id", F.posexplode(odd).alias("k", "name")).select((F.col("page_id") * 10 + F.col("k")).alias("row"), "name")
    a, b = names.split_name(n, "owner"), names.split_name(n, "rest")
    return p.select("row", names.join_name(*a, missing="owner").alias("kept_owner"), names.join_name(*b, missing="rest").alias("kept_rest"), names.join_name(*a).alias("plain"))


@query("p08_derived_url", "WITH {EV} SELECT pos, CASE WHEN repo_id % 10 = 3 THEN 'https://example.org/' || repo_name END AS kept, CASE WHEN repo_id % 10 = 3 THEN 'https://example.org/' || repo_name ELSE 'https://api.github.com/repos/' || repo_name END AS url FROM ev")
def p08(spark, d):
    """A url that can be derived from the name is dropped and made again; any other is kept."""
    given = F.when(F.col("repo_id") % 10 == 3, F.concat(F.lit("https://example.org/"), "repo_name")).otherwise(derived_url("repo_name"))
    e = events_view(spark, d).select("pos", "repo_name", given.alias("given"))
    stored = e.select("pos", "repo_name", F.when(F.col("given") != derived_url("repo_name"), F.col("given")).alias("kept"))
    return stored.select("pos", "kept", F.coalesce("kept", derived_url("repo_name")).alias("url"))


@query("p09_blank_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*)::BIGINT AS n_lines, sum(length(line))::BIGINT AS n_chars FROM l WHERE line <> '' GROUP BY doc_id")
def p09(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("p10_name_filter", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%re%' OR lower(p_name) LIKE '%naive%'")
def p10(spark, d):
    low = F.lower("p_name")
    return table(spark, d, "part").where(F.contains(low, F.lit("re")) | F.contains(low, F.lit("naive"))).select("p_partkey", "p_name")


@query("p11_enum_map", "WITH {EV}, m(name, code) AS (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(STATIC_TYPES)) + "), t AS (SELECT name, code FROM m) SELECT pos, t.code::INT AS code, t.name AS decoded FROM ev JOIN t ON t.code = pos % 16")
def p11(spark, d):
    """Static names to codes and back through a literal map; an unknown name raises."""
    to_code = F.create_map(*[F.lit(x) for i, t in enumerate(STATIC_TYPES) for x in (t, i)])
    back = F.array(*map(F.lit, STATIC_TYPES))
    name = F.element_at(back, (F.col("pos") % 16 + 1).cast("int"))
    code = F.coalesce(to_code[name], F.raise_error(F.lit("unknown event type")).cast("int"))
    return events_view(spark, d).select("pos", code.alias("code")).select("pos", "code", F.element_at(back, F.col("code") + 1).alias("decoded"))


_DELTA = "g AS (SELECT pos, epoch_s - coalesce(lag(epoch_s) OVER (ORDER BY id, event_type), 0) AS d FROM ev)"


def _string_order(spark, d):
    return Ordered.by(events_view(spark, d).select("id", "event_type", "pos", "epoch_s"), "id", "event_type")


@query("p12_exception_split", "WITH {EV}, " + _DELTA + " SELECT pos, (CASE WHEN d IN (0, 1, 2) THEN d ELSE 3 END)::BIGINT AS category, CASE WHEN d NOT IN (0, 1, 2) THEN d END::BIGINT AS exception FROM g")
def p12(spark, d):
    o = _string_order(spark, d).delta("epoch_s", "d").df
    inline = F.col("d").isin(0, 1, 2)
    return o.select("pos", F.when(inline, F.col("d")).otherwise(F.lit(3)).cast("bigint").alias("category"), F.when(~inline, F.col("d")).alias("exception"))


@query("p13_frame_of_reference", "WITH {EV}, r AS (SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 1024 AS g FROM ev) SELECT pos, g::BIGINT AS row_group, (epoch_s - min(epoch_s) OVER (PARTITION BY g))::BIGINT AS ts_offset, (repo_id - min(repo_id) OVER (PARTITION BY g))::BIGINT AS repo_offset FROM r")
def p13(spark, d):
    from pyspark.sql import Window

    o = Ordered.by(events_view(spark, d), "pos", group_rows=1024).df
    w = Window.partitionBy("grp")
    return o.select("pos", F.col("grp").alias("row_group"), (F.col("epoch_s") - F.min("epoch_s").over(w)).alias("ts_offset"), (F.col("repo_id") - F.min("repo_id").over(w)).alias("repo_offset"))


@query("p14_narrowing_cast", "SELECT event_id, CAST(event_id % 30000 AS SMALLINT) AS small, TRY_CAST(event_id AS TINYINT) AS tiny FROM events")
def p14(spark, d):
    """Values out of range raise under ANSI, or are null with try_cast: never cut silently."""
    return table(spark, d, "events").select("event_id", (F.col("event_id") % 30000).cast("smallint").alias("small"), F.expr("try_cast(event_id AS TINYINT)").alias("tiny"))


_ZZ = "(CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END)"


@query(
    "p15_type_and_delta_byte",
    "WITH {EV}, " + _DELTA.replace("SELECT pos,", "SELECT pos, event_type,") + ", t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM ev)) SELECT pos, (code * 16 + " + _ZZ + " % 16)::BIGINT AS low, (" + _ZZ + " // 16)::BIGINT AS high FROM g JOIN t USING (event_type)",
)
def p15(spark, d):
    from colonnade.operators.dictionaries import encode, sorted_dictionary

    e = events_view(spark, d)
    o = Ordered.by(encode(e, sorted_dictionary(e, "event_type"), "event_type"), "id", "event_type").delta("epoch_s", "d").df
    z = bits.zigzag(F.col("d"))
    return o.select("pos", F.shiftleft("idx", 4).bitwiseOR(z.bitwiseAND(F.lit(15))).alias("low"), F.shiftright(z, 4).alias("high"))


@query("f01_zigzag", "WITH {EV}, " + _DELTA + " SELECT pos, " + _ZZ + "::BIGINT AS zz, d::BIGINT AS back FROM g")
def f01(spark, d):
    o = _string_order(spark, d).delta("epoch_s", "d").df.select("pos", bits.zigzag(F.col("d")).alias("zz"))
    return o.select("pos", "zz", bits.unzigzag(F.col("zz")).alias("back"))


@query("f02_signed_slot", "WITH {EV}, " + _DELTA + " SELECT pos, (CASE WHEN s >= 2000 THEN 2000 ELSE s END)::BIGINT AS slot FROM (SELECT pos, CASE WHEN d > 0 THEN 2 * (d - 1) ELSE 2 * (-d - 1) + 1 END AS s FROM g WHERE d <> 0)")
def f02(spark, d):
    o = _string_order(spark, d).delta("epoch_s", "d").where("d <> 0")
    return o.select("pos", bits.signed_slot(F.col("d"), 1000).alias("slot"))


_VL = lambda e: f"greatest(1, (length(bin({e})) + 6) // 7)"


@query("f03_signal_bytes", "WITH {EV}, " + _DELTA + " SELECT pos, (CASE WHEN d <= 0 THEN 1 + " + _VL("-d") + " ELSE " + _VL("d") + " END)::BIGINT AS bytes FROM (SELECT pos, d::BIGINT AS d FROM g)")
def f03(spark, d):
    return _string_order(spark, d).delta("epoch_s", "d").df.select("pos", bits.signal_bytes(F.col("d")).alias("bytes"))


@query("f04_bit_width", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, length(bin(l_partkey)))::INT AS width FROM lineitem")
def f04(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", bits.bit_width(F.col("l_partkey")).alias("width"))


@query("f05_varint_length", "SELECT l_orderkey, l_linenumber, l_partkey, " + _VL("l_partkey * l_orderkey") + "::BIGINT AS varint, (CASE WHEN length(bin(l_partkey * l_orderkey)) > 56 THEN 9 ELSE " + _VL("l_partkey * l_orderkey") + " END)::BIGINT AS prefix_varint FROM lineitem")
def f05(spark, d):
    v = F.col("l_partkey") * F.col("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", bits.varint_length(v).alias("varint"), bits.prefix_varint_length(v).alias("prefix_varint"))


@query("f06_byte_planes", "SELECT o_orderkey, (o_orderkey & 255)::BIGINT AS p0, (o_orderkey >> 8 & 255)::BIGINT AS p1, (o_orderkey >> 16 & 255)::BIGINT AS p2, (o_orderkey >> 24 & 255)::BIGINT AS p3 FROM orders")
def f06(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *[bits.byte_plane(F.col("o_orderkey"), k).alias(f"p{k}") for k in range(4)])


@query("f07_nibble_pack", "WITH {EV}, r AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS rn, repo_id % 16 AS code FROM ev) SELECT rn // 2 AS byte_pos, (sum(CASE WHEN rn % 2 = 0 THEN code ELSE code * 16 END))::BIGINT AS byte FROM r GROUP BY 1")
def f07(spark, d):
    o = Ordered.by(events_view(spark, d), "pos").df.select("rn", (F.col("repo_id") % 16).alias("code"))
    low, high = F.max(F.when(F.col("rn") % 2 == 0, F.col("code"))), F.max(F.when(F.col("rn") % 2 == 1, F.col("code")))
    return o.groupBy(F.floor(F.col("rn") / 2).alias("byte_pos")).agg(low.bitwiseOR(F.shiftleft(F.coalesce(high, F.lit(0)), 4)).alias("byte"))


@query("f08_word_split", "SELECT o_orderkey, (v >> 32)::BIGINT AS high, (v & 4294967295)::BIGINT AS low, v AS back FROM (SELECT o_orderkey, o_orderkey * 4294967311 AS v FROM orders)")
def f08(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * F.lit(4294967311)).alias("v"))
    parts = o.select("o_orderkey", bits.high_word(F.col("v")).alias("high"), bits.low_word(F.col("v")).alias("low"))
    return parts.withColumn("back", F.shiftleft("high", 32).bitwiseOR(F.col("low")))


@query(
    "f09_two_bit_category",
    "WITH {EV}, " + _DELTA + " SELECT pos, (CASE WHEN d = 0 THEN 0 WHEN d = 1 THEN 1 WHEN d BETWEEN 2 AND 127 THEN 2 ELSE 3 END) AS wide, (CASE WHEN d IN (0, 1, 2) THEN d ELSE 3 END)::INT AS narrow, (CASE " + _ZZ + " WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END) AS ids FROM g",
)
def f09(spark, d):
    o, v = _string_order(spark, d).delta("epoch_s", "d").df, F.col("d")
    z = bits.zigzag(v)
    wide = F.when(v == 0, 0).when(v == 1, 1).when(v.between(2, 127), 2).otherwise(3)
    return o.select("pos", wide.alias("wide"), F.when(v.isin(0, 1, 2), v).otherwise(3).cast("int").alias("narrow"), F.when(z == 0, 0).when(z == 2, 1).when(z == 4, 2).otherwise(3).alias("ids"))


_WORDS = "wd AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS s FROM documents), nm AS (SELECT s, lag(s) OVER (ORDER BY encode(s)) AS q FROM wd)"


@query("f10_common_prefix", "WITH " + _WORDS + " SELECT s, (CASE WHEN q IS NULL THEN 0 ELSE coalesce((SELECT min(i) FROM (SELECT unnest(range(1, least(strlen(s), strlen(q)) + 1)) AS i) WHERE substr(hex(encode(s)), 2 * i - 1, 2) <> substr(hex(encode(q)), 2 * i - 1, 2)) - 1, least(strlen(s), strlen(q))) END)::INT AS shared FROM nm")
def f10(spark, d):
    """Bytes that each word of the documents, in four languages, shares with the one before it in order."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("s")).distinct()
    o = Ordered.by(words, "s").lag("s", "q").df
    return o.select("s", names.prefix_bytes(F.col("s"), F.col("q")).alias("shared"))


_PAIRS = "pr AS (SELECT DISTINCT owner, CASE repo_id % 4 WHEN 0 THEN owner WHEN 1 THEN owner || '-' || suffix WHEN 2 THEN 'x' || owner || suffix ELSE owner || suffix END AS rest FROM ev)"


def _pairs(spark, d):
    m = F.col("repo_id") % 4
    rest = F.when(m == 0, F.col("owner")).when(m == 1, F.concat("owner", F.lit("-"), "suffix")).when(m == 2, F.concat(F.lit("x"), "owner", "suffix")).otherwise(F.concat("owner", "suffix"))
    return events_view(spark, d).select("owner", rest.alias("rest")).distinct()


@query("f11_suffix_code", "WITH {EV}, " + _PAIRS + " SELECT owner, rest, c AS code, CASE c WHEN 1 THEN '' WHEN 2 THEN substr(rest, length(owner) + 1) ELSE rest END AS kept, rest AS back FROM (SELECT *, CASE WHEN rest = owner THEN 1 WHEN starts_with(rest, owner) AND substr(rest, length(owner) + 1, 1) IN ('-', '_', '.') THEN 2 ELSE 0 END AS c FROM pr)")
def f11(spark, d):
    o, r = F.col("owner"), F.col("rest")
    coded = _pairs(spark, d).select("owner", "rest", names.rest_code(o, r).alias("code"), names.rest_kept(o, r).alias("kept"))
    return coded.withColumn("back", names.rest_from(o, F.col("code"), F.col("kept")))


@query("f12_owner_marks", "WITH {EV}, " + _PAIRS + " SELECT owner, rest, CASE m WHEN '@' THEN '' WHEN '@.github.io' THEN '@' ELSE m END AS marked, rest AS back FROM (SELECT *, replace(rest, owner, '@') AS m FROM pr)")
def f12(spark, d):
    marked = _pairs(spark, d).withColumn("marked", names.owner_marked(F.col("owner"), F.col("rest")))
    return marked.withColumn("back", names.owner_unmarked(F.col("owner"), F.col("marked")))


@query(
    "f13_case_folding",
    "WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[^A-Za-z]+')) AS s FROM documents UNION SELECT DISTINCT upper(unnest(string_split_regex(text, '[^A-Za-z]+'))) FROM documents), "
    "t AS (SELECT s, regexp_extract(s, '[A-Z]{2,}$') AS tail FROM w WHERE s <> '') SELECT s, lower(regexp_replace(left(s, length(s) - length(tail)), '([A-Z])', '^\\1', 'g')) || CASE WHEN tail <> '' THEN '$' || lower(tail) ELSE '' END AS folded, s AS back FROM t",
)
def f13(spark, d):
    """Words as they stand and in capitals, folded and back again."""
    w = table(spark, d, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("s"))
    w = w.union(w.select(F.upper("s"))).where("s <> ''").distinct().select("s", names.folded(F.col("s")).alias("folded"))
    return w.select("s", "folded", names.unfolded(F.col("folded")).alias("back"))


@query("f14_join_and_split", "WITH t AS (SELECT event_type AS v, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events)), j AS (SELECT string_agg(v, chr(10) ORDER BY i) AS joined, count(*) AS n FROM t) SELECT i::BIGINT AS i, v, joined, n::BIGINT AS n FROM t, j")
def f14(spark, d):
    values = events_view(spark, d).select("event_type").distinct()
    joined = values.agg(F.expr("listagg(event_type, '\n') WITHIN GROUP (ORDER BY event_type)").alias("joined"), F.count("*").alias("n"))
    return joined.select(F.posexplode(F.split("joined", "\n")).alias("i", "v"), "joined", "n").select(F.col("i").cast("bigint").alias("i"), "v", "joined", "n")


_VARINT_SQL = "lower(CASE WHEN n < 128 THEN lpad(hex(n), 2, '0') WHEN n < 16384 THEN lpad(hex(n % 128 + 128), 2, '0') || lpad(hex(n // 128), 2, '0') ELSE lpad(hex(n % 128 + 128), 2, '0') || lpad(hex(n // 128 % 128 + 128), 2, '0') || lpad(hex(n // 16384), 2, '0') END)"


@query("f15_length_prefix", f"SELECT doc_id, n::INT AS n_bytes, {_VARINT_SQL} AS prefix, md5({_VARINT_SQL} || lower(hex(encode(t)))) AS framed FROM (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents)")
def f15(spark, d):
    """Every text behind its length in bytes as a varint; the frames as digests of their hexadecimal form."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", t.alias("t"), F.octet_length(t).alias("n_bytes")).withColumn("prefix", bits.varint_hex(F.col("n_bytes")))
    return rows.select("doc_id", "n_bytes", "prefix", F.md5(F.concat("prefix", F.lower(F.hex(F.encode("t", "UTF-8"))))).alias("framed"))


@query("f16_sentinel_list", "WITH {EV}, n AS (SELECT repo_name, row_number() OVER (ORDER BY repo_name) - 1 AS i FROM (SELECT DISTINCT repo_name FROM ev)), v AS (SELECT repo_id, list_sort(list(DISTINCT i)) AS vs FROM ev JOIN n USING (repo_name) GROUP BY repo_id) SELECT repo_id, CASE WHEN len(vs) = 1 THEN (vs[1] + 1)::VARCHAR ELSE '0,' || len(vs) || ',' || array_to_string(vs, ',') END AS coded FROM v")
def f16(spark, d):
    from colonnade.operators.dictionaries import encode, sorted_dictionary

    e = events_view(spark, d)
    sets = encode(e, sorted_dictionary(e, "repo_name"), "repo_name").groupBy("repo_id").agg(F.sort_array(F.collect_set("idx")).alias("vs"))
    coded = F.when(F.size("vs") == 1, F.array(F.get("vs", F.lit(0)) + 1)).otherwise(F.concat(F.array(F.lit(0).cast("bigint"), F.size("vs").cast("bigint")), "vs"))
    return sets.select("repo_id", F.array_join(coded.cast("array<string>"), ",").alias("coded"))


@query("f17_thousands", "SELECT o_orderkey, format('{:,}', o_orderkey * 12345) AS shown FROM orders")
def f17(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_number(F.col("o_orderkey") * 12345, 0).alias("shown"))


@query("f18_improvement", "SELECT o_orderkey, CASE WHEN n = 1000000 THEN 'baseline' ELSE (CASE WHEN n > 1000000 THEN '+' ELSE '-' END) || t // 10 || '.' || t % 10 || '%' END AS shown FROM (SELECT o_orderkey, n, (2000 * abs(n - 1000000) + 1000000) // 2000000 AS t FROM (SELECT o_orderkey, o_orderkey * 37 AS n FROM orders))")
def f18(spark, d):
    from colonnade.plans.storage import improvement

    return table(spark, d, "orders").select("o_orderkey", improvement(F.col("o_orderkey") * 37, F.lit(1000000)).alias("shown"))


@query("f19_math", "SELECT l_orderkey, l_linenumber, l_quantity, log2(l_quantity) AS lg, ceil(l_tax * 100)::BIGINT AS up, least(l_partkey, l_suppkey) AS low, abs(l_suppkey - l_partkey) AS gap FROM lineitem")
def f19(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.log2("l_quantity").alias("lg"), F.ceil(F.col("l_tax") * 100).alias("up"), F.least("l_partkey", "l_suppkey").alias("low"), F.abs(F.col("l_suppkey") - F.col("l_partkey")).alias("gap"))


@query("f20_checked_arithmetic", "SELECT event_id, event_id + 1 AS plain, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id + 1 END AS checked FROM events")
def f20(spark, d):
    """Overflow raises in plain arithmetic; try_ forms give null where a row may overflow."""
    big = F.when(F.col("event_id") % 2 == 0, F.lit(9223372036854775807)).otherwise(F.col("event_id"))
    return table(spark, d, "events").select("event_id", (F.col("event_id") + 1).alias("plain"), F.try_add(big, F.lit(1)).alias("checked"))


@query(
    "f21_utf8",
    "SELECT doc_id, CASE WHEN text IS NOT NULL THEN doc_id % 3 = 2 END AS valid, text || CASE WHEN doc_id % 3 < 2 THEN chr(65533) ELSE '' END AS lossy FROM documents",
)
def f21(spark, d):
    """Bytes that end in one that is never valid, in half a character, or well: checked, and read with a replacement character for what is broken."""
    tail = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))
    raw = F.concat(F.encode("text", "UTF-8"), tail).cast("string")
    return table(spark, d, "documents").select("doc_id", F.is_valid_utf8(raw).alias("valid"), F.make_valid_utf8(raw).alias("lossy"))
