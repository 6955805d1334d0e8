"""Edge cases of operators and functions: empty tables, ties, row-group borders, odd names."""

import random

import pytest
from pyspark.sql import functions as F

from colonnade.codecs import events as C
from colonnade.functions import bits, names, times
from colonnade.operators import dictionaries as D
from colonnade.operators import ordered as R
from colonnade.operators import statistics as S
from colonnade.operators.late import split_late
from colonnade.operators.order import Ordered, numbered
from colonnade.sources.events import read_json_lines


def stream(spark, values, rows=7):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, v long").repartition(3)
    return Ordered.by(df, "pos", group_rows=rows)


@pytest.mark.parametrize("n", [0, 1, 6, 7, 8, 50])
def test_positions_lags_and_running_values_over_group_borders(spark, n):
    rng = random.Random(n)
    v = [rng.randrange(-20, 20) for _ in range(n)]
    o = stream(spark, v).lag("v", "p1", 1).lag("v", "p2", 2).running(F.col("v"), "s").running(F.col("v"), "m", "max", inclusive=False).running(F.when(F.col("v") > 10, F.col("v")), "l", "last")
    got = {r.rn: (r.v, r.p1, r.p2, r.s, r.m, r.l) for r in o.df.collect()}
    want = {}
    for i in range(n):
        big = [x for x in v[: i + 1] if x > 10]
        want[i] = (v[i], v[i - 1] if i else None, v[i - 2] if i > 1 else None, sum(v[: i + 1]), max(v[:i], default=None), big[-1] if big else None)
    assert got == want


@pytest.mark.parametrize("v", [[], [5], [1, 2, 3], [3, 1, 2, 9, 4, 4, 8, 10, 0, 11, 5, 5, 12, 3, 20, 1]])
def test_late_rows_and_bubbles(spark, v):
    o = split_late(stream(spark, v, 5), "v")
    got = {r.rn: (r.late, r.insert_position) for r in o.df.collect()}
    want, top, clean = {}, None, 0
    for i, x in enumerate(v):
        late = top is not None and x < top
        want[i] = (late, clean)
        clean += not late
        top = x if top is None else max(top, x)
    assert got == want
    bubbles = {r.rn: r.bubbles for r in R.bubble_counts(stream(spark, v, 5), "v").collect()}
    assert bubbles == {i: k for i, x in enumerate(v) if (k := sum(y > x for y in v[:i]))}


def test_zero_runs_and_runs(spark):
    d = [0, 0, 3, 0, 4, 5, 0, 0, 0]
    got = [(r.rn, r.zeros, r.d) for r in R.zero_runs(stream(spark, d, 4), "v").collect()]
    assert sorted(got, key=str) == sorted([(2, 2, 3), (4, 1, 4), (5, 0, 5), (None, 3, None)], key=str)
    assert sorted((r.run, r["value"], r.length) for r in R.runs(stream(spark, d, 4), "v").collect()) == [(1, 0, 2), (2, 3, 1), (3, 0, 1), (4, 4, 1), (5, 5, 1), (6, 0, 3)]


def test_inverses(spark):
    rng = random.Random(3)
    v = [rng.randrange(100) for _ in range(40)]
    o = R.lag_max_delta(stream(spark, v, 9), "v", "d").lag("v", "p1", 1).lag("v", "p2", 2)
    first = o.df.where("rn % 9 = 0").select("grp", "p1", "p2")
    back = {r.rn: r["value"] for r in R.lag_max_restore(o.df.select("grp", "rn", "d").join(first, "grp")).collect()}
    assert back == dict(enumerate(v))
    coded = R.move_to_front(stream(spark, [x % 8 for x in v], 9), "v", 8)
    assert {r.rn: r.symbol for r in R.move_from_front(coded, 8).collect()} == {i: x % 8 for i, x in enumerate(v)}
    words = ["", "a", "ab", "abc", "abd", "b", "é", "éa", "漢字", "漢"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert sorted(r["value"] for r in R.front_decoded(R.front_coded(df, "w", 3)).collect()) == sorted(words)


def test_case_folding_of_the_fixed_strings(spark):
    # Fixed strings of the source format's tests.
    strings = ["react", "React", "Redux", "TensorFlow", "OpenAI", "GitHub", "FastAPI", "GraphQL", "TypeScript", "JavaScript", "pytest", "rust-lang", "test-repo-123", "API", "CNN", "", "A", "aB", "ABc", "ABC-DEF"]
    df = spark.createDataFrame([(s,) for s in strings], "s string").withColumn("f", names.folded(F.col("s")))
    for r in df.withColumn("b", names.unfolded(F.col("f"))).collect():
        assert r.b == r.s and r.f == r.f.lower()
    folds = {r.s: r.f for r in df.collect()}
    assert folds["React"] == "^react" and folds["API"] == "$api" and folds["TensorFlow"] == "^tensor^flow" and folds["ABc"] == "^a^bc"


def test_names(spark):
    rows = [("a/b",), ("a",), ("a/b/c",), ("a/",), ("/b",), ("",), ("é/ß",)]
    n = F.col("n")
    a, b = names.split_name(n, "owner"), names.split_name(n, "rest")
    df = spark.createDataFrame(rows, "n string").select("n", *[c.alias(k) for k, c in zip("abcd", (*a, *b))], names.join_name(*a, missing="owner").alias("ra"), names.join_name(*b, missing="rest").alias("rb"))
    got = {r.n: tuple(r)[1:] for r in df.collect()}
    assert got["a/b/c"] == ("a", "b/c", "a", "b/c", "a/b/c", "a/b/c") and got["a"] == ("a", "", "", "a", "a", "a")
    assert got["a/"][4] == "a" and got["/b"][5] == "b"  # the known corners of either way
    pairs = [("o", "o"), ("o", "o-x"), ("o", "ox"), ("o", "x"), ("Willow", "willow.github.io"), ("p", "p.github.io"), ("p", "p"), ("", "x")]
    o, r = F.col("o"), F.col("r")
    df = spark.createDataFrame(pairs, "o string, r string")
    df = df.select("o", "r", names.rest_from(o, names.rest_code(o, r), names.rest_kept(o, r)).alias("b1"), names.owner_unmarked(o, names.owner_marked(o, r)).alias("b2"))
    assert all(x.b1 == x.r and x.b2 == x.r for x in df.collect())


def test_times_and_bits(spark):
    df = spark.createDataFrame([(0,), (1735689600,), (-1,), (951782399,)], "s long").withColumn("t", times.iso(F.col("s")))
    rows = df.select("s", "t", times.lenient_epoch(F.col("t")).alias("a"), times.strict_epoch(F.col("t")).alias("b")).collect()
    assert all(r.a == r.s == r.b for r in rows) and rows[1].t == "2025-01-01T00:00:00Z"
    assert spark.range(1).select(times.lenient_epoch(F.lit("soon")).alias("x")).first().x == 0
    values = [0, -1, 1, 2**62, -(2**62), 127, 128]
    for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", bits.unzigzag(bits.zigzag(F.col("v"))).alias("b")).collect():
        assert r.b == r.v
    with pytest.raises(Exception, match="zero has no slot"):
        spark.range(1).select(bits.signed_slot(F.col("id"), 4)).collect()


def test_dictionaries(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate("b a c a b d b".split())], "pos long, w string")
    assert {r.w: r.idx for r in D.sorted_dictionary(df, "w").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.w: r.idx for r in D.frequency_dictionary(df, "w").collect()} == {"b": 0, "a": 1, "c": 2, "d": 3}
    assert {r.w: r.idx for r in D.first_seen_dictionary(df, "w").collect()} == {"b": 0, "a": 1, "c": 2, "d": 3}
    with pytest.raises(Exception, match="not in the dictionary"):
        D.encode(df, D.sorted_dictionary(df.where("w <> 'd'"), "w"), "w").collect()
    assert numbered(df.limit(0), "w").count() == 0


def test_inversions_over_many_groups(spark):
    rng = random.Random(6)
    for v in ([rng.randrange(30) for _ in range(70)], list(range(60, 0, -1)), [k + 5 * (k % 7 == 0) for k in range(80)]):
        bubbles = {r.rn: r.bubbles for r in R.bubble_counts(stream(spark, v, 4), "v").collect()}
        assert bubbles == {i: k for i, x in enumerate(v) if (k := sum(y > x for y in v[:i]))}


def test_no_nested_loop_and_no_wide_single_window(spark, monkeypatch):
    from colonnade.operators import order

    plan = R.bubble_counts(stream(spark, [5, 3, 9, 1, 7, 2, 8], 2), "v")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    monkeypatch.setattr(order, "SPAN", 3)
    v = [(-1) ** k * k for k in range(90)]
    got = {r.rn: (r.s, r.m, r.l) for r in stream(spark, v, 4).running(F.col("v"), "s").running(F.col("v"), "m", "max").running(F.when(F.col("v") % 9 == 0, F.col("v")), "l", "last").df.collect()}
    assert got == {i: (sum(v[: i + 1]), max(v[: i + 1]), [x for x in v[: i + 1] if x % 9 == 0][-1]) for i in range(90)}


def test_ranges_and_alphabets_are_bounded(spark):
    df = spark.createDataFrame([(0,), (10**9,)], "sec long")
    with pytest.raises(Exception, match="histogram of more than"):
        S.dense_histogram(df, "sec").count()
    assert S.dense_histogram(df.limit(0), "sec").count() == 0
    counts = spark.createDataFrame([(i, 1 + i) for i in range(20)], "sym long, cnt long")
    for f in (S.normalise_max, S.normalise_remainders):
        with pytest.raises(Exception, match="more than 16 symbols"):
            f(counts, 16).collect()
        rows = f(counts, 20).collect()
        assert [r.freq for r in rows] == [1] * 20


def test_prefixes_are_of_bytes(spark):
    from colonnade.functions.names import prefix_bytes

    pairs = [("", ""), ("a", ""), ("abc", "abd"), ("é", "è"), ("漢字", "漢"), ("same", "same"), ("x" * 5000 + "y", "x" * 5000 + "z"), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", prefix_bytes(F.col("a"), F.col("b")).alias("n"))
    for r in df.collect():
        x, y = (r.a or "").encode(), (r.b or "").encode()
        assert r.n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_compared_tables(spark):
    from colonnade.plans.joins import compared

    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, None)], "rn long, v string")
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, None), (3, "w")], "rn long, v string")
    got = sorted((r.kind, r["at"], r.left_row, r.right_row) for r in compared(a, b, "rn").collect())
    assert got == [("differing", 2, None, None), ("example", 1, "y", "z"), ("example", 3, None, "w"), ("rows", 4, None, None)]


def test_normalisation_by_both_rules(spark):
    rng = random.Random(1)
    for scale in (16, 64):
        counts = spark.createDataFrame([(i, rng.choice((1, 1, 2, 50, 400))) for i in range(14)], "sym long, cnt long")
        for f in (S.normalise_max, S.normalise_remainders):
            rows = f(counts, scale).collect()
            assert sum(r.freq for r in rows) == scale and all(r.freq >= 1 for r in rows)


EVENTS = [("100", "PushEvent", 123, "test/repo", 1735689600, 0), ("110", "WatchEvent", 456, "other/repo", 1735693200, 1)]
EVENT_SCHEMA = "id string, event_type string, repo_id long, repo_name string, epoch_s long, pos long"


@pytest.mark.parametrize("name", sorted(C.CODECS))
def test_event_codecs_on_odd_tables(spark, name):
    rng = random.Random(7)
    many = [(str(rng.choice((9, 10, 2**40)) + i * rng.choice((1, 300))), rng.choice(("A", "B", "ünï")), rng.randrange(9), rng.choice(("o/n", "plain", "x/y/z", "é/漢")), 1_700_000_000 + rng.randrange(-900, 900), i) for i in range(120)]
    for rows in ([], EVENTS, many + many[:3]):
        df = spark.createDataFrame(rows, EVENT_SCHEMA)
        back = C.CODECS[name].decode(C.CODECS[name].encode(df))
        assert sorted(map(tuple, back.collect())) == sorted((*r[:5],) for r in rows)


def test_json_lines(spark, tmp_path):
    good = '{"id":"1","type":"PushEvent","repo":{"id":5,"name":"a/b","url":"u"},"created_at":"2025-01-01T00:00:00Z","more":[1]}'
    p = tmp_path / "x.json"
    p.write_text(good + "\n\n" + good.replace('"1"', '"2"') + "\n")
    assert [r.id for r in read_json_lines(spark, str(p)).orderBy("pos").collect()] == ["1", "2"]
    for bad in ('{"id":', good.replace('"id":5,', "")):
        p.write_text(good + "\n" + bad + "\n")
        with pytest.raises(Exception):
            read_json_lines(spark, str(p)).collect()


def test_scratch_tables_are_dropped(spark):
    from pathlib import Path

    from colonnade.session import drop_folders, scratch_folders, shared_table

    before = scratch_folders()
    kept, gone = shared_table(spark.range(5)), shared_table(spark.range(7))
    (first,) = [p for p in scratch_folders() - before if Path(p.removeprefix("file:")).exists() and spark.read.parquet(p).count() == 7]
    drop_folders({first})
    assert not Path(first.removeprefix("file:")).exists() and first not in scratch_folders()
    assert kept.count() == 5
    with pytest.raises(Exception):
        gone.collect()
