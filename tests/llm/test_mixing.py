import random
import re

import pytest

from colonnade.llm import mixing as M
from tests.oracle import oracle_rows, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, budget, epochs):
    """Targets by clamping and resharing until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > epochs * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in free}
        for s in full:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        free -= full
    return target


def table(seed, hot=False):
    rng, rows = random.Random(seed), []
    for i in range(400):
        s = rng.choice(["a", "b", "c", "Z", "é", None, "a"]) if not hot or i % 3 else "hot"
        n = rng.choice((0, 1, 2, 50, 300))
        rows.append((i, s, rng.choice(("", " ")) + rng.choice((" ", "\n", "\t ")).join(f"w{k}é" for k in range(n)) if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True)])
def test_targets_and_takes(spark, seed, hot):
    rows = table(seed, hot)
    docs = spark.createDataFrame([(i, s, t, 5) for i, s, t in rows], "doc_id long, source string, text string, size int")
    out = M.mix(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, _, t in rows}
    source = {i: s for i, s, _ in rows}
    sizes = {}
    for i in size:
        sizes[source[i]] = sizes.get(source[i], 0) + size[i]
    want, taken = fill(sizes, M.WEIGHTS, M.BUDGET, M.MAX_EPOCHS), {}
    assert len(out) == len(rows)
    for r in out:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = {r.doc_id: r.taken for r in M.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_materialized_rows_hold_the_words_taken(spark):
    rows = table(3)
    docs = spark.createDataFrame([(i, s, t, len(t or ""), "en") for i, s, t in rows], "doc_id long, source string, text string, n_chars long, whole string")
    taken = {r.doc_id: r.taken for r in M.mix(docs).collect()}
    text = {i: t for i, _, t in rows}
    got = {}
    out = M.materialize(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert (text[r.doc_id] or "").startswith(r.text or "") and r.n_chars == len(r.text or "") and r.whole == "en"
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text or ""))
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in taken.items() if n}


def test_small_tables(spark, tmp_path):
    schema = "doc_id long, source string, text string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    out = M.mix(spark.createDataFrame([(1, None, None), (2, "a", "")], schema)).collect()
    assert [r.taken for r in out] == [0, 0]
    out = M.mix(spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (None, "b", "z")], schema)).collect()
    assert len(out) == 3 and sorted(r.taken for r in out) == [2, 2, 4]
    spark.createDataFrame(table(9), schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    import glob
    import os
    import shutil

    (part,) = glob.glob(f"{tmp_path}/documents.parquet/part*")
    os.makedirs(f"{tmp_path}/one")
    shutil.copy(part, f"{tmp_path}/one/documents.parquet")
    df = M.mix(spark.read.parquet(f"{tmp_path}/one/documents.parquet"))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == oracle_rows(M.ORACLE_SQL, f"{tmp_path}/one")
