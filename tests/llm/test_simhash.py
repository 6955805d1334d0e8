import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from colonnade.llm import simhash as S


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, head int, fp string")


def words(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def test_votes_against_plain_counting(spark):
    rng = random.Random(1)
    texts = ["", "one", "a b c", "A  b\tc", words(rng, 5), words(rng, 6), words(rng, 300), "same " * 400, "é ß " * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("i", S.term_hashes(F.col("text")).alias("h"), S.fingerprint(F.col("text")).alias("fp")).collect():
        n = len(texts[r.i].split())
        assert len(r.h) == (max(1, n - 4) if n else 0)
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.h) > len(r.h))
        assert r.fp & ((1 << 64) - 1) == want
    fps = {r.i: r.fp for r in df.select("i", S.fingerprint(F.col("text")).alias("fp")).collect()}
    assert fps[2] == fps[3] and fps[0] == 0


def test_long_texts_count_in_chunks(spark):
    rng = random.Random(2)
    text = words(rng, 80_000)
    r = spark.createDataFrame([(text,)], "text string").select(S.term_hashes(F.col("text")).alias("h"), S.fingerprint(F.col("text")).alias("fp")).first()
    assert r.fp & ((1 << 64) - 1) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.h) > len(r.h))


def test_tables_find_all_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for f in base:
        for k in range(6):
            g = f
            for b in rng.sample(range(64), k):
                g ^= 1 << b
            fps.add(g)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for radius, blocks in ((3, 6), (2, 4), (0, 1), (3, 4)):
        want = sorted((signed(f), signed(g), (f ^ g).bit_count()) for f in fps for g in fps if (f ^ g).bit_count() <= radius)
        assert sorted(map(tuple, S.within(df, df, radius=radius, blocks=blocks).collect())) == want
    masks = S.tables(6, 3)
    assert len(masks) == 20 and all(m & ((1 << 64) - 1) for m in masks)
    assert len(list(combinations(range(6), 3))) == 20


@pytest.mark.parametrize("least_part", [S.LEAST_PART, 2])
def test_documents(spark, monkeypatch, least_part):
    monkeypatch.setattr(S, "LEAST_PART", least_part)  # 2: fingerprints of three documents are hot already
    rng = random.Random(4)
    rows = [(i * 7 - 50, words(rng, rng.choice((0, 1, 4, 40, 200)))) for i in range(80)] + [(1000, None), (1001, "é" * 10), (1002, words(rng, 100))]
    rows += [(2000 + i, rows[40][1]) for i in range(5)]
    long = words(rng, 1500)
    rows += [(3000 + i, long + f" tail{i % 3}") for i in range(6)]
    out = {r.doc_id: r for r in S.fingerprints(docs_of(spark, rows)).collect()}
    text = {i: t or "" for i, t in rows}
    order = sorted(text, reverse=True)
    assert set(out) == set(text)
    fp = {i: int(out[i].fingerprint, 16) for i in out}
    for k, i in enumerate(order):
        t, nxt = text[i], order[(k + 1) % len(order)]
        m = len(t) // 3
        edited = t[: len(t) - m] + text[nxt][:m]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1.0) == (fp[i] == fp[nxt])
        assert r.n_near == (sum((fp[i] ^ fp[j]).bit_count() <= 3 for j in text) - 1 if i % 20 == 0 else None)
        near = {j for j in text if (fp[i] ^ fp[j]).bit_count() <= 3 and fp[i] != fp[j]}
        assert r.class_id == min(j for j in text if fp[j] == fp[i])
        assert r.near_classes == (sorted({out[j].class_id for j in near}) if i % 20 == 0 else None)
    assert len({out[2000 + i].fingerprint for i in range(5)}) == 1
    long = [i for i in text if len(text[i]) > 600]
    assert sum(out[i].near_edited for i in long) / len(long) > 0.5 > 0.25 > sum(out[i].near_next for i in long if i < 1900) / len(long)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert S.fingerprints(spark.createDataFrame([], schema)).count() == 0
    (r,) = S.fingerprints(spark.createDataFrame([(5, "a b c d e f")], schema)).collect()
    assert r.near_next == 1.0  # the next of the only document is itself
    out = S.fingerprints(spark.createDataFrame([(None, "x y z"), (1, "p q"), (1, "p q")], schema)).collect()
    assert len(out) == 3 and [r.near_next for r in out if r.doc_id is None] == [None]
