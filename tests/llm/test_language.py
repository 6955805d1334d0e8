import random

import numpy as np
import pyarrow as pa
import pytest

from colonnade.llm import language as L

SYLLABLES = {"aa": "the ing and tion er on".split(), "bb": "qui eau oir lle des ou".split(), "cc": "sch ung ein der ich zu".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := "abc"[i % 3] * 2, rng.choice((1, 5, 60))), lang if i % 10 else None, "x") for i in range(900)]
    rows += [(2000, None, "aa", "x"), (2001, "", "aa", "x"), (2002, "123 ²½ !!", "bb", "x"), (2003, "日本語のテキスト", None, "x"), (2004, text(rng, "bb", 20_000), "bb", "x"), (2004, text(rng, "bb", 3), "bb", "x"), (None, text(rng, "cc", 30), "cc", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def crc(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_rows_are_told_right(docs):
    out = L.identify(docs).collect()
    truth = {r.doc_id: "abc"[r.doc_id % 3] * 2 for r in out if r.doc_id is not None and r.doc_id < 900}
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r.score <= 1 and (r.doc_id is None or r.held_out == crc(r.doc_id))
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in out if r.doc_id is not None and 2000 <= r.doc_id < 2004}
    assert [by[i].lang_pred for i in (2000, 2001, 2002)] == ["und"] * 3 and all(by[i].score == 0 and by[i].ambiguous for i in (2000, 2001, 2002))
    assert by[2003].lang_pred in SYLLABLES
    assert [r.lang_pred for r in out if r.doc_id is None] == ["cc"]


def test_results_do_not_depend_on_order_or_partitions(spark, docs):
    from pyspark.sql import functions as F

    runs = []
    for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(7), docs.repartition(23, "text")):
        runs.append(sorted(((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score, r.runner_up or "", r.ambiguous) for r in L.identify(d).collect())))
    assert runs[0] == runs[1] == runs[2]


def test_decoding_against_a_plain_version(docs):
    """Margins gram by gram, losses bit by bit, the nearest codeword of all."""
    import math

    model = L.fit(docs)
    for r in docs.where("doc_id < 60").collect():
        grams = L.buckets_of(r.text).tolist()
        margins = [sum(model.weights[g, b] for g in grams) / len(grams) for b in range(L.BITS)]
        loss = []
        for word in model.words:
            x = [math.sqrt(min(len(grams), 4096)) * m / s * (1 if one else -1) for m, s, one in zip(margins, model.scale, word)]
            loss.append(sum(t * math.log1p(math.exp(-v)) if v > -700 else -t * v for t, v in zip(model.trust, x)) / sum(model.trust) * 4)
        best = min(range(len(loss)), key=loss.__getitem__)
        lang, score, _, _ = L.judge(model, pa.array([r.text]))
        assert lang == [model.languages[best]]
        assert score[0] == pytest.approx(1 / sum(math.exp(loss[best] - v) for v in loss), rel=1e-9)


def test_repeated_rows_and_many_languages_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    rng = random.Random(4)
    rows = [(i, text(rng, lang := "abc"[i % 3] * 2, 30), lang) for i in range(90)] + [(0, text(rng, "aa", 40), "aa")] * 50 + [(3, text(rng, "bb", 40), "bb")] * 9
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]


def test_only_text_decides(docs):
    from pyspark.sql import functions as F

    model = L.fit(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs.where("doc_id < 900"), model).collect()}
    other = docs.where("doc_id < 900").withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 10_000)
    b = {r.doc_id - 10_000: (r.lang_pred, r.score) for r in L.predict(other, model).collect()}
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}


def test_filter_keeps_rows_and_columns(docs):
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows} >= set(range(900)) and not {2000, 2001, 2002} & {r.doc_id for r in rows}
    assert all(r.lang is not None for r in rows)


@pytest.mark.parametrize("langs", [("aa", "bb"), ("aa", "bb", "cc"), ("aa", "bb", "cc", "dd", "ee", "ff")])
def test_filter_rejects_what_cannot_be_told_at_any_number_of_languages(spark, monkeypatch, langs):
    for k, lang in enumerate(("dd", "ee", "ff")):
        monkeypatch.setitem(SYLLABLES, lang, [f"{a}{b}" for a in ("xk", "wp", "vb")[k] for b in ("ya", "uu", "om"[k % 2] + "y")])
    rng = random.Random(6)
    rows = [(i, text(rng, lang := langs[i % len(langs)], rng.choice((1, 5, 60, 400))), lang) for i in range(600)]
    odd = [(1000 + k, text(rng, "aa", n) + " " + text(rng, "bb", n), None) for k, n in enumerate((60, 200, 1000))]  # half and half
    odd += [(1010, "日本語のテキスト。" * 80, None), (1011, "Это предложение написано по-русски. " * 30, None), (1012, "jzgm qfjz mgqj zqfm " * 40, None)]
    kept = {r.doc_id for r in L.keep_identified(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert not kept & {r[0] for r in odd}
    assert len(kept) >= 0.99 * len(rows) and kept >= {r[0] for r in rows if len(r[1]) > 100}


def test_small_cases(spark):
    schema = "doc_id long, text string, lang string"
    assert L.identify(spark.createDataFrame([], schema)).count() == 0
    (r,) = L.identify(spark.createDataFrame([(1, "hello", None)], schema)).collect()
    assert r.lang_pred == "und"
    out = L.identify(spark.createDataFrame([(i, "hello there", "en") for i in range(9)], schema)).collect()
    assert {(x.lang_pred, round(x.score, 6)) for x in out} == {("en", 1.0)}


def test_codewords_are_apart():
    for n in (2, 4, 60, 200):
        w = L.codewords(n)
        d = (w[:, None] != w[None]).sum(2) + 99 * np.eye(n, dtype=int)
        assert d.min() >= (8 if n <= 60 else 4) and w.any(0).all() and not w.all(0).any()


def test_letters():
    assert not L.has_letter("²³ 12 _ ́") and L.has_letter("1 é") and L.has_letter("一")
