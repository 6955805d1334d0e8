"""The pipeline against a brute-force version of its stages on a small fixture."""

import hashlib
import random
import re
import zlib

import numpy as np

import corpus_pipeline
from colonnade.llm import language, mixing, packing, pii
from colonnade.llm.stages import one_of_each_group
from tests.llm.test_jaccard import plain_components
from tests.llm.test_mixing import WORD, fill

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(11)
    langs = {"en": "the ing and tion er on".split(), "fr": "qui eau oir lle des ou".split()}
    rows = []
    for i in range(150):
        lang = rng.choice(("en", "fr"))
        words = ["".join(rng.choice(langs[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice((1, 4, 30, 120)))]
        if rng.random() < 0.3:
            words.insert(len(words) // 2, rng.choice(("bob@mail.example.com", "10.20.30.40", "+1 (555) 123-4567", "4111111111111111")))
        rows.append((i, " ".join(words), lang if rng.random() < 0.9 else None, rng.choice(("a", "b", "c", None))))
    rows += [(200 + k, rows[k][1], rows[k][2], "b") for k in range(20)]  # copies
    for k in range(20):  # near copies
        w = rows[k + 30][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((300 + k, " ".join(w), rows[k + 30][2], "c"))
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (402, "12 34 !!", "fr", "b"), (403, "12 34 !!", None, "b")]
    return [(i, t, l, s, len(t or "")) for i, t, l, s in rows]


def brute(rows):
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    leads = {i for i, _, c in plain_components([(r[0], r[1]) for r in kept]) if i == c}
    judge = pii.judge()
    kept = [(r[0], pii.redacted(r[1], judge.choose(r[1])[1]), r[3]) for r in kept if r[0] in leads]
    size = {i: len(WORD.findall(t)) for i, t, _ in kept}
    sources = {}
    for i, _, s in kept:
        sources[s] = sources.get(s, 0) + size[i]
    target = fill(sources, mixing.WEIGHTS, mixing.BUDGET, mixing.MAX_EPOCHS)
    out = []
    for s in sources:
        whole = int(target[s] // sources[s]) if sources[s] else 0
        left = round(target[s]) - whole * sources[s]
        for i, t, _ in sorted((r for r in kept if r[2] == s), key=lambda r: (hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest(), r[0])):
            part = min(size[i], max(0, left))
            left -= size[i]
            out += [(i, t)] * whole
            if part == size[i] and part:
                out.append((i, t))
            elif part:
                out.append((i, "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)[:part])))
    return out


def test_against_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    enc, want = packing.encoder(*packing.default_vocabulary()), {}
    for i, t in brute(rows):
        ids = np.array([*enc.ids(t), 0], "<u4")
        want.setdefault((i, len(ids)), []).append(ids)
    assert set(got) == set(want)
    for k, pieces in got.items():
        copies = want[k]
        cover = np.zeros(k[1], int)
        for start, length, crc in pieces:
            assert any(zlib.crc32(ids[start : start + length].tobytes()) == crc for ids in copies)
            cover[start : start + length] += 1
        assert (cover == len(copies)).all()


def test_stages_keep_columns_and_survive_odd_tables(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here to read and see", "en", "a", 31), (3, "x y z w v u", "en", None, 11), (3, "x y z w v u", "en", None, 11)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, DOCS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_one_row_of_each_group(spark):
    rows = [(5, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (9, "q", "en", "s", 1), (9, "q", "en", "s", 1), (11, None, "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (13, "own words of this row here", "en", "s", 1), (13, "a b c d e f", "en", "s", 1)]
    out = one_of_each_group(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == [(False, 5, "a b c d e f"), (False, 9, "q"), (False, 11, ""), (False, 13, "own words of this row here"), (True, 0, "a b c d e f")]


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.createDataFrame(fixture(), DOCS)
    kept = {r.doc_id for r in language.keep_identified(docs).collect()}
    assert kept == {r[0] for r in fixture()} - {400, 401, 402, 403}
