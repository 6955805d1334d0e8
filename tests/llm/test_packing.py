import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import packing as P


def pool(lengths):
    return [P.Piece(n, i, 0, n, np.full(n, i, "<u4")) for i, n in enumerate(lengths)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=120))
def test_pools_keep_every_token_and_leave_small_gaps(lengths):
    done, rest = P.pack_pool(pool(lengths))
    for tier, w in done:
        assert tier in P.TIERS and w[0].length <= tier
        assert 1024 - 8 < sum(p.length for p in w) <= 1024 if tier == 1024 else sum(p.length for p in w) == tier
    assert sum(p.length for p in rest) <= 1024 - 8
    left = {}
    for p in [q for w in [*(w for _, w in done), rest] for q in w]:
        left.setdefault(p.doc_id, []).append((p.start, p.length))
        assert len(p.ids) == p.length
    assert sorted(left) == list(range(len(lengths)))
    for i, pieces in left.items():
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at == lengths[i]


def test_every_tier_has_windows_of_its_own_and_fills_gaps_of_longer_ones():
    done, rest = P.pack_pool(pool([900, 120, 700, 300, 300, 212, 200, 56, 100, 28, 128]))
    windows = {}
    for tier, w in done:
        windows.setdefault(tier, []).append(sorted(p.length for p in w))
    assert windows[1024] == [[120, 900], [300, 700]] or windows[1024][0] == [120, 900]
    assert set(windows) >= {1024, 512} and all(sum(w) == t for t, ws in windows.items() if t < 1024 for w in ws)
    short, rest = P.pack_pool(pool([100, 28, 60, 68] * 5))
    assert [t for t, _ in short] == [128] * 10 and rest == []


@pytest.mark.parametrize("lengths", [[], [1], [1000], [3, 5, 500, 7], [1016]])
def test_the_last_window_is_closed_with_powers_of_two(lengths):
    seqs = P.close_remainder(pool(lengths))
    totals = [sum(p.length for p in s) for s in seqs]
    assert sum(totals) == sum(lengths) and all(t & (t - 1) == 0 for t in totals) and len(set(totals)) == len(totals)


def test_step_groups_are_level():
    rng = random.Random(1)
    costs = [rng.randrange(1, 10**6) for _ in range(640)]
    g = P.step_groups(costs, 64)
    loads = [sum(c for c, k in zip(costs, g) if k == j) for j in range(10)]
    assert sorted(map(g.count, range(10))) == [64] * 10 and max(loads) < 1.02 * min(loads)
    assert P.step_groups([], 64) == []


def test_ids_are_those_of_the_reference_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc = P.encoder(*P.default_vocabulary())
    rng = random.Random(3)
    odd = ["", " ", "\n\n  x", "<|endoftext|>", "a" * 3000, "1234567890" * 30, "é́ß漢字 🙂‍🙂", "  x\u0085y᠎z", "don't  WON'T it's", "\x00\x01"]
    odd += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x3000, 0x30FF), 32, 10, 0x1F600))) for _ in range(80)) for _ in range(200)]
    for x in odd:
        assert enc.fast.encode_ordinary(x) == enc.ids(x) == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_pieces_of_a_table(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(("alpha", "beta", "gamma ray", "ünï")) for _ in range(rng.choice((0, 1, 5, 200, 3000)))) for i in range(60)}
    rows = [(i, t, 7) for i, t in texts.items()] + [(100, None, 7), (101, "", 7), (102, "twice", 7), (102, "twice", 7)]
    texts |= {100: "", 101: "", 102: "twice"}
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    out = P.pack(docs, pool_tokens=20_000).collect()
    enc = P.encoder(*P.default_vocabulary())
    per, seqs = {}, {}
    for r in out:
        per.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(per) == set(texts)
    for i, pieces in per.items():
        ids = np.array([*enc.ids(texts[i]), 0], "<u4")
        times = 2 if i == 102 else 1
        cover = np.zeros(len(ids), int)
        for r in pieces:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            cover[r.start : r.start + r.length] += 1
        assert (cover == times).all()
    padded = total = 0
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rs[0].sequence_length <= 1024 and rs[0].padded_length == (at if at & (at - 1) == 0 else 1024)
        padded, total = padded + rs[0].padded_length, total + at
        assert rs[0].padded_length == 1024 or rs[0].padded_length <= rs[0].tier
    assert {r.tier for r in out} >= {128, 1024}
    assert padded < 1.005 * total + 64
    assert P.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("run", [" " * 1_000_000, "\t" * 1_000_000, "x " + "\n" * 1_000_000 + "y", "\u3000" * 500_000, "a" * 1_000_000, "!" * 300_000])
def test_very_long_runs(run):
    enc = P.encoder(*P.default_vocabulary())
    assert enc.ids(run) == enc.exact.encode(run, add_special_tokens=False).ids


def test_a_million_spaces_in_a_table(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "\t" * 1_000_000), (3, "word")], "doc_id long, text string")
    totals = {r.doc_id: r.n for r in P.pack(docs).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    enc = P.encoder(*P.default_vocabulary())
    assert totals == {1: len(enc.ids(" " * 1_000_000)) + 1, 2: len(enc.ids("\t" * 1_000_000)) + 1, 3: 2}
