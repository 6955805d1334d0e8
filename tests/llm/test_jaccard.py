import random
import re

import numpy as np
import pytest

from colonnade.llm import jaccard as J
from colonnade.llm.components import components
from colonnade.llm.shingles import shingle_set, word_hashes


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_set(text, size=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def plain_components(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(s), root(i)) for i, s in sets)


def test_sets_have_the_right_sizes_and_equalities():
    texts = ["", None, " \t\n", "a", "A", "a b c d", "a b c d e", "a  b\nc\td e", "A B C D E F", "x y z x y z x y z", "é x É", "  a", "a b c", "b c a"]
    for t in texts:
        assert len(shingle_set(t)) == len(plain_set(t))
        for u in texts:
            assert (shingle_set(t).tolist() == shingle_set(u).tolist()) == (plain_set(t) == plain_set(u))
    rng = random.Random(0)
    pool = ["".join(rng.choice("abAB é") for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    seen = {}
    for w in pool:
        for x, h in zip(words(w), word_hashes(w).tolist(), strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice((1, 3, 5, 6, 9, 20, 60, 200)))]
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice((1, 1, 2, 5, 9))):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                w += [rng.choice(vocab)]
            rows.append((n, " ".join(w)))
            n += 1
    hot = [rng.choice(vocab) for _ in range(80)]
    for k in range(30):  # a chain whose ends are not linked
        rows.append((n, " ".join(hot[k : k + 50])))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (n + 5, " ".join(passage)), (n + 6, " ".join(passage) + " tail")]
    ids = [r[0] for r in rows]
    rng.shuffle(ids)
    return [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("seed,stars", [(1, 2), (2, 0), (3, 1)])
def test_components_against_all_pairs(spark, seed, stars):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, component string")
    got = sorted(tuple(r) for r in J.link(docs, star_rounds=stars).collect())
    assert got == plain_components(rows)


def test_an_adversarial_order_loses_no_link(spark):
    """Every shingle in the same counter and few distinct sizes: prefixes of one group coincide."""
    rng = random.Random(5)
    base = [f"v{rng.randrange(50)}" for _ in range(30)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(20, 30)] = f"z{i % 7}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in J.link(docs).collect()) == plain_components(rows)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.link(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, J.link(docs).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, None), (2, 0, 2)], key=str)


def test_components_of_a_long_path_and_a_star(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5000), (7, 3)]
    random.Random(1).shuffle(edges)
    got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7), finish_at=0).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001 + i: 1000 for i in range(200)}


@pytest.mark.parametrize("finish_at", [0, 10**6])
def test_components_by_either_way(spark, finish_at):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5), finish_at=finish_at).collect()}
    assert got == {x: root(x) for x in range(400) if root(x) != x}


def test_cells_meet_every_pair_once(spark):
    rows = [(7, i % 3, 10, 0, i, i, i) for i in range(50)] + [(8, -1, 10, 0, i, 1, 1) for i in range(9)] + [(9, -1, 10, 0, 3, 3, 3), (9, -1, 10, 0, 60, 4, 4)]
    docs = spark.createDataFrame(rows, "token long, salt long, n long, pos long, lead long, c1 long, c2 long")
    bitmaps = spark.createDataFrame([(i, bytearray(64)) for i in range(0, 61, 2)], "lead long, bitmap binary")
    cells = J.mixed_runs(docs, bitmaps, cell_rows=8)
    assert max(r["count"] for r in cells.groupBy("token", "lo", "hi").count().collect()) < 40
    got = sorted((r.a, r.b) for r in J.all_pairs(cells).collect())
    assert got == sorted({(a, b) for a in range(50) for b in range(a + 1, 50)} | {(3, 60)})


def test_hot_shingles_are_dealt_and_lose_nothing(spark, monkeypatch):
    """A passage in every document, and prefixes that hold it; chunks and cells of a few rows."""
    monkeypatch.setattr(J, "CHUNK_ROWS", 7)
    monkeypatch.setattr(J, "CELL_ROWS", 5)
    rng = random.Random(7)
    common = [f"c{k}" for k in range(12)]
    rows = []
    for i in range(70):
        w = list(common)
        w[rng.randrange(12)] = f"x{i % 9}"
        rows.append((i, " ".join(w + [f"y{rng.randrange(4)}"] * rng.randrange(3))))
    rows += [(100 + i, " ".join(common + [f"z{i % 5}"])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = spark.createDataFrame([(i, 10, [5, (1 << 62) + 7]) for i in range(30)], "lead long, n long, prefix array<long>")
    posts = J.postings(groups, 7).collect()
    assert len(posts) == 60 and {r.salt for r in posts if r.token == 5} == {-1} and len({r.salt for r in posts if r.token != 5}) > 2
    for stars in (0, 2):
        assert sorted(tuple(r) for r in J.link(docs, star_rounds=stars).collect()) == plain_components(rows)


def test_groups_of_several_members(spark):
    """Sets with equal prefixes and sizes, linked or not: what differs within a family is common elsewhere and so last in order."""
    rows = []
    for f in range(20):
        for v in range(8):
            long = v >= 4
            tail = [f"t{v}_{k}" for k in range(14 if long else 5)]
            rows.append((len(rows), " ".join([f"h{f}_{k}" for k in range(40)] + ["q1", "q2", "q3", "q4"] + tail)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in J.describe(docs, J.sketch(docs)).groupBy("n", "p").count().collect()]
    assert sorted(sizes) == [4] * 40
    want = plain_components(rows)
    assert len({c for _, _, c in want}) > 20
    for stars in (0, 1):
        assert sorted(tuple(r) for r in J.link(docs, star_rounds=stars).collect()) == want


def test_one_id_with_several_texts(spark):
    rows = [(5, "a b c d e f g h"), (5, "p q r s t u v w"), (3, "p q r s t u v w"), (9, "a b c d e f g h"), (9, "k l m n o"), (None, "k l m n o")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(False, 5, 4, 5), (False, 5, 4, 3), (False, 3, 4, 3), (False, 9, 4, 5), (False, 9, 1, 9), (True, 0, 1, 0)])


def test_blocks_of_long_texts_change_nothing(monkeypatch):
    from colonnade.llm import shingles

    rng = random.Random(2)
    texts = ["".join(rng.choice("abcAB é\n漢") for _ in range(n)) for n in (1, 7, 64, 500, 3000)] + ["x" * 500, " " * 300, "w " * 400, "ab " * 99 + "y" * 300]
    want = [(shingles.word_hashes(t).tolist(), shingles.shingle_set(t).tolist()) for t in texts]
    monkeypatch.setattr(shingles, "BLOCK", 64)
    assert [(shingles.word_hashes(t).tolist(), shingles.shingle_set(t).tolist()) for t in texts] == want
    assert [len(w) for w, _ in want] == [len(words(t)) for t in texts]


def test_prefix_lengths():
    for n in range(1, 200):
        k = J.prefix_length(n)
        assert 1 <= k <= n and n - k + 1 == -(-80 * n // 100)
    assert J.overlap_needed(np.array([9]), np.array([9])).tolist() == [8]
