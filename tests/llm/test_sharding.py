import random
from collections import Counter, defaultdict

from colonnade.llm import sharding as S


def test_tree_against_a_sorted_list():
    rng, tree, keys = random.Random(1), S.BinTree(), []
    for i in range(3000):
        if keys and rng.random() < 0.4:
            k = keys.pop(rng.randrange(len(keys)))
            tree.remove(k)
        else:
            k = (rng.randrange(500), i)
            keys.append(k)
            tree.add(k)
        need = rng.randrange(520)
        assert tree.tightest(need) == min((k for k in keys if k[0] >= need), default=None)
        assert tree.roomiest() == max(keys, default=None)
        if tree.root:
            assert tree.root.height <= 1.45 * (len(keys) + 2).bit_length()


def plain_fewest(sizes, capacity):
    """Bin of each of the sizes (descending), one by one: the tightest bin that fits, by (room, bin)."""
    room, out = [], []
    for s in sizes:
        fit = [(r, b) for b, r in enumerate(room) if r >= s]
        if fit:
            b = min(fit)[1]
        else:
            b = len(room)
            room.append(max(capacity, s))
        room[b] -= s
        out.append(b)
    return out


def plain_even(sizes, bins):
    """The same with a fixed number of bins of even capacity; what fits nowhere enters the roomiest."""
    out, left, free, at = [], sum(sizes), bins, 0
    while at < len(sizes) and free > 1 and sizes[at] * free > left:
        free -= 1
        left -= sizes[at]
        out.append(free)
        at += 1
    room = [-(-left // free)] * free
    for s in sizes[at:]:
        fit = [(r, b) for b, r in enumerate(room) if r >= s]
        b = min(fit)[1] if fit else max((r, b) for b, r in enumerate(room))[1]
        room[b] -= s
        out.append(b)
    return out


def one_by_one(runs, placed):
    assert [n for _, n in runs] == [sum(k for _, k in p) for p in placed]
    return [b for p in placed for b, k in p for _ in range(k)]


def runs_of(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def test_runs_are_placed_as_single_groups_would_be():
    rng = random.Random(2)
    for k in range(300):
        sizes = sorted((rng.choice((rng.randrange(1, 120), 7, 16, 100, rng.randrange(1, 9), 10 ** rng.randrange(1, 4))) for _ in range(rng.randrange(0, 250))), reverse=True)
        runs = runs_of(sizes)
        assert one_by_one(runs, S.fewest_bins(runs, 100)) == plain_fewest(sizes, 100)
        bins = rng.choice((1, 2, 7, 40))
        assert one_by_one(runs, S.even_bins(runs, bins)) == plain_even(sizes, bins)


def test_even_bins_are_even_and_large_runs_are_quick():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 1000) for _ in range(5000)]
    load = defaultdict(int)
    for (s, _), p in zip(runs_of(sizes), S.even_bins(runs_of(sizes), 40)):
        for b, k in p:
            load[b] += s * k
    assert len(load) == 40 and max(load.values()) - min(load.values()) <= 1000
    runs = [(s, 10**9 + s) for s in range(20_000, 0, -1)]
    load = defaultdict(int)
    for (s, _), p in zip(runs, S.even_bins(runs, 40)):
        for b, k in p:
            load[b] += s * k
    assert max(load.values()) - min(load.values()) <= 20_000


def test_shard_against_the_plain_version(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.choice((3, 5, 5, 5, 40, rng.randrange(200))))) for _ in range(400)]
    rows = [(i, texts[rng.randrange(len(texts))]) for i in range(1200)] + [(5000 + i, "hot") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = defaultdict(int)
    for _, t in rows:
        groups[t] += len(t.encode()) + 16
    order = sorted(groups, key=lambda t: -groups[t])
    sizes = [groups[t] for t in order]
    for options, plain in (({"shards": 8}, plain_even(sizes, 8)), ({"capacity": 3000}, plain_fewest(sizes, 3000))):
        out = S.shard(docs, **options).collect()
        of = {}
        for r in out:
            of.setdefault(dict(rows)[r.doc_id], r.shard)
            assert of[dict(rows)[r.doc_id]] == r.shard
        # groups of equal size may swap, their numbers in each shard not
        assert Counter((groups[t], b) for t, b in of.items()) == Counter(zip(sizes, plain))


def test_runs_split_over_shards_are_ranked_in_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 10)
    docs = spark.range(1000).selectExpr("id AS doc_id", "lpad(cast(id AS string), 8, '0') AS text")
    assert Counter(r.shard for r in S.shard(docs, shards=8).collect()) == Counter({b: 125 for b in range(8)})


def test_shards_of_a_table(spark):
    rows = [(i, f"text {i % 700} " * (1 + i % 50), "x", 1) for i in range(1500)] + [(5000 + i, "hot " * 9, "y", 2) for i in range(700)] + [(9000, None, "z", 3), (9001, "", "z", 3), (9001, "", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, bundle int")
    out = S.shard(docs, shards=8).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    where, slots, load = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in out:
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.law == "bytes" and r.grown_shard is None
        where[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(v) == 1 for v in where.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    groups = defaultdict(int)
    for r in rows:
        groups[r[1] or ""] += len((r[1] or "").encode()) + 16
    assert max(load.values()) - min(load.values()) <= max(groups.values())
    assert S.shard(docs.limit(0)).count() == 0
