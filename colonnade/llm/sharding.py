"""Sharding by best-fit-decreasing bin packing of indivisible groups (rows with equal text).

Groups sorted by size enter the bin with the tightest remaining capacity that still holds them, found in a balanced
(AVL) tree over (remaining capacity, bin). With a fixed number of bins the capacity is the even share; what fits nowhere any more
enters the bin with the most room. A group above the even share takes a bin of its own, and the share of the rest is
reckoned anew: groups are never split, so equal texts share a shard. With a ``capacity`` the shards are as few as the method
finds: one is opened when no other holds a group, and a larger group has a shard of its own.

Groups of equal size are alike to the method, so it runs over (size, number of groups) and places whole runs: the tightest bin that holds
one takes as many as it can, just as it would one by one. The result is that of the method over single groups, at any scale.

Scale: only the table of distinct group sizes is collected. As its sizes sum to no more than the total, it has at most sqrt(2 x total) rows
(14 million at 100 TB, if every size occurred). Rows travel as ids, sizes and digests, written once, never as text. A size whose groups all go
to one shard needs no more than a look-up; where a run is split over shards, its groups are ranked by digest within cells of at most CELL_ROWS
groups, a table of cell counts giving each cell its start. Groups of at least 1/256 of a shard (at most 256 x shards, since their sizes sum
to the total; hence broadcast) are looked up before the join on the digest, so no key of that join is hot. Slots are numbered
within (shard, cell), a cell being one of 1024 by hash of the row, so neither a shard nor a group of copies lands in one task.

Defined results: a null text counts as empty (size 16, in the group of empty texts); repeated rows are numbered one by one;
an empty table gives an empty result; other columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.session import shared_table

SHARDS = 40
LARGE_PARTS = 256
CELL_ROWS = 1 << 16
CELLS = 1024
OVERHEAD = 16


class _Node:
    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key):
        self.key, self.left, self.right, self.height = key, None, None, 1


class BinTree:
    """A balanced search tree of (remaining capacity, bin)."""

    def __init__(self, keys: Iterable[tuple[int, int]] = ()):
        self.root = None
        for k in keys:
            self.add(k)

    def add(self, key) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def tightest(self, need: int):
        """The least key whose capacity is at least need, or None."""
        node, best = self.root, None
        while node:
            if node.key[0] >= need:
                node, best = node.left, node.key
            else:
                node = node.right
        return best

    def roomiest(self):
        node = self.root
        while node and node.right:
            node = node.right
        return node and node.key

    @staticmethod
    def _height(n) -> int:
        return n.height if n else 0

    def _balanced(self, n):
        n.height = 1 + max(self._height(n.left), self._height(n.right))
        lean = self._height(n.left) - self._height(n.right)
        if lean > 1:
            if self._height(n.left.left) < self._height(n.left.right):
                n.left = self._raise(n.left, "right", "left")
            return self._raise(n, "left", "right")
        if lean < -1:
            if self._height(n.right.right) < self._height(n.right.left):
                n.right = self._raise(n.right, "left", "right")
            return self._raise(n, "right", "left")
        return n

    def _raise(self, n, side: str, other: str):
        """Rotates the child on side above n."""
        top = getattr(n, side)
        setattr(n, side, getattr(top, other))
        setattr(top, other, n)
        for x in (n, top):
            x.height = 1 + max(self._height(x.left), self._height(x.right))
        return top

    def _add(self, n, key):
        if n is None:
            return _Node(key)
        if key < n.key:
            n.left = self._add(n.left, key)
        else:
            n.right = self._add(n.right, key)
        return self._balanced(n)

    def _remove(self, n, key):
        if n is None:
            raise KeyError(key)
        if key < n.key:
            n.left = self._remove(n.left, key)
        elif key > n.key:
            n.right = self._remove(n.right, key)
        elif n.left is None or n.right is None:
            return n.left or n.right
        else:
            least = n.right
            while least.left:
                least = least.left
            n.key = least.key
            n.right = self._remove(n.right, least.key)
        return self._balanced(n)


Run = tuple[int, int]
"""Size of a group, and number of groups of that size."""


def _place(size: int, count: int, tree: BinTree, otherwise) -> list[tuple[int, int]]:
    """(bin, number) for a run of equal groups: best fit as long as a bin holds one, then otherwise(), which names a key and how many it takes."""
    out: list[tuple[int, int]] = []
    while count:
        key = tree.tightest(size)
        if key:
            tree.remove(key)
            n = min(count, key[0] // size) if size else count
        else:
            key, n = otherwise(size)
            n = min(count, n)
        tree.add((key[0] - n * size, key[1]))
        count -= n
        if out and out[-1][0] == key[1]:
            out[-1] = (key[1], out[-1][1] + n)
        else:
            out.append((key[1], n))
    return out


def even_bins(runs: list[Run], bins: int) -> list[list[tuple[int, int]]]:
    """For each run of distinct sizes in descending order, how many of its groups go to which bins: best fit decreasing into a fixed number of bins."""
    out: list[list[tuple[int, int]]] = [[] for _ in runs]
    left, free, rest = sum(s * n for s, n in runs), bins, [n for _, n in runs]
    for i, (size, _) in enumerate(runs):
        while rest[i] and free > 1 and size * free > left:  # above the even share: a bin of its own
            free -= 1
            left -= size
            rest[i] -= 1
            out[i].append((free, 1))
        if rest[i]:
            break
    tree = BinTree((-(-left // free), b) for b in range(free))

    def roomiest(size: int):
        key = tree.roomiest()
        tree.remove(key)
        return key, 1

    for i, (size, _) in enumerate(runs):
        out[i] += _place(size, rest[i], tree, roomiest)
    return out


def fewest_bins(runs: list[Run], capacity: int) -> list[list[tuple[int, int]]]:
    """The same with a fixed capacity and as many bins as it takes; a larger group has a bin of its own."""
    tree, bins = BinTree(), 0

    def new(size: int):
        nonlocal bins
        bins += 1
        return (max(capacity, size), bins - 1), max(1, capacity // size) if size else 1

    return [_place(size, count, tree, new) for size, count in runs]


def shard(docs: DataFrame, *, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): near-equal bytes, equal texts together, slots gapless in each shard.

    With a capacity (in bytes) as many shards as it takes, else ``shards`` of them.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = shared_table(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text).alias("g"),
        )
    )
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"))
    found = groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.col("bytes").desc()).collect()  # bounded, see above
    runs = [(r["bytes"], r["n"]) for r in found]
    placed = even_bins(runs, shards) if capacity is None else fewest_bins(runs, capacity)
    whole = [(size, p[0][0], n) for (size, n), p in zip(runs, placed, strict=True) if len(p) == 1]
    split = []
    for (size, n), parts in zip(runs, placed, strict=True):
        if len(parts) > 1:
            ends = [sum(k for _, k in parts[: i + 1]) for i in range(len(parts))]
            split.append((size, -(-n // CELL_ROWS), ends, [b for b, _ in parts]))
    of_whole = groups.join(spark.createDataFrame(whole, "bytes long, shard int, n long").drop("n"), "bytes").select("g", "bytes", "shard")
    cut = groups.join(spark.createDataFrame(split, "bytes long, cells long, ends array<long>, bins array<int>"), "bytes").withColumn("cell", F.pmod(F.xxhash64("g"), F.col("cells")))
    counts = cut.groupBy("bytes", "cell").count()
    earlier = Window.partitionBy("bytes").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bytes", "cell", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.withColumn("k", F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("g"))).join(bases, ["bytes", "cell"])
    part = F.size(F.filter("ends", lambda e: e < F.col("base") + F.col("k")))
    of_split = ranked.select("g", "bytes", F.get("bins", part).alias("shard"))
    of_group = shared_table(of_whole.unionByName(of_split))
    # at most LARGE_PARTS x shards rows, as their sizes sum to the total
    least = max(1, -(-sum(s * n for s, n in runs) // (LARGE_PARTS * shards)))
    large = F.broadcast(of_group.where(F.col("bytes") >= least).select("g", F.col("shard").alias("large_shard")))
    looked = rows.join(large, "g", "left")
    small = looked.where("large_shard IS NULL").drop("large_shard").join(of_group.where(F.col("bytes") < least).select("g", "shard"), "g")
    known = looked.where("large_shard IS NOT NULL").withColumnRenamed("large_shard", "shard").unionByName(small)
    dealt = known.withColumn("cell", F.pmod(F.xxhash64("doc_id", "g"), F.lit(CELLS)).cast("int"))
    counts = dealt.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "g")
    return (
        dealt.withColumn("n", F.row_number().over(within) - 1)
        .join(starts, ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("n")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
