"""Exact Jaccard self-join on word shingles by a grouped prefix join, and its connected components.

Two sets x, y are linked when |x & y| >= t * |x | y|. Under any total order of the shingles, linked sets share one of their first
|x| - ceil(t |x|) + 1 shingles. The order puts rare shingles first (a sketch of counters over all documents, an upper bound of
each count, then the hash), so that passages many documents share seldom reach a prefix. Stages:

1. describe: one row per document with its set size, set digest, prefix and a parity bitmap. Documents with equal sets are
   one class; classes with identical prefixes and size are one group.
2. post the prefix of each group under its shingles; runs of one group alone are dropped.
3. Star rounds: within each run, sorted by size, every group is paired with one of the 64 before it, which one depending on the
   run and the round. Pairs that sizes, positions or bitmaps rule out go; each document keeps the partner whose bitmap is nearest. These are
   verified on whole sets, and linked documents merge. A round is linear in the postings however large a run is.
4. A complete round over groups: the pairs of groups within a run are filtered by size and position, by the components that their members
   are in by now, and by the bitmaps where both groups are single classes. The pairs that remain are expanded to their members, which bitmaps
   and components filter once more, and verified on whole sets; so are the members of a group among themselves. So no link between
   different components is lost, while large groups of near copies, merged by then, are never expanded into their pairs.

Scale: texts are read once for the sketch, once for the descriptions and once a round; before they are shuffled to be verified, a Bloom filter
of FILTER_PER_ID bits for each id that takes part (2^27 bits at most) lets only those through. Postings are the largest shuffle, a fifth of the
shingles in size. A shingle with more than ``chunk`` postings is dealt over as many chunks as it needs, in the postings, the star rounds and the
complete round alike; chunk is CHUNK_ROWS, or more where there would be over MAX_HOT such shingles, so their table may be broadcast. In
the complete round a run of several components meets in cells of at most two buckets of CELL_ROWS rows; runs within one component take no part.
Only the blocks of the sketch and of the filters (8 to 32 MB and 16 MB at most) reach the driver. Lineage is cut with tables and
checkpoints in the shared folder of spark.checkpoint.dir.

Defined results: null texts and texts without words have n_shingles 0 and are linked with nothing; repeated rows of one doc_id give
repeated rows of one component; rows of one doc_id with different texts are linked each by its own text, and a component is named by
the least doc_id among its rows; rows with a null doc_id get size and a null component; an empty table gives an empty result; other columns
do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.batches import bounded_batches
from colonnade.llm.components import components
from colonnade.llm.shingles import mix, shingle_set
from colonnade.session import shared_table

SKETCH_BITS = (20, 22)
SKETCH_BLOCKS = 64
BITMAP_BITS = (512, 2048, 8192)
FILTER_BITS = (20, 27)
FILTER_PER_ID = 16
RING = 64
CELL_ROWS = 4096
CHUNK_ROWS = 65_536
MAX_HOT = 100_000
RANK_SHIFT, RANK_STEPS = 47, 1024
SIZE = 5
THRESHOLD = (80, 100)
STAR_ROUNDS = 2

DESCRIBED = "doc_id long, n long, d1 long, d2 long, p long, prefix array<long>, bitmap binary"


def overlap_needed(n, m, threshold=THRESHOLD):
    """Least |x & y| of linked sets with n and m elements: num (n + m) / (num + den), rounded up."""
    num, den = threshold
    return -(-(num * (n + m)) // (num + den))


def prefix_length(n: int, threshold=THRESHOLD) -> int:
    num, den = threshold
    return n - -(-(num * n) // den) + 1


def bits_for(n: int, bounds: tuple[int, int]) -> int:
    """The bits that number n things, within bounds."""
    return min(max(n.bit_length(), bounds[0]), bounds[1])


def sketch(docs: DataFrame, bits: int | None = None, size: int = SIZE) -> np.ndarray:
    """Counters of documents per shingle, by the upper bits of its hash; every document counts. By default one counter or more a document, within SKETCH_BITS."""
    bits = bits or bits_for(docs.count(), SKETCH_BITS)
    per = (1 << bits) // SKETCH_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros(1 << bits, "u4"), False
        held: list[np.ndarray] = []
        waiting = 0
        for b in batches:
            for text in b.column(0):
                held.append(shingle_set(text.as_py(), size))
                waiting += len(held[-1])
                if waiting > 1 << 20:
                    table += np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).astype("i8"), minlength=1 << bits).astype("u4")
                    held, waiting, seen = [], 0, True
        if waiting:
            table += np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).astype("i8"), minlength=1 << bits).astype("u4")
            seen = True
        if seen:
            parts = table.reshape(SKETCH_BLOCKS, per)
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, "u4").astype("i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, "block int, counts binary").repartition(SKETCH_BLOCKS, "block").mapInArrow(add, "block int, counts binary")
    out = np.zeros(1 << bits, "i8")
    for r in parts.collect():
        out[r["block"] * per : (r["block"] + 1) * per] = np.frombuffer(r["counts"], "i8")
    return np.minimum(np.ceil(np.log2(out + 1) * RANK_STEPS), 65535).astype("u2")  # monotone, in 16 bits


def in_order(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set's shingles as numbers that sort rare first; equal shingles have equal numbers."""
    bits = len(rank).bit_length() - 1
    return (rank[(s >> np.uint64(64 - bits)).astype("i8")].astype("u8") << np.uint64(RANK_SHIFT)) | (s & np.uint64((1 << RANK_SHIFT) - 1))


def parity(s: np.ndarray) -> bytes:
    """For each value of the low bits, whether the set has an odd number of such shingles; longer for larger sets."""
    bits = next((b for b in BITMAP_BITS if len(s) <= b), BITMAP_BITS[-1])
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype("i8"), minlength=bits).astype("u1") & 1).tobytes()


def bits_apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Differing bits of each pair of bitmaps, the longer one folded to the shorter: at most the size of the symmetric difference."""
    out = np.zeros(len(x), "i8")
    lengths = np.array([[len(v) for v in x], [len(v) for v in y]], "i8").reshape(2, -1)
    for a, b in np.unique(lengths, axis=1).T.tolist():
        rows = np.flatnonzero((lengths[0] == a) & (lengths[1] == b))
        least = min(a, b)
        p, q = (np.bitwise_xor.reduce(np.frombuffer(b"".join([v[i] for i in rows]), "u1").reshape(len(rows), -1, least), axis=1) for v in (x, y))
        out[rows] = np.bitwise_count(p ^ q).sum(1, dtype="i8")
    return out


def describe(docs: DataFrame, rank: np.ndarray, threshold=THRESHOLD, size: int = SIZE) -> DataFrame:
    fields = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n", "d1", "d2", "p")], ("prefix", pa.list_(pa.int64())), ("bitmap", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, len(ids), 512):
                rows = []
                for text in texts.slice(at, 512):
                    s = shingle_set(text.as_py(), size)
                    if not len(s):
                        rows.append((0, 0, 0, 0, s.astype("i8"), None))
                        continue
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "i8")
                    o = in_order(s, rank)
                    k = prefix_length(len(s), threshold)
                    pre = np.sort(np.partition(o, k - 1)[:k]).astype("i8")
                    p = np.frombuffer(hashlib.blake2b(pre.tobytes(), digest_size=8).digest(), "i8")
                    rows.append((len(s), d[0], d[1], p[0], pre, parity(s)))
                cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *[len(r[4]) for r in rows]]).astype("i4"), np.concatenate([r[4] for r in rows]))
                yield pa.RecordBatch.from_arrays([ids.slice(at, 512), *cols, lists, pa.array([r[5] for r in rows], pa.binary())], schema=fields)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DESCRIBED)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Blocks of columns that begin and end with a run of equal values in the first three columns (sorted by them)."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))
        end = int(new[-1]) + 1 if len(new) else 0
        if end:
            yield [c[:end] for c in cols]
        held = [c[end:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def postings(groups: DataFrame, chunk: int) -> DataFrame:
    """(token, salt, n, pos, lead) of groups (lead, n, prefix), where at least two groups share the token.

    The rows of a token with more than ``chunk`` of them are dealt over salts from 0 on; all others have the salt -1. There are at most
    (all rows / chunk) such tokens. A token's upper bits bound its count, so few tokens are counted to find them.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None  # last token, and its first row if that is not yet out
        for b in batches:
            t = b.column(0).to_numpy()
            if not len(t):
                continue
            same = np.concatenate(([t[0] == last], t[1:] == t[:-1]))  # equal to the row before
            keep = same.copy()
            keep[:-1] |= same[1:]
            keep |= b.column(1).to_numpy() >= 0
            if same[0] and first is not None:
                yield first
            first = None if keep[-1] else b.slice(len(t) - 1, 1)
            last = t[-1]
            if keep.any():
                yield b.filter(pa.array(keep))

    rows = groups.select("lead", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "n", F.col("pos").cast("long").alias("pos"), "lead")
    bound = F.pow(F.lit(2.0), F.shiftrightunsigned("token", RANK_SHIFT) / RANK_STEPS)
    hot = rows.where(bound > chunk).groupBy("token").count().where(F.col("count") > chunk).select("token", F.ceil(F.col("count") / chunk).alias("chunks"))
    salt = F.coalesce(F.pmod(F.xxhash64("lead"), F.col("chunks")), F.lit(-1).cast("long"))
    rows = rows.join(F.broadcast(hot), "token", "left").select("token", salt.alias("salt"), "n", "pos", "lead")
    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "lead").mapInArrow(shared, "token long, salt long, n long, pos long, lead long")


def chunk_rows(described: DataFrame) -> int:
    """How many postings of a token one task takes: at most MAX_HOT tokens have more."""
    total = described.agg(F.sum(F.size("prefix"))).first()[0] or 0
    return max(CHUNK_ROWS, -(-total // MAX_HOT))


def star_pairs(posts: DataFrame, turn: int, threshold=THRESHOLD) -> DataFrame:
    """(a, b): each row of a run with one of the RING rows before it, if component, size and position allow."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, chunk, ring = None, None, []
        for b in batches:
            tokens, ns, ps, leads, comps, salts = (c.to_numpy(zero_copy_only=False).tolist() for c in b.columns)
            x, y = [], []
            for t, n, p, lead, comp, salt in zip(tokens, ns, ps, leads, comps, salts, strict=True):
                if t != token or salt != chunk:
                    token, chunk, ring, draw = t, salt, [], (t ^ (t >> 17)) * 0x9E3779B1 + turn * 0x85EBCA6B
                else:
                    m, q, other, their = ring[(draw >> 7) % len(ring)]
                    if comp != their and m * den >= num * n and 1 + min(n - p - 1, m - q - 1) >= overlap_needed(n, m, threshold):
                        x.append(min(other, lead))
                        y.append(max(other, lead))
                ring.append((n, p, lead, comp))
                if len(ring) > RING:
                    ring.pop(0)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return posts.mapInArrow(run, "a long, b long").distinct()


def mixed_runs(rows: DataFrame, bitmaps: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows (token, salt, n, pos, lead, c1, c2) of the runs that hold several components, with the bitmaps there are (lead, bitmap), dealt into cells of bounded size.

    c1 and c2 are the least and largest component of a row. A run of more than cell_rows rows is dealt into buckets, and each pair of
    buckets is a cell (lo, hi), so every pair of rows meets in one cell and no task needs a whole run.
    """
    parts = rows.groupBy("token", "salt").agg(F.min("c1").alias("p1"), F.max("c2").alias("p2"), F.count("*").alias("k"))
    runs = parts.groupBy("token").agg(F.min("p1").alias("r1"), F.max("p2").alias("r2"), F.sum("k").alias("k")).where("r1 <> r2").select("token", F.ceil(F.col("k") / cell_rows).alias("m"))
    mixed = parts.select("token", "salt").join(runs, "token")  # one row for each part of a run: the join below has no hot key
    kept = rows.join(mixed, ["token", "salt"]).withColumn("bucket", F.pmod(F.xxhash64("lead"), F.col("m")))
    cells = kept.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    cells = cells.select("token", F.least("bucket", "other").alias("lo"), F.greatest("bucket", "other").alias("hi"), "n", "pos", "lead", "c1", "c2", "bucket")
    return cells.join(bitmaps, "lead", "left").select("token", "lo", "hi", "n", "pos", "lead", "c1", "c2", "bucket", "bitmap")


def all_pairs(cells: DataFrame, threshold=THRESHOLD, block: int = 256) -> DataFrame:
    """(a, b) of each cell of mixed_runs that aren't wholly in one component and that size, position and bitmaps (where both have one) allow; cells are walked in blocks."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, lo, hi, n, p, lead, c1, c2, bucket, bitmap in _runs(batches):
            cuts = np.concatenate(([0], np.flatnonzero((token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1, [len(token)]))
            known = np.array([v is not None for v in bitmap], bool)
            x_out, y_out = [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (c1[s:e] == c1[s]).all() and (c2[s:e] == c1[s]).all():
                    continue
                across = lo[s] != hi[s]
                for i in range(s, e, block):
                    i2 = min(e, i + block)
                    for j in range(i, e, block):
                        if n[i2 - 1] * den < num * n[j]:
                            break  # sorted by size: all further ones are too large
                        j2 = min(e, j + block)
                        ok = ((c1[i:i2, None] != c2[None, j:j2]) | (c2[i:i2, None] != c1[None, j:j2])) & (n[i:i2, None] * den >= num * n[None, j:j2])
                        if across:
                            ok &= bucket[i:i2, None] != bucket[None, j:j2]
                        ok &= np.minimum(n[i:i2, None] - p[i:i2, None], n[None, j:j2] - p[None, j:j2]) >= overlap_needed(n[i:i2, None], n[None, j:j2], threshold)
                        if i == j:
                            ok &= np.triu(np.ones(ok.shape, bool), 1)
                        x, y = np.nonzero(ok)
                        x, y = x + i, y + j
                        near, told = np.ones(len(x), bool), np.flatnonzero(known[x] & known[y])
                        if len(told):
                            u, v = x[told], y[told]
                            near[told] = n[u] + n[v] - 2 * overlap_needed(n[u], n[v], threshold) >= bits_apart([bitmap[k] for k in u], [bitmap[k] for k in v])
                        if near.any():
                            x_out.append(lead[x[near]])
                            y_out.append(lead[y[near]])
            if x_out:
                a, c = np.concatenate(x_out), np.concatenate(y_out)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    dealt = cells.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "lead")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def complete_pairs(posts: DataFrame, of_class: DataFrame, bitmaps: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """(a, b): the pairs of classes in different components that the grouped prefix join does not rule out.

    of_class: (class_id, lead, n, component) of every class. Pairs of groups are filtered first, then expanded to their members.
    """
    groups = of_class.groupBy("lead").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("members"))
    single = groups.where("members = 1").select("lead").join(bitmaps.select(F.col("doc_id").alias("lead"), "bitmap"), "lead")
    pairs = all_pairs(mixed_runs(posts.join(groups.drop("members"), "lead").select("token", "salt", "n", "pos", "lead", "c1", "c2"), single), threshold)
    one = of_class.select(F.col("lead").alias("a"), F.col("class_id").alias("x"), F.col("component").alias("cx"))
    two = of_class.select(F.col("lead").alias("b"), F.col("class_id").alias("y"), F.col("component").alias("cy"))
    across = pairs.join(one, "a").join(two, "b").where("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # the members of a group among themselves: each such group is a run of its own
    several = groups.where("c1 <> c2").select("lead")
    own = of_class.join(several, "lead").select(F.col("lead").alias("token"), F.lit(-1).cast("long").alias("salt"), "n", F.lit(0).cast("long").alias("pos"), F.col("class_id").alias("lead"), F.col("component").alias("c1"), F.col("component").alias("c2"))
    inner = all_pairs(mixed_runs(own, bitmaps.select(F.col("doc_id").alias("lead"), "bitmap")), threshold)
    return plausible(across, bitmaps, threshold).select("a", "b").union(inner)


def plausible(pairs: DataFrame, bitmaps: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """(a, b, apart): pairs (a, b) that the sizes and parity bitmaps of (doc_id, n, bitmap) do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            apart = bits_apart(b.column(3).to_pylist(), b.column(5).to_pylist())
            need = overlap_needed(n, m, threshold)
            ok = (n + m - 2 * need >= apart) & (np.minimum(n, m) >= need)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(apart)], ["a", "b", "apart"]).filter(pa.array(ok))

    one = bitmaps.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("x"))
    two = bitmaps.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("y"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "x", "n_b", "y")
    return joined.mapInArrow(run, "a long, b long, apart long")


def nearest(pairs: DataFrame) -> DataFrame:
    """For each document the pair (a, b, apart) with the nearest bitmap: at most one row for each document."""
    ends = pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("other"), "apart").union(pairs.select("b", "a", "apart"))
    best = ends.groupBy("doc_id").agg(F.min(F.struct("apart", "other")).alias("m"))
    return best.select(F.least("doc_id", "m.other").alias("a"), F.greatest("doc_id", "m.other").alias("b")).distinct()


def sets_of(docs: DataFrame, ids: DataFrame, size: int = SIZE, bits: int | None = None) -> DataFrame:
    """(doc_id, s): the shingle sets of the rows of docs (doc_id, text) whose id is among ids (doc_id), and of a few more.

    A Bloom filter of 2^bits bits (by default FILTER_PER_ID an id, within FILTER_BITS), made in blocks that executors OR, picks the texts, so
    none is shuffled; what it lets through beside them meets no pair. All Python work of a stage is one function, so a task never feeds two workers.
    """
    bits = bits or bits_for(FILTER_PER_ID * ids.count(), FILTER_BITS)
    blocks, per = SKETCH_BLOCKS, (1 << bits) // 8 // SKETCH_BLOCKS

    def places(a: pa.Array) -> np.ndarray:
        return (mix(a.to_numpy(zero_copy_only=False).astype("i8").view("u8")) >> np.uint64(64 - bits)).astype("i8")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, any_ = np.zeros(1 << bits, bool), False
        for b in batches:
            table[places(b.column(0))] = True
            any_ |= b.num_rows > 0
        parts = np.packbits(table).reshape(blocks, per)
        some = [k for k in range(blocks) if any_ and parts[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["block", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, np.uint8(0)) | np.frombuffer(c, "u1")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["block", "bits"])

    table = np.zeros((blocks, per), "u1")
    for r in ids.mapInArrow(mark, "block int, bits binary").repartition(blocks, "block").mapInArrow(unite, "block int, bits binary").collect():
        table[r["block"]] = np.frombuffer(r["bits"], "u1")
    flat = table.reshape(-1)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            at = places(b.column(0))
            b = b.filter(pa.array((flat[at >> 3] >> (7 - (at & 7)).astype("u1") & 1).astype(bool)))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), size).tobytes() for t in b.column(1)], pa.binary())], ["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(keep, "doc_id long, s binary")


def verified(pairs: DataFrame, docs: DataFrame, threshold=THRESHOLD, size: int = SIZE) -> DataFrame:
    """Those of the pairs (a, b) whose sets, made from the whole texts of docs (doc_id, text; ids don't repeat), are linked."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, None
        for b in batches:
            a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok = []
            for i in range(len(a)):
                if a[i] != held:
                    held, mine = a[i], np.frombuffer(b.column(2)[i].as_py(), "u8")
                other = np.frombuffer(b.column(3)[i].as_py(), "u8")
                both = len(np.intersect1d(mine, other, assume_unique=True))
                ok.append(den * both >= num * (len(mine) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct().checkpoint()
    needed = shared_table(sets_of(docs, ids, size))
    rows = pairs.join(needed.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b").join(needed.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "u long, v long")


def link(docs: DataFrame, *, threshold: tuple[int, int] = THRESHOLD, size: int = SIZE, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if ids_repeat(rows):
        keyed = shared_table(rows.withColumn("key", F.monotonically_increasing_id()))
        found = link_keys(keyed.select(F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("doc_id"), "text"), threshold, size, star_rounds)
        known = shared_table(keyed.where("doc_id IS NOT NULL").select("doc_id", "key").join(found.withColumnRenamed("doc_id", "key"), "key"))
        names = known.groupBy("component_id").agg(F.min("doc_id").alias("name"))
        out = known.join(names, "component_id").select("doc_id", "n_shingles", F.col("name").alias("component_id"))
        return out.unionByName(found.where("doc_id IS NULL"))
    return link_keys(rows, threshold, size, star_rounds)


def ids_repeat(rows: DataFrame) -> bool:
    """Whether any doc_id but null stands in several rows."""
    return bool(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count())


def link_keys(rows: DataFrame, threshold: tuple[int, int] = THRESHOLD, size: int = SIZE, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """link() for rows (doc_id long, text string) whose ids don't repeat."""
    bounded_batches(rows.sparkSession)
    described = shared_table(describe(rows, sketch(rows, size=size), threshold, size))
    full = described.where("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id"), F.first("p").alias("p"))
    classes = shared_table(classes)
    groups = classes.groupBy("n", "p").agg(F.min("class_id").alias("lead"), F.count("*").alias("members"))
    prefixes = full.select(F.col("doc_id").alias("lead"), "prefix")
    posts = shared_table(postings(groups.join(prefixes, "lead").select("lead", "n", "prefix"), chunk_rows(full)))
    led = shared_table(classes.join(groups.select("n", "p", "lead"), ["n", "p"]).select("class_id", "lead", "n"))
    bitmaps = full.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", "bitmap")

    merged = None  # (u, component) of classes that are linked to a lesser one
    for r in range(star_rounds + 1):
        if r == star_rounds:
            now = led.withColumn("component", F.col("class_id"))
            if merged is not None:
                now = led.join(merged.withColumnRenamed("u", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
            found = complete_pairs(posts, now, bitmaps, threshold)
        else:
            known = posts.withColumn("component", F.col("lead"))
            if merged is not None:
                known = posts.join(merged.withColumnRenamed("u", "lead"), "lead", "left").withColumn("component", F.coalesce("component", "lead"))
            dealt = known.select("token", "n", "pos", "lead", "component", "salt").repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "lead")
            found = star_pairs(dealt, r, threshold)
            if r == 0:
                found = found.union(led.where("lead <> class_id").select("lead", "class_id"))
            found = nearest(plausible(found, bitmaps, threshold))
        found = found.checkpoint()
        if not found.limit(1).count():
            continue
        edges = verified(found, rows, threshold, size).checkpoint()
        if merged is not None:
            edges = edges.union(merged.select("u", F.col("component").alias("v")))
        merged = components(edges)
    of_class = classes.select("n", "d1", "d2", "class_id")
    if merged is not None:
        of_class = of_class.join(merged.select(F.col("u").alias("class_id"), "component"), "class_id", "left").select("n", "d1", "d2", F.coalesce("component", "class_id").alias("class_id"))
    thin = described.select("doc_id", "n", "d1", "d2")
    out = thin.join(of_class, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
