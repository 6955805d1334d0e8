"""SimHash fingerprints of whole texts and the search for all fingerprints within a Hamming radius, in DataFrame operations alone.

A term is a run of five lower-cased words (the whole word sequence, if it is shorter), and its weight is how often it occurs. Each term's 64-bit
hash votes with its weight for or against every bit; a bit is set where the votes in favour outweigh. Votes are counted four
bits to a long integer, in chunks of 32,767 terms, so a text of any length is counted in full.

``within`` finds every pair of fingerprints at most ``radius`` bits apart: the 64 bits are cut into ``blocks`` blocks, and for each choice of
blocks - radius of them there is a table sorted by these bits moved to the front (here: an equi-join on the masked bits).
Two fingerprints within the radius agree on some such choice. Distinct fingerprints are searched, with their numbers of documents, so
groups of copies stay one row. With six blocks and radius 3 a table's key has 31 to 33 bits, enough for billions of rows.
The search is exact for its radius, but three bits stand for a cosine of about 0.99: of simulated pairs with a Jaccard likeness of 0.8 it holds
1.0 %, at 0.9 9.8 %, at 0.95 31 %, at 0.97 50 % (300 random terms each, of equal weight). ``n_near`` counts near-equal texts only.

The edited text of a document ends in the beginning of the next document in descending order of ids. Ids alone are sorted, by ranges
and without a single-task window; of the next text only the part needed is shuffled.

Defined results: a null text counts as empty; a text without words has the fingerprint 0; rows with a null doc_id have no next document
(edited text cut short, ``near_next`` null); of repeated doc_ids all rows are fingerprinted, and the one with the least text is the next
document; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.words import word_array
from colonnade.session import shared_checkpoints, shared_table

BITS = 64
SIZE = 5
RADIUS = 3
BLOCKS = 6
QUERY_EVERY = 20
HOT_PARTS, LEAST_PART = 1000, 1024
_LANES, _GAP, _CHUNK = 4, 16, 32_767
_MASK = sum(1 << (_GAP * k) for k in range(_LANES))


def _bound(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_hashes(text: Column, size: int = SIZE) -> Column:
    def of(words: Column) -> Column:
        n = F.size(words)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
        return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))

    return _bound(word_array(F.lower(F.coalesce(text, F.lit("")))), of)


def _votes_for(votes: Column, lane: str, shift: int) -> Column:
    return F.aggregate(votes, F.lit(0).cast("bigint"), lambda a, v: a + F.shiftright(v[lane], shift).bitwiseAND(F.lit((1 << _GAP) - 1)))


def fingerprint(text: Column, size: int = SIZE) -> Column:
    """The fingerprint as a bigint."""
    lanes = [f"v{j}" for j in range(_GAP)]
    zero = F.struct(*[F.lit(0).cast("bigint").alias(x) for x in lanes])

    def vote(acc: Column, h: Column) -> Column:
        return F.struct(*[(acc[x] + F.shiftright(h, j).bitwiseAND(F.lit(_MASK))).alias(x) for j, x in enumerate(lanes)])

    def chunks(hashes: Column) -> Column:
        last = F.greatest(F.floor((F.size(hashes) - 1) / _CHUNK), F.lit(0))
        votes = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda c: F.aggregate(F.slice(hashes, (c * _CHUNK + 1).cast("int"), F.lit(_CHUNK)), zero, vote))
        return _bound(votes, lambda v: decide(v, F.size(hashes)))

    def decide(votes: Column, n: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for b in range(BITS):
            lane, shift = lanes[b % _GAP], b // _GAP * _GAP
            count = _votes_for(votes, lane, shift)
            bit = (1 << b) - (1 << BITS if b == BITS - 1 else 0)
            out = out.bitwiseOR(F.when(count * 2 > n, F.lit(bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return out

    return _bound(term_hashes(text, size), chunks)


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of the two term vectors: the share of differing bits is their angle over pi; obtuse angles count as 0."""
    d = apart(a, b)
    return F.when(d * 2 >= BITS, F.lit(0.0)).otherwise(F.cos(d * F.pi() / BITS))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, n, next_id) of a table (doc_id, n) of distinct ids: the next lower id, and the highest after the lowest."""
    shared_checkpoints(ids.sparkSession)
    placed = ids.repartitionByRange(F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc()).select("doc_id", "n", F.monotonically_increasing_id().alias("m")).checkpoint()
    part = F.shiftright("m", 33)
    counts = placed.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that sorted
    starts = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"), F.sum("count").over(Window.partitionBy(F.lit(1))).alias("total"))
    ranked = placed.withColumn("part", part).join(starts, "part").select("doc_id", "n", (F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"), "total")
    after = ranked.select(F.col("rank").alias("at"), F.col("doc_id").alias("next_id"))
    return ranked.hint("merge").join(after, F.pmod(F.col("rank") + 1, F.col("total")) == F.col("at")).select("doc_id", "n", "next_id")


def tables(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The masks (as signed longs) of the permuted tables."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def within(queries: DataFrame, prints: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance) for every fingerprint of prints (fp, ...) at most radius bits from one of queries (fp); both hold distinct fingerprints.

    A pair that agrees in several tables is reported by the first of them.
    """
    masks = tables(blocks, radius)
    keyed = lambda df, name: df.select(F.col("fp").alias(name), F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for t, m in enumerate(masks)])).alias("e")).select(name, "e.t", "e.key")
    x = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m).cast("bigint")) == 0, F.lit(t)) for t, m in enumerate(masks)])
    # both sides grow with the documents: never a broadcast, however small a size is guessed; a key with very many fingerprints is split by adaptive execution
    pairs = keyed(queries, "query").hint("merge").join(keyed(prints.select("fp"), "fp").hint("merge"), ["t", "key"])
    return pairs.where((F.bit_count(x) <= radius) & (first == F.col("t"))).select("query", "fp", F.bit_count(x).alias("distance"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, their likeness, that to the next document's, and n_near.

    ``class_id`` is the least id of the documents with the same fingerprint. For documents whose id is divisible by 20 ``n_near`` is how many
    other documents have fingerprints within RADIUS bits and ``near_classes`` the ids of the other classes among them; else null.
    """
    # no alias where none is needed, or the two joins' shuffles of the same rows would not be recognised as one
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = rows.where("doc_id IS NOT NULL")  # both joins below read the same shuffle of these
    ids = known.select("doc_id", F.char_length("text").cast("long").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    chain = next_ids(ids).checkpoint()
    heads = known.join(chain.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "n").hint("merge"), "doc_id").select("for_id", F.expr("left(text, cast(n div 3 AS int))").alias("head"))
    heads = heads.groupBy(F.col("for_id").alias("doc_id")).agg(F.min("head").alias("head"))
    full = known.join(heads.hint("merge"), "doc_id", "left").unionByName(rows.where("doc_id IS NULL").withColumn("head", F.lit(None).cast("string"))).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.expr("concat(left(text, cast(n_chars - n_chars div 3 AS int)), left(coalesce(head, ''), cast(n_chars div 3 AS int)))")
    both = full.select("doc_id", "n_chars", "text", edited.alias("edited"))
    done = shared_table(both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("efp")))
    of_next = chain.select("doc_id", "next_id").hint("merge").join(done.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fp").alias("next_fp")), "next_id").select("doc_id", "next_fp")
    # a class: the documents of one fingerprint, named by the least id
    prints = done.groupBy("fp").agg(F.count("*").alias("docs"), F.min("doc_id").alias("class_id"))
    asked = done.where(F.col("doc_id") % QUERY_EVERY == 0).select("fp").distinct()
    near = within(asked, prints).hint("merge").join(prints.hint("merge"), "fp").groupBy(F.col("query").alias("fp")).agg((F.sum("docs") - 1).alias("near"), F.sort_array(F.collect_list(F.when(F.col("distance") > 0, F.col("class_id")))).alias("near_classes"))
    of_print = prints.join(near.hint("merge"), "fp", "left")
    # the documents of a fingerprint with more than a part of all documents are dealt over several keys; there are fewer than HOT_PARTS such fingerprints
    part = max(LEAST_PART, -(-done.count() // HOT_PARTS))
    hot = F.broadcast(prints.where(F.col("docs") > part).select("fp", F.ceil(F.col("docs") / part).alias("parts")))
    dealt = done.join(hot, "fp", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "edited_sha256"), "parts"), F.lit(0).cast("long"))).drop("parts")
    of_print = of_print.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("docs") / part) - 1))).select("fp", "salt", "class_id", "near", "near_classes")
    return (
        dealt.join(of_next.hint("merge"), "doc_id", "left")
        .join(of_print.hint("merge"), ["fp", "salt"])
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("fp")).alias("fingerprint"),
            as_text(F.col("efp")).alias("edited_fingerprint"),
            likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
            likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
            "class_id",
            F.when(F.col("doc_id") % QUERY_EVERY == 0, F.col("near")).alias("n_near"),
            F.when(F.col("doc_id") % QUERY_EVERY == 0, F.col("near_classes")).alias("near_classes"),
        )
    )
