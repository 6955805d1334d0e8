"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone.

Every source gets a weight and a cap of ``max_epochs`` times its size. The common level L solves
sum(min(cap, L * weight)) = budget: with the sources sorted by cap / weight, the level that holds once the first k-1
sources are full is (budget - their caps) / (weights left), and L is the first such level that does not exceed the k-th
source's own cap / weight. This is where clamping and resharing by weight come to rest, found by running sums.

A source whose target is q times its size repeats every document floor(q) times. What is missing is taken once more from the
source's documents in an order seeded by MD5, up to the target; the document that the end falls into gives the words before
it. So a source's taken words equal its rounded target.

Scale: the text column is only counted, never shuffled. ``mix`` counts words once and writes (id, source, size, draw); ``materialize``, which has
to carry the texts, counts them once for the sums and once as it goes over the rows. Running sums are made within (source, cell), where
a cell is one of 4096 by hash, and a table of cell sums gives each cell its start, so a source with a third of all rows is spread over 4096
groups. There may be very many sources: they are numbered and summed up as ordered streams (``operators.order``), not in one task, and the
level is one number. Targets join the table of cells, and rows meet it once, on the keys of the running sums, so rows are shuffled once.

Defined results: null text has size 0 and takes nothing; a null source is a source of its own, last in order; repeated rows count
once each; an empty table gives an empty result; other columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.words import WORD, word_count
from colonnade.operators.order import Ordered, numbered
from colonnade.session import shared_table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, size); weights repeat over the sources in code point order, null last."""
    by_source = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last(), name="rank")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = by_source.withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs).withColumn("limit", F.col("cap") / F.col("w"))
    filled = Ordered.by(weighted, "limit", F.col("source").asc_nulls_last()).running(F.col("cap"), "full", inclusive=False).running(F.col("w"), "gone", inclusive=False)
    everything = weighted.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    level = (F.lit(float(budget)) * F.lit(everything["size"] or 0) - F.col("full")) / (F.lit(everything["w"] or 0) - F.col("gone"))
    found = filled.df.select("source", "source_size", "w", "cap", "limit", level.alias("level"))
    reached = found.agg(F.max(F.when(F.col("level") <= F.col("limit"), F.col("level"))).alias("level")).first()["level"]
    cap = F.col("cap").cast("double")
    return found.select("source", "source_size", F.least(cap, F.coalesce(F.lit(reached).cast("double") * F.col("w"), cap)).alias("target"))


def _counted(docs: DataFrame, seed: str) -> DataFrame:
    """docs (doc_id, source, text and others) with the size of each row, its place in the seeded order and the cell of that."""
    draw = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("draw", draw).withColumn("cell", F.substring("draw", 1, 3))


def _shares(rows: DataFrame, sums: DataFrame, weights, budget: float, max_epochs: int) -> DataFrame:
    """rows of _counted with source_size, target, ``whole`` repetitions, then ``part`` words; sums: (source, cell, cell_size) of all rows."""
    targets = source_targets(sums.select("source", F.col("cell_size").alias("size")), weights=weights, budget=budget, max_epochs=max_epochs)
    whole = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("cut", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    order = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = sums.select("source", "cell", F.coalesce(F.sum("cell_size").over(order), F.lit(0)).alias("base"))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "whole", "cut")
    cells = cells.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("c_source"), F.col("cell").alias("c_cell"), "base", "source_size", "target", "whole", "cut")
    within = Window.partitionBy("source", "cell").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumn("end", F.sum("size").over(within)).join(cells, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("c_cell")))
    start = F.col("base") + F.col("end") - F.col("size")
    return joined.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - start)).cast("long"))


def mix(docs: DataFrame, *, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, whole, part): ``whole`` repetitions, then ``part`` words."""
    rows = shared_table(_counted(docs.select("doc_id", "source", "text"), seed).drop("text"))
    sums = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    taken = F.col("whole") * F.col("size") + F.col("part")
    return _shares(rows, sums, weights, budget, max_epochs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "whole", "part")


def materialize(docs: DataFrame, *, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs (doc_id, text, source and others), each as often as it is taken.

    A repetition that is taken in part keeps the text up to the end of its last word taken. ``n_chars`` follows the text where there is such a column.
    """
    names = docs.columns
    thin = _counted(docs.select("doc_id", "source", "text"), seed)
    sums = shared_table(thin.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))
    rows = _counted(docs.select("doc_id", "source", "text", *[F.col(c).alias(f"own_{i}") for i, c in enumerate(names)]), seed).drop("text")
    mixed = _shares(rows, sums, weights, budget, max_epochs)
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("whole")))).where((F.col("copy") < F.col("whole")) | (F.col("part") > 0))
    cut = (F.col("copy") == F.col("whole")) & (F.col("part") < F.col("size"))
    own = {c: F.col(f"own_{i}") for i, c in enumerate(names)}
    text = F.when(cut, first_words(own["text"], F.col("part"))).otherwise(own["text"])
    out = own | {"text": text}
    if "n_chars" in names:
        out["n_chars"] = F.when(cut, F.char_length(text)).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return copies.select(*[v.alias(k) for k, v in out.items()])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space before and between kept."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
                  md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([{", ".join(map(str, WEIGHTS))}], 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}) AS w,
             source_size * {MAX_EPOCHS} AS cap FROM s),
l AS (SELECT *, cap / w AS lim, (sum(source_size) OVER ()) * {BUDGET}::DOUBLE AS everything FROM w),
k AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(w) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM l),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN lev <= lim THEN lev END) OVER () * w, cap::DOUBLE)) AS target FROM k),
q AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d),
r AS (SELECT doc_id, size, source_size, target, whole, greatest(0, least(size, round(target)::BIGINT - whole * source_size - start))::BIGINT AS part
      FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken, whole, part FROM r
"""
