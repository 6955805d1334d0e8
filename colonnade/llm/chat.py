"""Chat formatting by rotating perspectives in dialogues of several parties.

For every participant of a conversation the whole dialogue is rendered once, with that speaker as the assistant and everybody else as a
named user; system turns stay system turns and are nobody's perspective. Each turn is a header, the text and an end mark. The mask lists
the code point ranges to train on: the text and end mark of the assistant's turns, nothing else. The mark's opening characters are escaped
in texts and roles, and so are line breaks in roles, so neither can forge a turn or leave its header.

Scale: DataFrame operations alone. Turns are numbered and offset within (conversation, perspective, cell of 256 turn numbers), and
a table of cell sums gives each cell its start; a rendering of more than ``part_chars`` code points comes in several rows (part 0, 1, ...),
so neither a task nor a row holds an unbounded conversation.

Defined results: a null text is empty; a null role is a user named unknown and no perspective; turns are ordered by number (null last),
then role, then text, and repeated rows are rendered once each; a null conv_id is a conversation of its own; conversations without a
participant give no row; an empty table an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the rendered form.
OPEN, CLOSE, TURN_END = "<|im_start|>", "<|im_end|>", "\n"
MARK, ESCAPED = "<|", "<\\|"
LINE_BREAKS = (("\n", "\\n"), ("\r", "\\r"))
SYSTEM, UNKNOWN = "system", "unknown"
CELL_TURNS = 256
PART_CHARS = 1 << 20


def rotate(turns: DataFrame, *, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, perspective, part, text, mask, n_turns, n_chars, n_trained) of a table (conv_id, turn, role, text)."""
    rows = turns.select(
        F.col("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(MARK), F.lit(ESCAPED)).alias("said")
    )
    parties = rows.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select(F.col("conv_id").alias("p_conv"), F.col("role").alias("perspective")).distinct()
    seen = rows.join(parties, F.col("conv_id").eqNullSafe(F.col("p_conv"))).drop("p_conv")
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    named = F.replace(F.coalesce("role", F.lit(UNKNOWN)), F.lit(MARK), F.lit(ESCAPED))
    for break_, shown in LINE_BREAKS:
        named = F.replace(named, F.lit(break_), F.lit(shown))
    head = F.when(own, F.lit("assistant")).when(F.col("role") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), named))
    seen = seen.withColumn("head", F.concat(F.lit(OPEN), head, F.lit("\n"))).withColumn("own", own)
    seen = seen.withColumn("segment", F.concat("head", "said", F.lit(CLOSE + TURN_END))).withColumn("size", F.char_length("segment").cast("long"))
    seen = seen.withColumn("cell", F.floor(F.col("turn") / CELL_TURNS))
    keys = ["conv_id", "perspective", "cell"]
    cells = seen.groupBy(keys).agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("conv_id", "perspective").orderBy(F.col("cell").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(keys).orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), "said").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys]
    placed = seen.withColumn("run", F.sum("size").over(within)).join(starts, same[0] & same[1] & same[2])
    placed = placed.withColumn("start", F.col("base") + F.col("run") - F.col("size")).withColumn("part", F.floor(F.col("start") / part_chars).cast("int"))
    low = F.col("start") + F.char_length("head")
    high = F.col("start") + F.col("size") - len(TURN_END)
    placed = placed.withColumn("span", F.when(F.col("own"), F.concat(low.cast("string"), F.lit(":"), high.cast("string")))).withColumn("trained", F.when(F.col("own"), high - low).otherwise(F.lit(0)))
    made = placed.groupBy("conv_id", "perspective", "part").agg(
        F.sort_array(F.collect_list(F.struct("start", "segment", "span"))).alias("s"), F.count("*").alias("n_turns"), F.sum("size").alias("n_chars"), F.sum("trained").cast("long").alias("n_trained")
    )
    return made.select("conv_id", "perspective", "part", F.array_join("s.segment", "").alias("text"), F.array_join(F.array_compact("s.span"), ",").alias("mask"), "n_turns", "n_chars", "n_trained")


ORACLE_SQL = f"""
WITH r AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '{MARK}', '{ESCAPED}') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role IS NOT NULL AND role <> '{SYSTEM}'),
h AS (SELECT r.*, perspective, coalesce(role = perspective, FALSE) AS own, '{OPEN}' || CASE WHEN coalesce(role = perspective, FALSE) THEN 'assistant' WHEN role = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user name=' || replace(replace(replace(coalesce(role, '{UNKNOWN}'), '{MARK}', '{ESCAPED}'), chr(10), '\\n'), chr(13), '\\r') END || chr(10) AS head
      FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
g AS (SELECT *, head || said || '{CLOSE}' || chr(10) AS segment FROM h),
o AS (SELECT *, length(segment) AS size, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role NULLS LAST, said ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(segment) AS start FROM g),
m AS (SELECT *, (start // {PART_CHARS})::INT AS part, start + length(head) AS low, start + size - 1 AS high FROM o)
SELECT conv_id, perspective, part, string_agg(segment, '' ORDER BY start) AS text, coalesce(string_agg(CASE WHEN own THEN low::BIGINT || ':' || high::BIGINT END, ',' ORDER BY start), '') AS mask,
       count(*)::BIGINT AS n_turns, sum(size)::BIGINT AS n_chars, sum(CASE WHEN own THEN high - low ELSE 0 END)::BIGINT AS n_trained
FROM m GROUP BY conv_id, perspective, part
"""
