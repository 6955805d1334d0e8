"""The ten operators' decisions applied to a documents table, as the corpus pipeline uses them.

Every function but the last takes a table with the columns of documents (and any others) and returns the same columns. An empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm import jaccard, language, mixing, packing, pii
from colonnade.operators.order import numbered
from colonnade.session import shared_table


def identified(docs: DataFrame) -> DataFrame:
    """Without the documents whose language can't be told (null and empty texts among them); repeated rows stay or go together."""
    return language.keep_identified(docs)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document, the one with the least id, of each component of near copies; of rows of one id with linked texts, one row.

    Documents without words are copies of nothing and stay, and so do rows without an id.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if not jaccard.ids_repeat(ids):
        gone = jaccard.link(docs).where("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # rows get keys that grow with the id, so the least key of a component is a row of its least id
    names = docs.columns
    own = docs.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(names)])
    doc_id, text = f"own_{names.index('doc_id')}", f"own_{names.index('text')}"
    keyed = shared_table(numbered(own, F.col(doc_id).asc_nulls_last(), F.col(text).asc_nulls_last(), name="key"))
    found = jaccard.link_keys(keyed.select(F.when(F.col(doc_id).isNotNull(), F.col("key")).alias("doc_id"), F.col(text).cast("string").alias("text")))
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("key"))
    return keyed.join(gone, "key", "left_anti").select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(names)])


def redacted(docs: DataFrame) -> DataFrame:
    """Personal data replaced by the names of its kinds in every row; null and empty texts, ties and repeated rows stay as they are."""
    return pii.redact(docs)


def mixed(docs: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it. Rows without words (null and empty texts among them) are taken never; repeated rows count and
    are taken one by one; ties in the seeded order go to the lesser doc_id, then the smaller text; a null source is a source of its own."""
    return mixing.materialize(docs)


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of all rows; null and empty texts are the end id alone, repeated rows are packed one by one."""
    return packing.pack(docs)
