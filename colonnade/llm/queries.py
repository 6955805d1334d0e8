"""Queries over the operators of this subpackage, as registered by the entry module."""

from __future__ import annotations

from colonnade.llm import chat, html, jaccard, language, media, mixing, packing, pii, sharding, simhash
from colonnade.session import table


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_chat(spark, sf_dir):
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op4_simhash(spark, sf_dir):
    return simhash.fingerprints(table(spark, sf_dir, "documents"))


def op5_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_jaccard(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"))


def op9_tiff(spark, sf_dir):
    return media.digests(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_chat": op2_chat,
    "op3_html": op3_html,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_language": op6_language,
    "op7_mixing": op7_mixing,
    "op8_jaccard": op8_jaccard,
    "op9_tiff": op9_tiff,
    "op10_pii": op10_pii,
}

#: DuckDB SQL for the queries that SQL can express at whole-table cost.
ORACLE_SQL: dict[str, str] = {
    "op2_chat": chat.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
}
