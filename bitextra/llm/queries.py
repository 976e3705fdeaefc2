"""Queries of the training-data operations, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextra.llm import copies, langid, looks, near, packing, quality, tokens
from bitextra.plans.tables import table
from bitextra.scratch import materialize

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.members(table(spark, d, "records"))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, "records"))


def p1_collisions(spark: SparkSession, d: str) -> DataFrame:
    return copies.collisions(table(spark, d, "records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near.similar_records(table(spark, d, "records"))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return near.record_links(table(spark, d, "records"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.record_groups(table(spark, d, "records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(table(spark, d, "records"), table(spark, d, "langsamples"))


def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.record_languages(table(spark, d, "records"), table(spark, d, "langsamples"))


def p3_passages(spark: SparkSession, d: str) -> DataFrame:
    return langid.record_passages(table(spark, d, "records"), table(spark, d, "langsamples"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_alikes(table(spark, d, "records"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return looks.record_forms(table(spark, d, "records"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_classes(table(spark, d, "records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.survivors(table(spark, d, "records"), table(spark, d, "memories"))


def p5_golden(spark: SparkSession, d: str) -> DataFrame:
    return copies.golden(table(spark, d, "records"), table(spark, d, "memories"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text does not come back from its ids (none)."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    back = tokens.decode(tokens.encode(documents, "doc_id"), "doc_id").withColumnRenamed("text", "back")
    return documents.join(back, "doc_id").filter(~F.col("text").eqNullSafe(F.col("back"))).select("doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialize(tokens.encode(table(spark, d, "documents"), "doc_id", counts_only=True), "token-counts")
    return packing.containers(sizes, table(spark, d, "batches"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_containers(spark, d), table(spark, d, "batches"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"), table(spark, d, "commonwords"), table(spark, d, "langsamples"))


def p9_figures(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_figures(table(spark, d, "documents"), table(spark, d, "commonwords"), table(spark, d, "langsamples"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p1_collapsed": p1_collapsed, "p1_collisions": p1_collisions,
    "p2_found": p2_found, "p2_links": p2_links, "p2_groups": p2_groups,
    "p3_found": p3_found, "p3_languages": p3_languages, "p3_passages": p3_passages,
    "p6_found": p6_found, "p6_forms": p6_forms, "p6_classes": p6_classes,
    "p5_found": p5_found, "p5_golden": p5_golden,
    "p7_ids": p7_ids, "p7_round_trip": p7_round_trip,
    "p8_containers": p8_containers, "p8_fill": p8_fill,
    "p9_found": p9_found, "p9_figures": p9_figures,
}

_BARE = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_PAIRS = rf"""
WITH b AS (SELECT id, refcount, {_BARE.format('source')} AS s, {_BARE.format('target')} AS t FROM records),
     k AS (SELECT id, refcount, least(s, t) AS lo, greatest(s, t) AS hi FROM b
           WHERE regexp_matches(s, '\p{{L}}') AND regexp_matches(t, '\p{{L}}')),
     g AS (SELECT lo, hi, min(id) AS group_id, count(*) AS copies, CAST(coalesce(sum(refcount), 0) AS BIGINT) AS refcount_sum
           FROM k GROUP BY lo, hi)
"""
ORACLES: dict[str, str] = {
    "p1_found": _PAIRS + "SELECT g.group_id, k.id FROM k JOIN g USING (lo, hi) WHERE g.copies > 1",
    "p1_collapsed": _PAIRS + "SELECT group_id, copies, refcount_sum FROM g",
    "p7_round_trip": "SELECT doc_id FROM documents WHERE false",
    "p1_collisions": "SELECT CAST(0 AS BIGINT) AS k1, CAST(0 AS BIGINT) AS k2, CAST(0 AS BIGINT) AS pairs WHERE false",
}
