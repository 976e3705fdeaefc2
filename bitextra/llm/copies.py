"""Records that differ only in case, blanks, punctuation or field order; and the best record of each such group.

Two records are copies if their bare source and bare target are equal, also crosswise.  Only records count whose two
texts both hold a letter; null, empty and letterless texts never make a copy.

The bare pair is put in order and hashed to 128 bits, so only (id, key) rows move.  Groups are counted by partial
aggregation before the shuffle.  A third hash is the collision check: it is part of the grouping key, so two
different pairs would have to agree in 192 bits to be taken for one, and ``collisions`` lists any 128-bit clash.
A hot key holds one row a task after partial aggregation; the join that brings back the members is split by AQE
where one key holds a large share of the rows, as the other side has a single row a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitextra.functions.forms import bare, has_letter
from bitextra.llm.hashing import hash128
from bitextra.operators.timestamps import declared_instant, with_interpretations
from bitextra.scratch import materialize

KEY = ["k1", "k2", "kc"]


def copy_keys(records: DataFrame, *keep: Column) -> DataFrame:
    """id, k1, k2 (the 128-bit key), kc (the check) and ``keep``, for the records that count."""
    texts = records.select(F.col("id"), bare("source").alias("_s"), bare("target").alias("_t"), *keep)
    texts = texts.filter(has_letter("_s") & has_letter("_t"))
    low, high = F.least("_s", "_t"), F.greatest("_s", "_t")
    k1, k2 = hash128(low, high)
    check = F.xxhash64(F.lit("check"), F.length(low), F.reverse(low), high)
    rest = [c for c in texts.columns if c not in ("_s", "_t")]
    return texts.select(k1.alias("k1"), k2.alias("k2"), check.alias("kc"), *rest)


def collapse(records: DataFrame) -> DataFrame:
    """One row per distinct record: group_id (least id), copies, refcount_sum (null refcounts count 0).

    An empty table gives no rows; repeated whole rows count as copies.
    """
    keys = copy_keys(records, F.col("refcount").cast("bigint").alias("refcount"))
    return keys.groupBy(*KEY).agg(
        F.min("id").alias("group_id"), F.count(F.lit(1)).alias("copies"), F.coalesce(F.sum("refcount"), F.lit(0)).alias("refcount_sum")
    ).select("group_id", "copies", "refcount_sum")


def collisions(records: DataFrame) -> DataFrame:
    """128-bit keys that stand for more than one bare pair (none expected): k1, k2, pairs."""
    distinct = copy_keys(records).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("pairs")).filter("pairs > 1")


def members(records: DataFrame) -> DataFrame:
    """group_id, id of every record in a group of two or more, the least id included."""
    keys = materialize(copy_keys(records), "copy-keys")
    groups = keys.groupBy(*KEY).agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return keys.join(groups, KEY).select("group_id", "id")


def _ranked_keys(records: DataFrame, memories: DataFrame, *keep: Column) -> DataFrame:
    clock = memories.select(F.col("memory").alias("_m"), F.col("tz").alias("_tz"), F.col("date_order").alias("_o")).dropDuplicates(["_m"])
    rank = [F.col("validated"), F.col("reliability"), F.col("refcount"), F.col("modified"), F.col("memory")]
    keys = copy_keys(records, *rank, *keep)
    keys = keys.join(clock, keys["memory"] == clock["_m"], "left")
    keys = with_interpretations(keys, "modified", "_r", F.col("_tz"), F.col("_o"))
    for c in [c for c in ("x_created", "x_modified") if c in keys.columns]:
        # an unreadable time is a gap
        keys = with_interpretations(keys, c, "_r2", F.col("_tz"), F.col("_o"))
        keys = keys.withColumn(c, F.when(declared_instant(F.col("_r2")).isNotNull(), F.col(c))).drop("_r2")
    return keys.select(
        *KEY, "id",
        F.coalesce("validated", F.lit(False)).alias("valid"),
        F.when(F.col("reliability").between(0, 9), F.col("reliability")).alias("rel"),
        declared_instant(F.col("_r")).alias("at"), F.col("refcount").alias("refs"),
        *[c for c in keys.columns if c.startswith("x_")],
    )


def _order() -> list[Column]:
    return [F.desc("valid"), F.desc_nulls_last("rel"), F.desc_nulls_last("at"), F.desc_nulls_last("refs"), F.asc("id")]


def survivors(records: DataFrame, memories: DataFrame) -> DataFrame:
    """group_id, id: the best record of every group of two or more copies.

    Rank: validated true before false or null; higher reliability (null or outside 0-9 last); later modified
    (missing or unreadable last); higher refcount (null last); smaller id.  The window's rank filter is also applied
    before the shuffle, so a task sends one row a group, however large the group.
    """
    keys = materialize(_ranked_keys(records, memories), "ranked-keys")
    groups = keys.groupBy(*KEY).agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    best = keys.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(*_order()))).filter("rank = 1")
    return groups.join(best.select(*KEY, "id"), KEY).select("group_id", "id")


def golden(records: DataFrame, memories: DataFrame) -> DataFrame:
    """One row per group of two or more: the surviving record, with its gaps filled from the other copies.

    group_id, copies, refcount_sum and the columns of a record.  source and target are the survivor's; of every other
    column a null, blank, undetermined, unreadable or out-of-range value is a gap and comes from the best-ranked copy
    that has one.  A crosswise copy gives its labels swapped, and no comparison text, as its own is of the other side.
    """

    def told(c: str) -> Column:
        return F.when(F.trim(F.col(c)) != "", F.col(c))

    def label(c: str) -> Column:
        return F.when(~F.lower(F.trim(F.col(c))).isin("", "und", "undetermined"), F.col(c))

    ahead = bare("source") <= bare("target")
    values = {c: told(c) for c in ("memory", "context", "created", "modified", "created_by", "modified_by")}
    values |= {"reliability": F.when(F.col("reliability").between(0, 9), F.col("reliability")), "validated": F.col("validated"), "refcount": F.col("refcount"), "ingested": F.col("ingested")}
    values |= {"low_lang": F.when(ahead, label("src_lang")).otherwise(label("tgt_lang")), "high_lang": F.when(ahead, label("tgt_lang")).otherwise(label("src_lang"))}
    own = {c: v for c, v in (("source_cmp", told("source_cmp")), ("source_len", F.col("source_len"))) if c in records.columns}
    values |= {f"low_{c}": F.when(ahead, v) for c, v in own.items()} | {f"high_{c}": F.when(~ahead, v) for c, v in own.items()}
    keep = [v.alias(f"x_{c}") for c, v in values.items()]
    keys = materialize(_ranked_keys(records, memories, *keep, ahead.alias("x_ahead")), "golden-keys")
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(*_order())))
    # partitioned by the key already, so all columns come from the one shuffle
    groups = ranked.groupBy(*KEY).agg(
        F.min("id").alias("group_id"), F.count(F.lit(1)).alias("copies"), F.coalesce(F.sum("refs"), F.lit(0)).alias("refcount_sum"),
        *[F.min_by(c, "rank").alias(c) for c in ("id", "x_ahead")],
        *[F.min_by(f"x_{c}", F.when(F.col(f"x_{c}").isNotNull(), F.col("rank"))).alias(f"x_{c}") for c in values],
    ).filter("copies > 1")

    def facing(low: str, high: str) -> Column:
        return F.when(F.col("x_ahead"), F.col(f"x_{low}")).otherwise(F.col(f"x_{high}"))

    sided = {"src_lang": facing("low_lang", "high_lang"), "tgt_lang": facing("high_lang", "low_lang")} | {c: facing(f"low_{c}", f"high_{c}") for c in own}
    texts = records.select("id", "source", "target")
    return groups.join(texts, "id").select(
        "group_id", "id", "copies", "refcount_sum", "source", "target", *[F.col(f"x_{c}").alias(c) for c in values if not c.startswith(("low_", "high_"))],
        *[v.alias(c) for c, v in sided.items()],
    )
