"""Changes to a memory or glossary as plans over tables: append, merge with reference counts, update, delete."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitextra.functions import columns as C
from bitextra.scratch import materialize

ADDED, COUNTED, EXISTS = "added", "refcount", "exists"


def numbered(df: DataFrame, after: int = 0, order: list[str | Column] | None = None) -> DataFrame:
    """Add consecutive ids after ``after``: each partition counts its rows, then numbers them from its offset.

    Rows are numbered where they are, so nothing is gathered in one task.
    """
    rows = df if order is None else df.orderBy(*order)
    rows = materialize(rows.withColumns({"__p": F.spark_partition_id(), "__n": F.monotonically_increasing_id()}), "numbered")
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__size"), F.min("__n").alias("__first"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(w), F.lit(0))).drop("__size")  # one row a partition
    out = rows.join(F.broadcast(offsets), "__p")
    return out.withColumn("id", F.lit(after) + F.col("__before") + F.col("__n") - F.col("__first") + 1).drop("__p", "__n", "__first", "__before")


def with_forms(df: DataFrame) -> DataFrame:
    return df.withColumns({"source_cmp": C.make_cmp("source"), "target_cmp": C.make_cmp("target"), "source_len": F.length(C.make_cmp("source"))})


def merged_pairs(memory: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per distinct incoming pair: source_cmp, target_cmp, source, target, times, id, action.

    The key is the pair of comparison forms.  A pair that the memory holds counts on its first record (least id), one
    that it does not is added once, with one count less than it came.  ``incoming`` has seq, source, target; the first
    by seq gives the texts.  Rows with a null or blank text are left out.
    """
    key = ["source_cmp", "target_cmp"]
    new = incoming.filter(F.trim("source") != "").filter(F.trim("target") != "").select("seq", "source", "target", C.make_cmp("source").alias("source_cmp"), C.make_cmp("target").alias("target_cmp"))
    new = new.groupBy(*key).agg(F.min_by(F.struct("source", "target"), "seq").alias("first"), F.count(F.lit(1)).alias("times"))
    old = memory.select("id", C.make_cmp("source").alias("source_cmp"), C.make_cmp("target").alias("target_cmp")).groupBy(*key).agg(F.min("id").alias("id"))
    out = new.join(old, key, "left")
    return out.select(*key, "first.source", "first.target", "times", "id", F.when(F.col("id").isNull(), ADDED).otherwise(COUNTED).alias("action"))


def upsert(memory: DataFrame, incoming: DataFrame, now: Column | None = None, by: str = "") -> DataFrame:
    """The memory after the merge, with the columns of ``memory``; new records get ids after the greatest."""
    now = F.current_timestamp() if now is None else now
    # hits and fresh rows come from one evaluation
    pairs = materialize(merged_pairs(memory, incoming), "merged-pairs")
    hits = pairs.filter(F.col("action") == COUNTED).select(F.col("id").alias("__id"), "times")
    old = memory.join(hits, memory["id"] == hits["__id"], "left")
    changed = {"refcount": F.when(F.col("times").isNull(), F.col("refcount")).otherwise(F.coalesce("refcount", F.lit(0)) + F.col("times").cast("int"))}
    if "modified" in memory.columns:
        changed["modified"] = F.when(F.col("times").isNotNull(), now.cast(memory.schema["modified"].dataType)).otherwise(F.col("modified"))
    if by and "modified_by" in memory.columns:
        changed["modified_by"] = F.when(F.col("times").isNotNull(), F.lit(by)).otherwise(F.col("modified_by"))
    old = old.withColumns(changed).select(*memory.columns)
    top = memory.agg(F.max("id")).first()[0] or 0
    fresh = numbered(pairs.filter(F.col("action") == ADDED).select("source", "target", "times"), int(top), ["source", "target"])
    values = {
        "source": F.col("source"), "target": F.col("target"), "id": F.col("id"), "refcount": F.col("times").cast("int") - 1, "context": F.lit(""), "reliability": F.lit(0), "validated": F.lit(False),
        "created": now, "modified": now, "created_by": F.lit(by), "modified_by": F.lit(by), "source_cmp": C.make_cmp("source"), "target_cmp": C.make_cmp("target"), "source_len": F.length(C.make_cmp("source")),
    }
    return old.unionByName(fresh.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in memory.schema]))


def tallies(pairs: DataFrame) -> DataFrame:
    """One row: added, updated, total; a pair repeated in the batch counts as updated after its first."""
    added = F.count_if(F.col("action") == ADDED)
    return pairs.agg(added.alias("added"), (F.coalesce(F.sum("times"), F.lit(0)) - added).alias("updated"), F.coalesce(F.sum("times"), F.lit(0)).alias("total"))


def append(memory: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """The memory with all incoming rows added, repeats included; forms and lengths are made where the memory has them."""
    now = F.current_timestamp() if now is None else now
    top = memory.agg(F.max("id")).first()[0] or 0
    fresh = with_forms(numbered(incoming.drop("id"), int(top)))
    for c in ("created", "modified"):
        if c in memory.columns:
            fresh = fresh.withColumn(c, F.coalesce(F.col(c), now.cast(memory.schema[c].dataType)) if c in fresh.columns else now.cast(memory.schema[c].dataType))
    cols = [F.col(f.name).cast(f.dataType) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in memory.schema]
    return memory.unionByName(fresh.select(*cols))


def update(memory: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of ``changes`` (id and any columns) laid over the memory; nulls leave the value, forms are made anew."""
    now = F.current_timestamp() if now is None else now
    new = changes.select(F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in changes.columns if c != "id" and c in memory.columns])
    out = memory.join(new, memory["id"] == new["__id"], "left")
    hit = F.col("__id").isNotNull()
    out = out.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in changes.columns if c != "id" and c in memory.columns})
    if "modified" in memory.columns and "modified" not in changes.columns:
        out = out.withColumn("modified", F.when(hit, now.cast(memory.schema["modified"].dataType)).otherwise(F.col("modified")))
    forms = (("source_cmp", "source", False), ("target_cmp", "target", False), ("source_len", "source", True), ("cmp", "term", False), ("translation_cmp", "translation", False))
    for c, text, length in forms:
        if c in memory.columns and text in memory.columns:
            form = F.length(C.make_cmp(text)) if length else C.make_cmp(text)
            out = out.withColumn(c, F.when(hit, form).otherwise(F.col(c)))
    return out.select(*memory.columns)


def delete(memory: DataFrame, ids: DataFrame) -> DataFrame:
    return memory.join(ids.select("id").distinct(), "id", "left_anti").select(*memory.columns)


def add_terms(glossary: DataFrame, incoming: DataFrame) -> DataFrame:
    """Distinct incoming terms (seq, term, translation) with action 'added' or 'exists', by the pair of comparison forms."""
    key = ["cmp", "translation_cmp"]
    new = incoming.filter(F.trim("term") != "").select("seq", "term", "translation", C.make_cmp("term").alias("cmp"), C.make_cmp(F.coalesce("translation", F.lit(""))).alias("translation_cmp"))
    new = new.groupBy(*key).agg(F.min_by(F.struct("term", "translation"), "seq").alias("first"))
    old = glossary.select(C.make_cmp("term").alias("cmp"), C.make_cmp(F.coalesce("translation", F.lit(""))).alias("translation_cmp"), F.lit(True).alias("known")).distinct()
    out = new.join(old, key, "left")
    return out.select(*key, "first.term", "first.translation", F.when(F.col("known"), EXISTS).otherwise(ADDED).alias("action"))


def first_by_form(glossary: DataFrame) -> DataFrame:
    """The first entry (least id) of each comparison form: cmp, id, term, translation."""
    form = F.coalesce(F.nullif("cmp", F.lit("")), C.make_cmp("term"))
    rows = glossary.filter("term <> ''").select(form.alias("cmp"), "id", "term", "translation")
    return rows.groupBy("cmp").agg(F.min(F.struct("id", "term", "translation")).alias("e")).select("cmp", "e.id", "e.term", "e.translation")


def valid_rules(rules: DataFrame) -> DataFrame:
    """Rules with ``valid`` (the pattern compiles) and ``repeat`` (an earlier rule has the same pattern and template)."""
    @F.pandas_udf("boolean")
    def compiles(s: pd.Series) -> pd.Series:
        def ok(p):
            try:
                re.compile(p)
                return True
            except (re.error, TypeError):
                return False

        return s.map(ok)

    firsts = rules.groupBy("source_pattern", "target_template").agg(F.min("rule_id").alias("__first"))
    r, f = rules.alias("r"), firsts.alias("f")
    same = F.col("r.source_pattern").eqNullSafe(F.col("f.source_pattern")) & F.col("r.target_template").eqNullSafe(F.col("f.target_template"))
    return r.join(f, same).select("r.*", "__first").select(*rules.columns, compiles("source_pattern").alias("valid"), (F.col("__first") < F.col("rule_id")).alias("repeat"))
