"""Tab-separated memories, glossaries and rules, through Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextra.scratch import materialize
from bitextra.sources.formats import TSV_HEADER


def _raw(spark: SparkSession, path: str, header: bool, columns: int) -> DataFrame:
    names = [f"c{k}" for k in range(columns)]
    reader = spark.read.options(sep="\t", quote='"', escape='"', multiLine=True, header=header, enforceSchema=True, encoding="UTF-8", mode="PERMISSIVE")
    return reader.schema(", ".join(f"{n} string" for n in names)).csv(path)


def _trim(c: str):
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def read_tsv(spark: SparkSession, path: str, source_col: int = 0, target_col: int = 1, header: bool = True, both: bool = False) -> DataFrame:
    """source, target: trimmed; rows with neither are left out (with ``both``, rows that lack either)."""
    raw = _raw(spark, path, header, max(source_col, target_col) + 1)
    out = raw.filter(F.col(f"c{max(source_col, target_col)}").isNotNull() | F.lit(not both)).select(_trim(f"c{source_col}").alias("source"), _trim(f"c{target_col}").alias("target"))
    keep = (F.col("source") != "") & (F.col("target") != "") if both else (F.col("source") != "") | (F.col("target") != "")
    return out.filter(keep)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """source, target of the rows that have both; the first row of a file is a header if its first cell says 'source'."""
    raw = _raw(spark, path, False, 2).select("c0", "c1", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = materialize(raw, "tsv-rows")
    heads = rows.groupBy("file").agg(F.min(F.struct("at", "c0")).alias("first")).filter(F.col("first.c0").rlike("(?i)source")).select("file", F.col("first.at").alias("at"))
    out = rows.join(heads, ["file", "at"], "left_anti").select(_trim("c0").alias("source"), _trim("c1").alias("target"))
    return out.filter((F.col("source") != "") & (F.col("target") != ""))


def write_glossary_sheet(glossary: DataFrame, path: str) -> None:
    """Term, Translation and Notes of the glossary, in place of what was at ``path``."""
    write_rows(glossary.select(F.col("term").alias("Term"), F.col("translation").alias("Translation"), F.col("notes").alias("Notes")), path, ["Term", "Translation", "Notes"])


def write_tsv(df: DataFrame, path: str, mark: bool = True) -> None:
    """Seven columns with a header; dates in ISO form, flags as Yes and No. Quoted where tabs or breaks need it.

    Each file starts with a byte order mark, for spreadsheets, unless ``mark`` is false.
    """
    def text(c: str):
        if c not in df.columns:
            return F.lit("")
        if c == "validated":
            return F.when(F.col(c), "Yes").otherwise("No")
        if c in ("created", "modified"):
            return F.coalesce(F.regexp_replace(F.col(c).cast("string"), "^(\\d{4}-\\d{2}-\\d{2}) ", "$1T"), F.lit(""))
        return F.coalesce(F.col(c).cast("string"), F.lit("0" if c == "reliability" else ""))

    out = df.select(*[text(c).alias(f"\ufeff{c}" if mark and k == 0 else c) for k, c in enumerate(TSV_HEADER)])
    out.write.options(sep="\t", quote='"', escape='"', header=True, emptyValue="", quoteAll=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode("overwrite").csv(path)


def write_rows(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns as a quoted tab-separated table with a header."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.options(sep="\t", quote='"', escape='"', header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode("overwrite").csv(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """term, translation, notes; a header row is told by its first cell being 'term', '用語', 'source', 'en' or 'src'."""
    rows = _raw(spark, path, False, 3).select(_trim("c0").alias("term"), _trim("c1").alias("translation"), _trim("c2").alias("notes"))
    return rows.filter(~F.lower("term").isin("term", "用語", "source", "en", "src") & (F.col("term") != ""))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """source_pattern, target_template: distinct rules whose pattern compiles; the header that the writer adds is skipped."""
    from bitextra.operators.upsert import valid_rules

    rows = _raw(spark, path, False, 2).select(_trim("c0").alias("source_pattern"), _trim("c1").alias("target_template"))
    rows = rows.filter((F.col("source_pattern") != "") & (F.col("source_pattern") != "source_pattern")).distinct()
    return valid_rules(rows.withColumn("rule_id", F.monotonically_increasing_id())).filter("valid").select("source_pattern", "target_template")
