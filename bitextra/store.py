"""A memory, its glossary, rules and settings as versioned Parquet tables in one folder.

Every change writes a new version of the table and then a numbered pointer; the highest number holds.  Readers see
either the old or the new version, a failed job leaves the old, and the last ``KEPT`` versions stay for those who still
read them.  Changes are the plans of ``operators.upsert``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextra import schema
from bitextra.operators import upsert as up
from bitextra.functions import columns as C
from bitextra.scratch import materialize

#: versions of a table that stay
KEPT = 3
TABLES = {"memory": schema.MEMORY, "glossary": schema.GLOSSARY, "rules": schema.RULES, "meta": schema.META}


class Store:
    """``Store.open`` makes empty tables where there are none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        store = cls(spark, path)
        for name, ddl in TABLES.items():
            if store._version(name) is None:
                rows = list(schema.DEFAULTS.items()) if name == "meta" else []
                store._save(name, spark.createDataFrame(rows, ddl))
        return store

    def close(self) -> None:
        """Nothing is held open."""

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # files

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """(number, folder) of the versions whose pointer is complete, oldest first."""
        path, fs = self._fs()
        if not fs.exists(path(self.path)):
            return []
        found = []
        for status in fs.listStatus(path(self.path)):
            m = re.fullmatch(rf"{name}\.(\d+)\.([0-9a-f]+)\.current", status.getPath().getName())
            if m:
                found.append((int(m[1]), f"{name}-{m[2]}"))
        return sorted(found)

    def _version(self, name: str) -> str | None:
        found = self._versions(name)
        return found[-1][1] if found else None

    def _save(self, name: str, df: DataFrame) -> None:
        """Write a new version, then its pointer: an empty file whose name says all, so there is no half-written one.

        Readers of the version before are not disturbed; versions older than ``KEPT`` are deleted.
        """
        mark = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}-{mark}")
        found = self._versions(name)
        path, fs = self._fs()
        number = found[-1][0] + 1 if found else 1
        fs.create(path(f"{self.path}/{name}.{number}.{mark}.current"), False).close()
        for old, folder in found[: max(0, len(found) + 1 - KEPT)]:
            fs.delete(path(f"{self.path}/{name}.{old}.{folder.rsplit('-', 1)[1]}.current"), False)
            fs.delete(path(f"{self.path}/{folder}"), True)

    def _arrived(self, df: DataFrame) -> DataFrame:
        """Incoming rows with ``seq``, their order of arrival, written down so that a retry does not change it."""
        return materialize(df if "seq" in df.columns else df.withColumn("seq", F.monotonically_increasing_id()), "arrived")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{self._version(name)}")

    @property
    def memory(self) -> DataFrame:
        return self.table("memory")

    @property
    def glossary(self) -> DataFrame:
        return self.table("glossary")

    @property
    def rules(self) -> DataFrame:
        return self.table("rules")

    # records

    def append(self, records: DataFrame) -> None:
        """Add all records, repeats included."""
        self._save("memory", up.append(self.memory, records))

    def upsert(self, records: DataFrame, by: str = "") -> dict[str, int]:
        """Merge (source, target) pairs; returns added, updated and total."""
        rows = self._arrived(records)
        pairs = up.merged_pairs(self.memory, rows)
        counts = up.tallies(pairs).first().asDict()
        self._save("memory", up.upsert(self.memory, rows, by=by))
        return counts

    def update(self, changes: DataFrame) -> None:
        self._save("memory", up.update(self.memory, changes))

    def delete(self, ids: DataFrame) -> None:
        self._save("memory", up.delete(self.memory, ids))

    def get(self, record_id: int) -> DataFrame:
        return self.memory.filter(F.col("id") == record_id)

    def count(self) -> int:
        return self.memory.count()

    def clear(self, name: str = "memory") -> None:
        self._save(name, self.spark.createDataFrame([], TABLES[name]))

    def replace_all(self, name: str, df: DataFrame) -> None:
        """Overwrite a table; missing columns are null, forms are made anew where they are missing."""
        cols = self.spark.createDataFrame([], TABLES[name]).schema
        out = df.select(*[F.col(c.name).cast(c.dataType) if c.name in df.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in cols])
        if name == "memory":
            out = out.withColumns({"source_cmp": F.coalesce("source_cmp", C.make_cmp("source")), "target_cmp": F.coalesce("target_cmp", C.make_cmp("target"))})
            out = out.withColumn("source_len", F.coalesce("source_len", F.length("source_cmp")))
        self._save(name, out)

    # glossary and rules

    def add_terms(self, terms: DataFrame) -> dict[str, int]:
        rows = self._arrived(terms)
        done = up.add_terms(self.glossary, rows)
        counts = {r["action"]: r["count"] for r in done.groupBy("action").count().collect()}
        top = self.glossary.agg(F.max("id")).first()[0] or 0
        fresh = up.numbered(done.filter(F.col("action") == up.ADDED).drop("action"), int(top), ["term", "translation"])
        cols = self.glossary.schema
        self._save("glossary", self.glossary.unionByName(fresh.select(*[F.col(c.name).cast(c.dataType) if c.name in fresh.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in cols])))
        return {"added": counts.get(up.ADDED, 0), "exists": counts.get(up.EXISTS, 0)}

    def add_rules(self, rules: DataFrame) -> dict[str, int]:
        """source_pattern, target_template: invalid patterns and repeats are counted and left out."""
        top = self.rules.agg(F.max("rule_id")).first()[0] or 0
        fresh = up.numbered(rules.select("source_pattern", "target_template"), int(top)).withColumnRenamed("id", "rule_id")
        both = self.rules.unionByName(fresh.select(F.col("rule_id").cast("int").alias("rule_id"), "source_pattern", "target_template", F.lit(True).alias("enabled")))
        checked = up.valid_rules(both).filter(F.col("rule_id") > top)
        keep = checked.filter("valid AND NOT repeat").drop("valid", "repeat")
        counts = checked.agg(F.count_if(F.expr("valid AND NOT repeat")).alias("added"), F.count_if(F.expr("NOT valid")).alias("invalid"), F.count_if(F.expr("valid AND repeat")).alias("exists")).first().asDict()
        self._save("rules", self.rules.unionByName(keep))
        return counts

    def enable_rule(self, rule_id: int, enabled: bool) -> None:
        self._save("rules", self.rules.withColumn("enabled", F.when(F.col("rule_id") == rule_id, enabled).otherwise(F.col("enabled"))))

    def delete_rule(self, rule_id: int) -> None:
        self._save("rules", self.rules.filter(F.col("rule_id") != rule_id))

    # settings

    def meta(self, key: str, default: str | None = None) -> str | None:
        row = self.table("meta").filter(F.col("key") == key).select("value").first()
        return row["value"] if row else default

    def set_meta(self, **values: str) -> None:
        old = self.table("meta").filter(~F.col("key").isin(*values))
        self._save("meta", old.unionByName(self.spark.createDataFrame([(k, str(v)) for k, v in values.items()], schema.META)))
