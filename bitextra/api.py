"""One object for a memory in a folder: search, import, export, records and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import bitextra
from bitextra.operators import checks, lookup, planner
from bitextra.operators import placement as place
from bitextra.operators import replace as snr
from bitextra.sources.datasource import read_memory, write_memory
from bitextra.store import Store


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        bitextra.ship(spark)
        self.spark, self.store = spark, Store.open(spark, path)

    def queries(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts, 1)), "query_id bigint, query string")

    def search(self, text: str, kind: str = "fuzzy", least: float = 0.7) -> DataFrame:
        return lookup.search(self.queries(text), self.store.memory, kind, least)

    def lookup_with_placement(self, *texts: str, least: float = 0.7) -> DataFrame:
        """The best match of each text, its target rewritten to fit."""
        q = self.queries(*texts)
        best = place.pairs_with_best(q, lookup.fuzzy_lookup(q, self.store.memory, least, k=1))
        return place.resolve(best, place.terms_of(self.store.glossary), place.rules_of(self.store.rules))

    def pretranslate(self, cells: DataFrame, least: float = 0.7, overwrite: bool = False) -> DataFrame:
        return planner.statuses(cells, self.store.memory, place.terms_of(self.store.glossary), place.rules_of(self.store.rules), least, overwrite)

    def quality(self) -> DataFrame:
        return checks.check(self.store.memory, self.store.glossary)

    def find(self, expression: str) -> DataFrame:
        return snr.find(self.store.memory, expression)

    def replace(self, old: str, new: str) -> int:
        done = snr.replace(self.store.memory, old, new)
        n = done.filter("changed").count()
        if n:
            self.store.replace_all("memory", done.drop("changed"))
        return n

    def import_file(self, path: str, fmt: str | None = None, merge: bool = False, **options: str) -> int:
        records = read_memory(self.spark, path, fmt, **options)
        before = self.store.count()
        if merge:
            self.store.upsert(records)
        else:
            self.store.append(records)
        return self.store.count() - before

    def export_file(self, path: str, fmt: str | None = None, **options: str) -> int:
        write_memory(self.store.memory, path, fmt, **options)
        return self.store.count()

    def records(self, text: str | None = None, limit: int = 100) -> DataFrame:
        """Records by id, or those whose source holds the phrase."""
        rows = lookup.phrase_concordance(self.store.memory, text).drop("score") if text else self.store.memory
        return rows.orderBy("id").limit(limit)

    def statistics(self) -> DataFrame:
        return lookup.statistics(self.store.memory, self.store.path, self.store.meta("source_lang"), self.store.meta("target_lang"))

    def browse(self, text: str, table: str = "memory", limit: int = 100) -> DataFrame:
        """Rows that hold the text in either language, regardless of case."""
        a, b = ("source", "target") if table == "memory" else ("term", "translation")
        x = F.lit(text.lower())
        return self.store.table(table).filter(F.contains(F.lower(a), x) | F.contains(F.lower(b), x)).orderBy("id").limit(limit)
