"""Streams of queries against a memory, and streams of pairs merged into one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from bitextra.functions import columns as C
from bitextra.operators import lookup
from bitextra.operators import upsert as up


def exact_stream(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """Stream-static join of a query stream (query_id, query) with the memory's records of the same form."""
    q = queries.withColumn("source_cmp", C.make_cmp("query")).filter("source_cmp <> ''")
    m = lookup.prepared(memory.select("id", "source", "target")).select("id", "source", "target", "source_cmp")
    return q.join(m, "source_cmp").drop("source_cmp")


def lookup_stream(queries: DataFrame, memory: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, least: float = 0.7) -> StreamingQuery:
    """Fuzzy lookups of each micro-batch; the memory is read anew for every batch, so changes to it are seen.

    Repeated queries of a batch are looked up once.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        texts = df.select("query").distinct().withColumn("query_id", F.col("query"))
        found = lookup.fuzzy_lookup(texts, memory(), least).withColumnRenamed("query_id", "query")
        sink(df.select("query_id", "query").join(found, "query").drop("query"), epoch)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(pairs: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of (seq, source, target) into the memory that ``load`` gives; ``save`` must be idempotent by epoch."""

    def batch(df: DataFrame, epoch: int) -> None:
        save(up.upsert(load(), df), epoch)

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(deliveries: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Each delivery once, however often it is repeated within ``late``; state older than that is dropped."""
    return deliveries.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


class PairCounts(StatefulProcessor):
    """Reference count of each (source form, target form): 0 when first seen, one more for each repeat."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        n = self.count.get()[0] if self.count.exists() else -1
        n += sum(len(r) for r in rows)
        self.count.update((n,))
        yield pd.DataFrame({"source_cmp": [key[0]], "target_cmp": [key[1]], "refcount": [n]})

    def close(self) -> None:
        pass


def counted_pairs(pairs: DataFrame) -> DataFrame:
    """Stream of reference counts by pair, kept in state; needs the RocksDB state store."""
    rows = pairs.withColumns({"source_cmp": C.make_cmp("source"), "target_cmp": C.make_cmp("target")}).filter("source_cmp <> '' AND target_cmp <> ''")
    return rows.groupBy("source_cmp", "target_cmp").transformWithStateInPandas(
        PairCounts(), outputStructType="source_cmp string, target_cmp string, refcount bigint", outputMode="Update", timeMode="None"
    )


def undo_entries(actions: DataFrame, k: int = 50) -> DataFrame:
    """The last ``k`` batches of a change log (batch_id, range, value, old_value), newest first, as values to put back."""
    last = actions.select("batch_id").distinct().orderBy(F.desc("batch_id")).limit(k)
    return actions.join(last, "batch_id").select("batch_id", "range", F.col("old_value").alias("value"))
