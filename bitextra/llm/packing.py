"""Documents in containers of fixed capacity, with little room left over.

A text longer than a container is split: its full containers stand by themselves, what remains is an item like any
other.  Items above a third of the capacity go at most two to a container, so they are matched greedily: from the
largest down, each with the largest one that still fits.  Smaller items then go, from the largest down, where they
leave the least gap.

Items are dealt by hash to blocks of about ``BLOCK_ITEMS`` items, each packed by one task; the only cost of the cut is
the last container of a block.  Texts without tokens (null or empty) have nothing to pack: one row, no container.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BLOCK_ITEMS = 20_000


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes are from 1 to ``capacity``."""
    order = np.argsort(-sizes, kind="stable")
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g is set while a container has a gap of g
    out = np.empty(len(sizes), np.int64)
    large = order[: int(np.searchsorted(-sizes[order], -(capacity // 3), side="left"))]
    small = order[len(large) :]
    bins = _match(large, sizes, capacity, out)
    for number, gap in enumerate(bins):
        by_gap[gap].append(number)
    for gap, here in enumerate(by_gap):
        if here and gap:
            gaps |= 1 << gap
    count = len(bins)
    for i, size in zip(small.tolist(), sizes[small].tolist()):
        fit = gaps >> size
        if fit:
            gap = size + (fit & -fit).bit_length() - 1
            number = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, number = capacity, count
            count += 1
        out[i] = number
        left = gap - size
        if left:
            by_gap[left].append(number)
            gaps |= 1 << left
    return out


def _match(large: np.ndarray, sizes: np.ndarray, capacity: int, out: np.ndarray) -> list[int]:
    """Pair large items, largest first with the largest that fits; the gap of each container made."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit capacity - s is set while an item of size s waits, so the lowest bit is the largest item
    for i, size in zip(large.tolist(), sizes[large].tolist()):
        waiting[size].append(i)
        present |= 1 << (capacity - size)
    gaps: list[int] = []

    def take(size: int) -> int:
        nonlocal present
        i = waiting[size].pop()
        if not waiting[size]:
            present ^= 1 << (capacity - size)
        return i

    while present:
        size = capacity - ((present & -present).bit_length() - 1)
        out[take(size)] = len(gaps)
        room = capacity - size
        fit = present >> (capacity - room) if room else 0  # items of at most ``room``
        if fit:
            mate = room - ((fit & -fit).bit_length() - 1)
            out[take(mate)] = len(gaps)
            room -= mate
        gaps.append(room)
    return gaps


def containers(sizes: DataFrame, batches: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """batch_kind, container, doc_id, piece, first_token, tokens: every piece of every document for each kind.

    ``sizes`` has doc_id and tokens; ``batches`` has batch_kind and capacity (a handful of rows; rows without a positive capacity
    are left out).  Pieces are numbered from 0 in the order of the text.
    """
    kinds = [(r["batch_kind"], r["capacity"]) for r in batches.select("batch_kind", "capacity").distinct().collect() if r["batch_kind"] is not None and (r["capacity"] or 0) > 0]
    total = sizes.filter("tokens > 0").count()
    blocks = max(1, math.ceil(total / block_items))
    id_type = sizes.schema["doc_id"].dataType.simpleString()
    spark = sizes.sparkSession
    empty = f"batch_kind string, container string, doc_id {id_type}, piece bigint, first_token bigint, tokens bigint"
    if not kinds:
        return spark.createDataFrame([], empty)
    capacity = F.create_map(*[F.lit(x) for k in kinds for x in k])
    each = sizes.select(F.explode(F.array(*[F.lit(k) for k, _ in kinds])).alias("batch_kind"), "doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("n"))
    each = each.withColumn("cap", capacity[F.col("batch_kind")].cast("bigint")).withColumn("full", F.floor(F.col("n") / F.col("cap")))
    whole = each.filter("full > 0").select("batch_kind", "doc_id", "cap", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    whole = whole.select(
        "batch_kind", F.concat_ws("-", "batch_kind", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("container"),
        "doc_id", "piece", (F.col("piece") * F.col("cap")).alias("first_token"), F.col("cap").alias("tokens"),
    )
    none = each.filter("n = 0").select("batch_kind", F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("first_token"), "n")
    rest = each.filter("n % cap > 0").select(
        "batch_kind", "cap", "doc_id", F.col("full").alias("piece"), (F.col("n") % F.col("cap")).alias("tokens"),
        F.pmod(F.xxhash64("doc_id", "n"), F.lit(blocks)).alias("block"),
    )

    def pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        kind, cap, block = pdf["batch_kind"].iloc[0], int(pdf["cap"].iloc[0]), int(pdf["block"].iloc[0])
        number = pack(pdf["tokens"].to_numpy(), cap)
        return pd.DataFrame({
            "batch_kind": kind, "container": [f"{kind}-{block}-{x}" for x in number.tolist()], "doc_id": pdf["doc_id"], "piece": pdf["piece"],
            "first_token": pdf["piece"] * cap, "tokens": pdf["tokens"],
        })

    packed = rest.groupBy("batch_kind", "block").applyInPandas(pack_block, empty)
    return packed.unionByName(whole).unionByName(none.withColumnRenamed("n", "tokens"))


def fill(packed: DataFrame, batches: DataFrame) -> DataFrame:
    """batch_kind, containers, tokens, capacity, fill: how full the containers are."""
    per = packed.filter("container IS NOT NULL").groupBy("batch_kind").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    cap = batches.select("batch_kind", F.col("capacity").cast("bigint").alias("capacity")).distinct()
    return per.join(cap, "batch_kind").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
