"""Near-duplicate records: pairs whose sources and whose targets are both alike.

Likeness is the Jaccard index of the sets of three-character runs of the bare forms.  The search is multi-index
hashing over a fingerprint of min-hash symbols:

1. Each distinct (bare source, bare target) gets 36 one-byte min-hash symbols, half from either side, in 6 segments
   of 6 symbols, and 256 one-bit min-hashes; both together are its fingerprint.
2. Within each segment the Hamming ball of radius one (over symbols) is enumerated as its six neighbourhoods with
   one symbol left open; equal keys in one table are what the ball probes would fetch.
3. Pairs fetched from a table are compared by the fine part of the fingerprint, inside the join.
4. What is left is verified by the complete distance: all symbols and bits in which the two fingerprints differ.
5. The exact likeness of both sides decides.

A key that many texts share is cut into blocks that meet pair by pair in tasks of their own.  Texts that occur many
times are represented once; copies are put back at the end, or left as classes (``record_links``) and connected into
groups (``record_groups``).  At likeness 0.7 on both sides (the worst case) a segment is hit with probability 0.42 and a
pair with 0.96 (measured recall by likeness is in the README).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextra.functions.forms import bare, has_letter
from bitextra.llm.hashing import hash128
from bitextra.scratch import materialize

THRESHOLD, MIN_CHARS = 0.7, 30
SEGMENTS, SYMBOLS = 6, 6
#: bits of the sketch, half from either side, in words of 64
SKETCH = 256
WORDS = [f"b{i}" for i in range(SKETCH // 64)]
#: expected distance of the sketches at likeness 0.7 on both sides is 38.4 with deviation 5.7: 60 loses 1 pair in 7,000
#: there; at 0.4, where most chance hits are, it is 77 with 7.3.  A shorter sketch needs a bound that loses pairs to
#: leave as few chance hits
MAX_BITS = 60
#: the complete distance counts the 36 symbols and 256 bits that differ: 49.2 expected at 0.7, deviation 6.3, of which
#: 72 loses 1 pair in 5,000; at 0.4 it is 98
MAX_DISTANCE = 72
#: texts of a key from which it is split, if they are also more than this share of all; one text in SAMPLE is counted to
#: find such keys, which decides how the work is cut and nothing else
HOT, HOT_SHARE, SAMPLE = 2_000, 1 / 2_000, 64
_ROWS = 1024


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**32, n, np.uint32) | np.uint32(1), r.integers(0, 2**32, n, np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all three-character runs of ``texts`` (each of three or more), and where each text's begin."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(length)
    runs = _mix(points[:-2] * np.uint32(0x9E3779B1) + _mix(points[1:-1] * np.uint32(0x85EBCA77) + _mix(points[2:])))
    keep = np.ones(len(runs), bool)
    for back in (1, 2):
        at = ends - back
        keep[at[at < len(runs)]] = False
    return runs[keep], np.concatenate([[0], np.cumsum(length - 2)[:-1]])


def minima(texts: list[str], n: int, seed: int) -> np.ndarray:
    """n min-hash values a text, as uint32 of shape (n, texts)."""
    mul, add = _constants(n, seed)
    out = np.empty((n, len(texts)), np.uint32)
    for lo in range(0, len(texts), _ROWS):
        runs, starts = shingles(texts[lo : lo + _ROWS])
        work = np.empty_like(runs)
        for k in range(n):
            np.multiply(runs, mul[k], out=work)
            work += add[k]
            out[k, lo : lo + _ROWS] = np.minimum.reduceat(work, starts)
    return out


def fingerprints(sources: list[str], targets: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Segments (48 bits each) and the 64-bit words of the sketch."""
    half = SYMBOLS // 2
    sides = []
    for seed, texts in ((1, sources), (1, targets)):
        m = _mix(minima(texts, SEGMENTS * half + SKETCH // 2, seed))
        sides.append(((m[: SEGMENTS * half] >> np.uint32(24)).astype(np.int64), (m[SEGMENTS * half :] & np.uint32(1)).astype(np.uint64)))
    segments = []
    for s in range(SEGMENTS):
        code = np.zeros(len(sources), np.int64)
        for symbols, _ in sides:
            for k in range(half):
                code = (code << 8) | symbols[s * half + k]
        segments.append(code)
    shift = np.arange(64, dtype=np.uint64)[:, None]
    words = [bits[k : k + 64] for _, bits in sides for k in range(0, SKETCH // 2, 64)]
    return segments, [(bits << shift).sum(0, dtype=np.uint64).view(np.int64) for bits in words]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            segments, sketch = fingerprints(b["s"].to_pylist(), b["t"].to_pylist())
            cols = [b["id"], b["h1"], b["h2"], b["lettered"], *map(pa.array, segments), *map(pa.array, sketch)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "h1", "h2", "lettered", *[f"g{i}" for i in range(SEGMENTS)], *WORDS])


def eligible(records: DataFrame) -> DataFrame:
    """id, s, t: bare forms of the records whose two bare forms both have enough characters; nulls have none."""
    texts = records.select("id", bare("source").alias("s"), bare("target").alias("t"))
    return texts.filter((F.length("s") >= MIN_CHARS) & (F.length("t") >= MIN_CHARS))


def ball_keys() -> Column:
    """All strings within one symbol of each segment, as segments with one symbol open and their place in the top bits."""
    keys = []
    for s in range(SEGMENTS):
        for p in range(SYMBOLS):
            open_mask = ~(0xFF << (8 * p)) & 0xFFFFFFFFFFFF
            keys.append(F.col(f"g{s}").bitwiseAND(F.lit(open_mask)).bitwiseOR(F.lit((s * SYMBOLS + p) << 48)))
    return F.explode(F.array(*keys))


def likeness(a: str, b: str) -> float:
    """Jaccard index of the sets of three-character runs; 0 if neither has any."""
    x, y = ({v[i : i + 3] for i in range(len(v) - 2)} for v in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if both else 0.0


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, set[str]] = {}

    def runs(v: str) -> set[str]:
        if v not in kept:
            if len(kept) > 4096:
                kept.clear()
            kept[v] = {v[i : i + 3] for i in range(len(v) - 2)}
        return kept[v]

    def enough(v: str, w: str) -> bool:
        if v == w:
            return True
        x, y = runs(v), runs(w)
        if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
            return False
        both = len(x & y)
        return both >= THRESHOLD * (len(x) + len(y) - both)

    for b in batches:
        s1, t1, s2, t2 = (b[k].to_pylist() for k in ("s1", "t1", "s2", "t2"))
        ok = [enough(p, q) and enough(u, v) for p, q, u, v in zip(s1, s2, t1, t2)]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _fine(one: str, two: str) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(f"{one}{w}").bitwiseXOR(F.col(f"{two}{w}"))) for w in WORDS])


def _symbols(one: str, two: str) -> Column:
    """How many of the symbols of two fingerprints differ: bytes of the difference that are not zero."""
    out = F.lit(0)
    for i in range(SEGMENTS):
        x = F.col(f"{one}g{i}").bitwiseXOR(F.col(f"{two}g{i}"))
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftright(x, k))
        out = out + F.bit_count(x.bitwiseAND(F.lit(0x010101010101)))
    return out


def _hot_keys(keys: DataFrame, texts: int) -> DataFrame:
    """key, blocks of the keys to split: at most SEGMENTS * SYMBOLS / HOT_SHARE of them at any size, so they may be broadcast."""
    least = max(HOT, int(texts * HOT_SHARE))
    some = keys.filter(F.pmod(F.xxhash64(F.lit("sample"), "rep"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return materialize(some.filter(F.col("n") * SAMPLE >= least).select("key", F.ceil(F.col("n") * SAMPLE / least).cast("int").alias("blocks")), "hot-keys")


def candidates(classes: DataFrame) -> DataFrame:
    """a, b (a < b): class representatives whose fingerprints share a ball key and are within the complete distance."""
    keys = classes.select(ball_keys().alias("key"), "rep", *WORDS)
    hot = _hot_keys(keys, classes.count())
    cold = keys.join(F.broadcast(hot.select("key")), "key", "left_anti")
    split = keys.join(F.broadcast(hot), "key").withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    close = (F.col("l.rep") < F.col("r.rep")) & (_fine("l.", "r.") <= MAX_BITS)

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        same = reduce(Column.__and__, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on])
        return left.alias("l").join(right.alias("r"), same & close).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))

    rows = ["key", "rep", *WORDS]
    blocks = met(split.select(*rows, F.col("own").alias("i"), other.alias("j")), split.select(*rows, F.col("own").alias("j"), other.alias("i")), ["key", "i", "j"])
    fetched = met(cold, cold, ["key"]).unionByName(blocks).distinct()
    prints = [f"g{i}" for i in range(SEGMENTS)] + WORDS
    for end in "ab":
        fetched = fetched.join(classes.select(F.col("rep").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in prints]), end)
    return fetched.filter(_symbols("a_", "b_") + _fine("a_", "b_") <= MAX_DISTANCE).select("a", "b")


def _classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    h1, h2 = hash128(F.col("s"), F.col("t"))
    texts = eligible(records).select("id", h1.alias("h1"), h2.alias("h2"), (has_letter("s") & has_letter("t")).alias("lettered"), "s", "t")
    id_type = records.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, h1 bigint, h2 bigint, lettered boolean, " + ", ".join(f"{c} bigint" for c in (*[f"g{i}" for i in range(SEGMENTS)], *WORDS))
    prints = materialize(texts.mapInArrow(_fingerprint_batches, schema), "fingerprints")
    rest = ["lettered", *[f"g{i}" for i in range(SEGMENTS)], *WORDS]
    classes = prints.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in rest])
    return prints.select("id", "h1", "h2"), materialize(classes, "classes")


def _linked(records: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: representatives of different texts that are alike on both sides and no crosswise copies."""
    texts = eligible(records)
    one = texts.select(F.col("id").alias("a"), F.col("s").alias("s1"), F.col("t").alias("t1"))
    two = texts.select(F.col("id").alias("b"), F.col("s").alias("s2"), F.col("t").alias("t2"))
    pairs = candidates(classes).join(one, "a").join(two, "b").select("a", "b", "s1", "t1", "s2", "t2")
    crossed = (F.col("s1") == F.col("t2")) & (F.col("t1") == F.col("s2")) & has_letter("s1") & has_letter("t1")
    id_type = records.schema["id"].dataType.simpleString()
    return pairs.filter(~crossed).mapInArrow(_alike, f"a {id_type}, b {id_type}")


def similar_records(records: DataFrame) -> DataFrame:
    """id_a, id_b (id_a < id_b) of all near-duplicate records that are not copies of one another.

    Records with a null text or fewer than 30 bare characters on a side take no part.  Copies (equal bare texts) are
    compared once; the result still names each record.  Letterless equal texts are no copies and pair up.
    """
    prints, classes = _classes(records)
    linked = _linked(records, classes)
    letterless = classes.filter(~F.col("lettered") & (F.col("n") > 1)).select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    member = prints.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "id")
    x = member.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    y = member.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    same = F.col("a") == F.col("b")
    out = linked.unionByName(letterless).join(x, "a").join(y, "b").filter(~same | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def record_links(records: DataFrame) -> DataFrame:
    """One row per record that takes part: id, class_id (least id of equal texts), links (different texts alike)."""
    prints, classes = _classes(records)
    linked = _linked(records, classes)
    ends = linked.select(F.col("a").alias("rep")).unionAll(linked.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    member = prints.join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
    return member.join(degree, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) of the nodes of the undirected ``edges`` (a, b).

    Alternating large and small stars: each round ties neighbours to the least they know, by joins and partial
    aggregation, and the number of rounds grows with the logarithm of the longest path.  Edges stay in the shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small stars: what a node is tied to is tied to the least of it
        large = materialize(large.distinct(), "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        tied = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = materialize(tied.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def record_groups(records: DataFrame) -> DataFrame:
    """One row per record that takes part: id, class_id (least id of equal texts), group_id (least class of all that are connected by likeness)."""
    prints, classes = _classes(records)
    roots = components(_linked(records, classes))
    member = prints.join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
    return member.join(roots, F.col("rep") == F.col("node"), "left").select("id", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"))
