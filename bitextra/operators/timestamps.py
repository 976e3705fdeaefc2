"""One UTC instant for values written in many notations.

``with_interpretations`` turns a string column into the array of all instants it may name (Column expressions only).
``resolve_instants`` picks one per value: a Viterbi pass over each group's rows in arrival order.  Its hidden state is the
chosen reading and the order in which the group writes slash dates at that point; it charges a switch of that order, a
step back in time between neighbours, an instant after the record's arrival, and what speaks against a reading by itself.
A declared order is a prior: what contradicts it costs a little at every value and more at the start, so that one
sequence of values may outweigh it, and a single neighbour may not.

The rows are range-partitioned by (group, arrival, id), so a group of any size is spread over many tasks of bounded
size.  Only rows with a choice, slash dates and the ends of a run are steps of the pass; all others have one instant and
charge their neighbours.  Each task condenses its runs into a small cost matrix between the states of their first and last
row; the matrices of all tasks (at most two runs a partition and field) are chained on the driver, and every task then
decodes its own rows with the ends fixed.  The result equals one pass over the whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextra.scratch import checkpoint, materialize

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"

#: fixed values: hours east of UTC of zone abbreviations with one common meaning
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "HKT": 8, "SGT": 8, "JST": 9, "KST": 9, "AWST": 8, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11,
    "NZST": 12, "NZDT": 13, "EST": -5, "EDT": -4, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
    "AKST": -9, "AKDT": -8, "HST": -10,
}
#: fixed values: abbreviations with several meanings, and the zones where each holds
AMBIGUOUS = {
    "CST": ((8, "Asia/(Shanghai|Taipei|Macau|Chongqing|Harbin)"), (-6, "America/.*|US/.*")),
    "IST": ((5.5, "Asia/(Kolkata|Calcutta)"), (1, "Europe/Dublin"), (2, "Asia/(Jerusalem|Tel_Aviv)")),
    "BST": ((1, "Europe/.*|GB"), (6, "Asia/Dhaka"), (11, "Pacific/Bougainville")),
}

#: cost of a slash date read against the declared order; of starting in the other order; of a switch of the order
CONTRARY, START, SWITCH = 0.25, 12.0, 12.0
#: cost of a step back in time between neighbours, and of an instant more than a day after the arrival
BACK, AHEAD = 1.0, 1.0
#: rows of a task, about
ROWS = 500_000

_TIME = r"\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?"
_HALF = r"([AaPp][Mm]|上午|下午|午前|午後|오전|오후)"
_ZONE = r"(Z|z|[A-Za-z]{1,5}([+-]\d{4})?|[+-]\d{2}(:?\d{2})?)(\[[^\]]*\]|\s*\([^)]*\))?"
_TAIL = rf"([T ] ?({_HALF} ?)?{_TIME}( ?{_HALF})?( ?{_ZONE})?)?"
_CJK_TIME = r"( ?\d{1,2}[時时시点] ?(\d{1,2}[分분] ?(\d{1,2}[秒초])?)?)"
_FAMILIES = (
    ("iso", rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{_TAIL}$"),
    ("compact", r"^\d{8}T\d{6}(Z|[+-]\d{2}:?\d{2})?$"),
    ("serial", r"^\d{5}(\.\d+)?$"),
    ("epoch", r"^(\d{10}|\d{13}|\d{16})$"),
    ("dot", rf"^\d{{1,2}}\. ?\d{{1,2}}\. ?\d{{4}}{_TAIL}$"),
    ("ymd", rf"^\d{{4}}([./]|年|년) ?\d{{1,2}}([./]|月|월) ?\d{{1,2}}([./]|日|일)?({_CJK_TIME}|{_TAIL})$"),
    ("slash", rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_TAIL}$"),
    ("rfc", rf"^([A-Za-z]{{3,9}},? )?\d{{1,2}} [A-Za-z]{{3,9}} \d{{4}}{_TAIL}$"),
    ("long", rf"^([A-Za-z]{{3,9}},? )?[A-Za-z]{{3,9}} \d{{1,2}},? \d{{4}},?{_TAIL}$"),
)
#: codes of notations, as the sequence step compares them
FORMATS = {f: i for i, (f, _) in enumerate(_FAMILIES)} | {"slash_mdy": 20, "slash_dmy": 21}
_DAY = 86_400_000_000


def _utc(wall: Column, tz: Column) -> Column:
    """Wall-clock microseconds to UTC: a repeated hour is its first pass, a skipped one keeps the earlier offset."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), tz))


def with_interpretations(df: DataFrame, value: str, out: str, tz: Column, date_order: Column) -> DataFrame:
    """Add ``out``, all instants that ``value`` may name: array<struct<us: bigint, fmt: int, cost: double>>.

    Null, blank and unreadable values give an empty array.  ``tz`` is used where the value has no zone (UTC if it is
    null), ``date_order`` ('mdy' or 'dmy') tells how slash dates with the year last are meant.  The steps are
    separate projections, so that each part is computed once a value.
    """
    p = {k: f"__{out}_{k}" for k in ("v", "f", "n", "tz", "o", "half", "mon", "zone", "y", "m", "d", "h", "mi", "s", "clock", "w", "w2", "off")}
    c = {k: F.col(x) for k, x in p.items()}
    v, f, n, zone, wall, off = c["v"], c["f"], c["n"], c["zone"], c["w"], c["off"]

    def stage(frame: DataFrame, **cols: Column) -> DataFrame:
        return frame.withColumns({p[k]: x for k, x in cols.items()})

    df = stage(df, v=F.trim(F.translate(F.col(value), "０１２３４５６７８９：／．－", "0123456789:/.-")), tz=F.coalesce(tz, F.lit("UTC")), o=F.coalesce(date_order, F.lit("")))
    family = F.lit(None).cast("string")
    for name, pattern in reversed(_FAMILIES):
        family = F.when(v.rlike(pattern), name).otherwise(family)
    df = stage(df, f=family)

    end = r"\d{2}(?:[.,]\d+)? ?(Z|z|[A-Za-z]{1,5}(?:[+-]\d{4})?|[+-]\d{2}(?::?\d{2})?)(?:\[[^\]]*\]|\s*\([^)]*\))?$"
    df = stage(
        df,
        n=F.when(f.isNotNull(), F.regexp_extract_all(v, F.lit(r"\d+"), 0)),
        half=F.lower(F.regexp_extract(v, _HALF, 1)),
        mon=F.when(f.isin("rfc", "long"), F.regexp_extract(v, r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? ", 1)),
        zone=F.when(v.rlike(r":\d{2}") | (f == "compact"), F.upper(F.regexp_extract(v, end, 1))),
    )

    def num(i: int | Column) -> Column:
        return F.try_element_at(n, i if isinstance(i, Column) else F.lit(i)).try_cast("int")

    def cut(i: int, k: int) -> Column:
        return F.substring(v, i, k).try_cast("int")

    named, packed, first = c["mon"].isNotNull(), f == "compact", F.when(c["mon"].isNotNull(), 3).otherwise(4)
    has_time, has_s = v.rlike(r"\d(:\d{2}|[時时시点])"), v.rlike(r":\d{2}:\d{2}|[秒초]")
    df = stage(
        df,
        y=F.when(packed, cut(1, 4)).when(f.isin("iso", "ymd"), num(1)).when(named, num(2)).otherwise(num(3)),
        m=F.when(packed, cut(5, 2)).when(named, F.floor((F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), F.initcap(c["mon"])) + 2) / 3).cast("int")).when(f == "slash", num(1)).otherwise(num(2)),
        d=F.when(packed, cut(7, 2)).when(f.isin("iso", "ymd"), num(3)).when(f == "slash", num(2)).otherwise(num(1)),
        h=F.when(packed, cut(10, 2)).when(has_time, num(first)),
        mi=F.when(packed, cut(12, 2)).when(has_time, F.coalesce(num(first + 1), F.lit(0))),
        s=F.when(packed, cut(14, 2)).when(has_s, F.coalesce(num(first + 2), F.lit(0))).when(has_time, 0),
        zone=F.when(zone.isin("AM", "PM"), "").otherwise(F.coalesce(zone, F.lit(""))),
    )
    hour = (
        F.when(c["half"].isin("pm", "下午", "午後", "오후") & (c["h"] < 12), c["h"] + 12)
        .when(c["half"].isin("am", "上午", "午前", "오전") & (c["h"] == 12), 0)
        .otherwise(c["h"])
    )
    frac = F.rpad(F.substring(F.regexp_extract(v, r":\d{2}[.,](\d+)", 1), 1, 6), 6, "0").cast("bigint")
    digits = F.regexp_extract(zone, r"[+-](\d{2}):?\d{0,2}$", 1)
    fixed = F.create_map(*[F.lit(x) for k, h in ABBREVIATIONS.items() for x in (k, int(h * 3600))])
    signed = F.when(zone.contains("-"), -1).otherwise(1) * (
        digits.try_cast("int") * 3600 + F.coalesce(F.regexp_extract(zone, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0)) * 60
    )
    df = stage(
        df,
        clock=F.when((hour < 24) & (c["mi"] < 60), (hour * 3600 + c["mi"] * 60 + c["s"]).cast("bigint") * 1_000_000 + F.when(v.rlike(r":\d{2}[.,]\d"), frac).otherwise(F.lit(0)))
        .when(c["h"].isNull() & ~packed, F.lit(0).cast("bigint")),
        off=F.when(digits != "", signed).otherwise(F.try_element_at(fixed, zone)).cast("bigint") * 1_000_000,
    )

    def at(month: Column, day: Column) -> Column:
        date = F.try_make_timestamp_ntz(c["y"], month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return F.unix_date(date).cast("bigint") * _DAY + c["clock"]

    days = F.when(f == "serial", v.try_cast("decimal(20,12)"))
    df = stage(df, w=F.when(f == "serial", F.round(days * 86400, 0).cast("bigint") * 1_000_000 - 25_569 * _DAY).when(f != "epoch", at(c["m"], c["d"])), w2=F.when(f == "slash", at(c["d"], c["m"])))

    def reading(us: Column, fmt: Column, cost: Column) -> Column:
        return F.struct(us.cast("bigint").alias("us"), fmt.cast("int").alias("fmt"), cost.cast("double").alias("cost"))

    def zoned(w: Column, fmt: Column, cost: Column) -> list[Column]:
        known = reading(F.when(off.isNotNull(), w - off).when(zone == "", _utc(w, c["tz"])), fmt, cost)
        several = [
            reading(F.when(zone == name, w - int(h * 3600) * 1_000_000), fmt, cost + F.when(c["tz"].rlike(f"^({where})$"), 0.0).otherwise(2.0 + i))
            for name, means in AMBIGUOUS.items() for i, (h, where) in enumerate(means)
        ]
        return [known, *several]

    def contrary(o: str) -> Column:
        return F.when(c["o"] == o, 0.0).when(c["o"].isin("mdy", "dmy"), CONTRARY).otherwise(0.0 if o == "mdy" else 0.01)

    code = F.lit(-1)
    for k, x in FORMATS.items():
        code = F.when(f == k, x).otherwise(code)
    factor = F.when(F.length(v) == 10, 1_000_000).when(F.length(v) == 13, 1_000).otherwise(1)
    readings = (
        F.when(f == "epoch", F.array(reading(v.try_cast("bigint") * factor, code, F.lit(0.0))))
        .when(f == "slash", F.array(*zoned(wall, F.lit(FORMATS["slash_mdy"]), contrary("mdy")), *zoned(c["w2"], F.lit(FORMATS["slash_dmy"]), contrary("dmy"))))
        .when(f.isNotNull(), F.array(*zoned(wall, code, F.lit(0.0))))
    )
    empty = F.array().cast("array<struct<us:bigint,fmt:int,cost:double>>")
    return df.withColumn(out, F.coalesce(F.filter(readings, lambda x: x["us"].isNotNull()), empty)).drop(*p.values())


def declared_instant(readings: Column) -> Column:
    """The cheapest reading taken by itself, or null; needs no look at neighbouring rows."""
    return F.array_min(F.transform(readings, lambda x: F.struct(x["cost"].alias("cost"), x["us"].alias("us"))))["us"]


#: states of a step: instants, slash order in force (0 mdy, 1 dmy), costs, place of the reading, and whether it follows the step before directly
Step = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]


def _between(us0: np.ndarray, o0: np.ndarray, us1: np.ndarray, o1: np.ndarray, adjacent: bool) -> np.ndarray:
    """Costs between the states of two steps."""
    out = SWITCH * (o0[:, None] != o1[None, :])
    return out + BACK * (us1[None, :] < us0[:, None]) if adjacent else out


def chain(steps: list[Step], first: int | None = None, last: int | None = None) -> list[int]:
    """Cheapest choice of one state a step; ``first`` and ``last`` fix the ends."""
    score = steps[0][2].astype(float).copy()
    if first is not None:
        score[np.arange(len(score)) != first] = np.inf
    back = []
    for x, y in zip(steps, steps[1:]):
        t = score[:, None] + _between(x[0], x[1], y[0], y[1], y[4])
        back.append(t.argmin(0))
        score = t.min(0) + y[2]
    at = int(score.argmin()) if last is None else last
    out = [at]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


def matrix(steps: list[Step]) -> np.ndarray:
    """Least cost between each state of the first step and each of the last, ends included."""
    m = np.where(np.eye(len(steps[0][2]), dtype=bool), steps[0][2][None, :], np.inf)
    for x, y in zip(steps, steps[1:]):
        m = (m[:, :, None] + _between(x[0], x[1], y[0], y[1], y[4])[None]).min(1) + y[2][None]
    return m


def _start(orders: np.ndarray, declared: int) -> np.ndarray:
    return START * ((orders != declared) & (declared >= 0))


class _Column:
    """The readings of one field of a batch as flat arrays."""

    def __init__(self, col: pa.ListArray):
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        self.at = np.asarray(col.offsets)
        flat = col.values
        self.us, self.fmt, self.cost = (np.asarray(flat.field(k)) for k in ("us", "fmt", "cost"))
        self.n = np.diff(self.at)

    def steps(self, a: int, b: int) -> tuple[list[Step], np.ndarray]:
        """The steps of rows a to b, and their rows: slash dates, rows with a choice, and the first and last with a reading."""
        idx = np.flatnonzero(self.n[a:b]) + a
        if not len(idx):
            return [], idx
        at, n = self.at[idx], self.n[idx]
        slash = self.fmt[at] >= FORMATS["slash_mdy"]
        live = slash | (n > 1)
        live[[0, -1]] = True
        us = self.us[at]
        out = []
        for k in np.flatnonzero(live):
            s = slice(at[k], at[k] + n[k])
            own, cost, place = self.us[s], self.cost[s].astype(float), np.arange(n[k])
            if k and not live[k - 1]:
                cost = cost + BACK * (own < us[k - 1])
            if k + 1 < len(idx) and not live[k + 1]:
                cost = cost + BACK * (us[k + 1] < own)
            if slash[k]:
                order = self.fmt[s] - FORMATS["slash_mdy"]
            else:  # the order in force goes on past the row
                own, cost, place, order = np.tile(own, 2), np.tile(cost, 2), np.tile(place, 2), np.repeat([0, 1], n[k])
            out.append((own, order, cost, place, bool(k and live[k - 1])))
        return out, idx[live]


def _runs(group: pa.ChunkedArray) -> list[tuple[object, int, int]]:
    values = group.to_pylist() if len(group) < 2 else None
    if values is not None:
        return [(values[0], 0, 1)] if values else []
    codes = group.combine_chunks().dictionary_encode()
    idx = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(idx)) + 1).tolist(), len(idx)]
    return [(None if idx[a] < 0 else codes.dictionary[int(idx[a])].as_py(), a, b) for a, b in zip(cuts, cuts[1:])]


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = list(batches)
    return pa.Table.from_batches(got) if got else None


def resolve_instants(
    df: DataFrame, id_col: str, group_col: str, arrival: list[str], fields: dict[str, tuple[str, Column, Column]],
    wanted: dict[str, Column] | None = None, arrived: Column | None = None,
) -> DataFrame:
    """One row per record and field with its chosen instant: id, field, utc_us.

    ``fields`` maps a name to its string column, zone and date order (as in ``with_interpretations``); records are ordered by ``arrival`` inside ``group_col``.
    ``wanted`` limits what is returned, not what takes part in the choice; ``arrived`` are microseconds since 1970 (UTC).
    Values without a reading give a row with null ``utc_us``.  Rows with a null group form a group of their own.
    An empty table gives an empty result.
    """
    names = list(fields)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS + 1)
    raw = df.repartitionByRange(parts, *[F.col(c) for c in (group_col, *arrival, id_col)]).sortWithinPartitions(group_col, *arrival, id_col)
    for name, (value, tz, order) in fields.items():
        raw = with_interpretations(raw, value, f"r_{name}", tz, order)
        if arrived is not None:
            late = lambda x: F.when(x["us"] > arrived + _DAY, AHEAD).otherwise(0.0)
            raw = raw.withColumn(f"r_{name}", F.transform(f"r_{name}", lambda x: F.struct(x["us"].alias("us"), x["fmt"].alias("fmt"), (x["cost"] + late(x)).alias("cost"))))
    cols = [F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), *[F.col(f"r_{k}") for k in names]]
    cols += [F.coalesce((wanted or {}).get(k, F.lit(True)), F.lit(False)).alias(f"w_{k}") for k in names]
    cols += [F.when(o == "mdy", 0).when(o == "dmy", 1).otherwise(-1).alias(f"o_{k}") for k, (_, _, o) in fields.items()]
    rows = checkpoint(raw.select(*cols))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, out = _table(batches), TaskContext.get().partitionId(), []
        runs = _runs(t["grp"]) if t is not None else []
        for name in names if runs else ():
            col = _Column(t[f"r_{name}"])
            for k, (grp, a, b) in enumerate(runs):
                if 0 < k < len(runs) - 1:
                    continue
                seq, _ = col.steps(a, b)
                if seq:
                    out.append((name, grp, part, t[f"o_{name}"][a].as_py(), *(x.tolist() for x in (*seq[0][:2], *seq[-1][:2], matrix(seq).ravel()))))
        schema = pa.schema([("field", pa.string()), ("grp", pa.string()), ("part", pa.int32()), ("declared", pa.int32()), ("u0", pa.list_(pa.int64())), ("o0", pa.list_(pa.int32())), ("u1", pa.list_(pa.int64())), ("o1", pa.list_(pa.int32())), ("m", pa.list_(pa.float64()))])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], s.type) for i, s in enumerate(schema)], schema=schema)

    # at most two rows a partition and field, so its size is that of the plan, not of the data
    got = rows.mapInArrow(edges, "field string, grp string, part int, declared int, u0 array<bigint>, o0 array<int>, u1 array<bigint>, o1 array<int>, m array<double>").collect()
    ends = df.sparkSession.sparkContext.broadcast(_chain_runs(got))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = _table(batches), TaskContext.get().partitionId()
        if t is None:
            return
        runs = _runs(t["grp"])
        for name in names:
            col = _Column(t[f"r_{name}"])
            pick = col.at[:-1].copy()
            for grp, a, b in runs:
                seq, at = col.steps(a, b)
                if not (col.n[at] > 1).any():
                    continue
                first, last = ends.value.get((name, grp, part), (None, None))
                if first is None:
                    seq[0] = (*seq[0][:2], seq[0][2] + _start(seq[0][1], t[f"o_{name}"][a].as_py()), *seq[0][3:])
                pick[at] += [int(x[3][k]) for x, k in zip(seq, chain(seq, first, last))]
            known = col.n > 0
            us = np.zeros(len(pick), np.int64)
            us[known] = col.us[pick[known]]
            out = pa.table({"id": t["id"], "field": pa.array([name] * len(us)), "utc_us": pa.array(us, mask=~known)})
            yield from out.filter(t[f"w_{name}"]).to_batches()

    id_type = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(decode, f"id {id_type}, field string, utc_us bigint")


def _chain_runs(got: list) -> dict[tuple, tuple[int, int]]:
    """The states at both ends of every run that touches a partition's edge."""
    by: dict[tuple, list] = {}
    for r in got:
        by.setdefault((r["field"], r["grp"]), []).append(r)
    ends = {}
    for key, runs in by.items():
        runs.sort(key=lambda r: r["part"])
        mats = [np.array(r["m"]).reshape(len(r["u0"]), len(r["u1"])) for r in runs]
        mats[0] = mats[0] + _start(np.array(runs[0]["o0"]), runs[0]["declared"])[:, None]
        score, back = mats[0].min(0), [(None, mats[0].argmin(0))]
        for r0, r1, m in zip(runs, runs[1:], mats[1:]):
            enter = score[:, None] + _between(*(np.array(r0[k]) for k in ("u1", "o1")), *(np.array(r1[k]) for k in ("u0", "o0")), True)
            total = enter.min(0)[:, None] + m
            back.append((enter.argmin(0), total.argmin(0)))
            score = total.min(0)
        last = int(score.argmin())
        for r, (via, start) in zip(reversed(runs), reversed(back)):
            first = int(start[last])
            ends[(*key, r["part"])] = (first, last)
            last = int(via[first]) if via is not None else 0
    return ends


def normalised_instants(records: DataFrame, memories: DataFrame, rewritten_only: bool = False, withheld: bool = False) -> DataFrame:
    """created and modified of every record as UTC microseconds: id, field, utc_us.

    ``rewritten_only`` leaves out values already in the canonical notation and values that name no instant.
    ``withheld`` leaves the declared orders aside, so that only the sequence tells them.
    Values that name no instant (null, blank, placeholder words, impossible dates) give null.  Records of an unknown
    memory are read as UTC, their slash dates as their sequence tells.  Further columns of either table are ignored.
    """
    order = F.lit(None).cast("string") if withheld else F.col("date_order")
    clock = memories.select(F.col("memory").alias("_m"), F.col("tz").alias("_tz"), order.alias("_o")).dropDuplicates(["_m"])
    r = records.select("id", "memory", "ingested", "created", "modified")
    r = r.join(clock, r["memory"] == clock["_m"], "left")
    both = ("created", "modified")
    dated = records.schema["ingested"].dataType.typeName().startswith("timestamp")
    out = resolve_instants(
        r, "id", "memory", ["ingested"],
        {k: (k, F.col("_tz"), F.col("_o")) for k in both},
        {k: ~F.coalesce(F.col(k).rlike(CANONICAL), F.lit(True)) for k in both} if rewritten_only else None,
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(records.schema["ingested"].dataType), F.col("ingested")) if dated else None,
    )
    return out.filter(F.col("utc_us").isNotNull()) if rewritten_only else out


def learned_orders(records: DataFrame, memories: DataFrame) -> DataFrame:
    """memory, field, declared, slash_dates, as_declared: slash dates with two readings, and how many are read as the memory
    declares when its declaration is withheld and only the sequence of the values tells."""
    clock = memories.filter("date_order IN ('mdy', 'dmy')").select("memory", "tz", F.col("date_order").alias("declared")).dropDuplicates(["memory"])
    long = records.select("id", "memory", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in ("created", "modified")])).alias("x"))
    long = long.select("id", "memory", "x.*").filter(F.col("value").rlike(r"^\s*\d{1,2}/\d{1,2}/\d{4}")).join(clock, "memory")
    # written down first: a filter on the readings would be pushed below the projections and repeat them
    read = with_interpretations(long, "value", "r", F.col("tz"), F.col("declared")).select("id", "memory", "field", "declared", declared_instant(F.col("r")).alias("us"), F.array_max("r.us").alias("top"), F.array_min("r.us").alias("low"))
    open_ = materialize(read, "slash-dates").filter("top > low").drop("top", "low")
    got = open_.join(normalised_instants(records, memories, withheld=True), ["id", "field"])
    return got.groupBy("memory", "field", "declared").agg(F.count(F.lit(1)).alias("slash_dates"), F.count_if(F.col("us") == F.col("utc_us")).alias("as_declared"))
