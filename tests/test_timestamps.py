"""Timestamp readings against the standard library, and the split Viterbi pass against one pass."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitextra.operators import timestamps as ts

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def us(*wall, tz="UTC", micro=0, offset=None):
    zone = ZoneInfo(tz) if offset is None else UTC
    at = datetime(*wall, microsecond=micro, tzinfo=zone)
    at = at.astimezone(UTC) - (timedelta(hours=offset) if offset is not None else timedelta())
    return int((at - EPOCH) / timedelta(microseconds=1))


CASES = [
    ("2013-02-01T07:07:47.981240Z", us(2013, 2, 1, 7, 7, 47, micro=981240)),
    ("2013-02-02T13:07:03.8497549Z", us(2013, 2, 2, 13, 7, 3, micro=849754)),
    ("20130201T043544Z", us(2013, 2, 1, 4, 35, 44)), ("2013-02-01 07:44:28 EST", us(2013, 2, 1, 7, 44, 28, offset=-5)),
    ("2013-02-01T11:42:32+05:30", us(2013, 2, 1, 11, 42, 32, offset=5.5)), ("2013-02-11 04:52:43+0100", us(2013, 2, 11, 4, 52, 43, offset=1)),
    ("2013-02-01T11:42:32+09", us(2013, 2, 1, 11, 42, 32, offset=9)), ("2013-02-01T11:42:32", us(2013, 2, 1, 11, 42, 32, tz="America/New_York")),
    ("2013-02-10", us(2013, 2, 10, tz="America/New_York")), ("2013-02-02 03:19", us(2013, 2, 2, 3, 19, tz="America/New_York")),
    ("1360755260627", us(2013, 2, 13, 11, 34, 20, micro=627000)), ("1359739680", us(2013, 2, 1, 17, 28)), ("1360674130352034", us(2013, 2, 12, 13, 2, 10, micro=352034)),
    ("01.02.2018 02:31:59", us(2018, 2, 1, 2, 31, 59, tz="America/New_York")), ("2018.02.01", us(2018, 2, 1, tz="America/New_York")),
    ("2013. 3. 30. 오후 12:29:43", us(2013, 3, 30, 12, 29, 43, tz="America/New_York")), ("2013/3/19 上午12:08:54", us(2013, 3, 19, 0, 8, 54, tz="America/New_York")),
    ("2013年2月19日 12時44分22秒", us(2013, 2, 19, 12, 44, 22, tz="America/New_York")), ("２０２５年１１月２０日 ９時００分００秒", us(2025, 11, 20, 9, tz="America/New_York")),
    ("Fri, 10 Jan 2020 03:10:01 +0530", us(2020, 1, 10, 3, 10, 1, offset=5.5)), ("Apr 10, 2015 1:04:28 AM", us(2015, 4, 10, 1, 4, 28, tz="America/New_York")),
    ("Fri Apr 12 2019 06:39:31 GMT+0800 (China Standard Time)", us(2019, 4, 12, 6, 39, 31, offset=8)),
    ("2013-02-17T14:52:19+01:00[Europe/Berlin]", us(2013, 2, 17, 14, 52, 19, offset=1)), ("41306.5", us(2013, 2, 1, 12, tz="America/New_York")),
    ("10/1/2015 16:15:19", us(2015, 10, 1, 16, 15, 19, tz="America/New_York")), ("2013-02-01 07:44:28 CST", us(2013, 2, 1, 7, 44, 28, offset=-6)),
    ("2024-11-03 01:30:00", us(2024, 11, 3, 1, 30, tz="America/New_York")), ("2024-03-10 02:30:00", us(2024, 3, 10, 7, 30)),
    (" 2013-02-10 ", us(2013, 2, 10, tz="America/New_York")),
    *[(x, None) for x in (None, "", " ", "-", "now", "N/A", "#REF!", "0000-00-00T00:00:00Z", "2019-13-45", "2019-02-30", "2019-02-03 25:00:00", "12", "13/13/2015", "x" * 5000)],
]


def test_readings(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "i int, v string")
    df = ts.with_interpretations(df, "v", "r", F.lit("America/New_York"), F.lit("mdy"))
    got = {r["i"]: r["at"] for r in df.select("i", ts.declared_instant(F.col("r")).alias("at")).collect()}
    assert {CASES[i][0]: at for i, at in got.items()} == dict(CASES)


def _random_steps(rng, n):
    steps = []
    for _ in range(n):
        k = rng.choice((1, 1, 2, 3))
        steps.append((np.array(sorted(rng.sample(range(50), k))), np.array([rng.randint(0, 1) for _ in range(k)]), np.array([rng.choice((0.0, 0.25, 0.5)) for _ in range(k)]), np.arange(k), True))
    return steps


def _cost(steps, pick, declared):
    total = sum(r[2][p] for r, p in zip(steps, pick)) + ts.START * (steps[0][1][pick[0]] != declared)
    for (a, p), (b, q) in zip(zip(steps, pick), zip(steps[1:], pick[1:])):
        total += ts.SWITCH * (a[1][p] != b[1][q]) + ts.BACK * (b[0][q] < a[0][p])
    return total


def test_chained_chunks_cost_as_one_pass():
    rng = random.Random(7)
    for _ in range(60):
        steps = _random_steps(rng, rng.randint(2, 40))
        declared = rng.randint(0, 1)
        start = (*steps[0][:2], steps[0][2] + ts._start(steps[0][1], declared), *steps[0][3:])
        whole = ts.chain([start, *steps[1:]])
        cut = sorted(rng.sample(range(1, len(steps)), min(3, len(steps) - 1)))
        chunks = [steps[a:b] for a, b in zip([0, *cut], [*cut, len(steps)])]
        runs = [
            {"field": "f", "grp": "g", "part": i, "declared": declared, "u0": list(c[0][0]), "o0": list(c[0][1]), "u1": list(c[-1][0]), "o1": list(c[-1][1]), "m": list(ts.matrix(c).ravel())}
            for i, c in enumerate(chunks)
        ]
        ends = ts._chain_runs(runs)
        pick = [p for i, c in enumerate(chunks) for p in ts.chain(c, *ends["f", "g", i])]
        assert _cost(steps, pick, declared) == pytest.approx(_cost(steps, whole, declared))


def test_one_task_or_many(spark):
    """The choice does not depend on how the rows are cut into tasks, and is the cheapest of all."""
    rng = random.Random(3)
    values = [f"{rng.randint(1, 12)}/{rng.randint(1, 14)}/2015 10:00:00" if rng.random() < 0.6 else f"2015-{rng.randint(1, 12):02}-{rng.randint(1, 12):02}" for _ in range(120)]
    r = spark.createDataFrame([(i, "m", i, v, None) for i, v in enumerate(values)], "id int, memory string, ingested int, created string, modified string")
    m = spark.createDataFrame([("m", "UTC", None)], "memory string, tz string, date_order string")
    was, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({x["id"]: x["utc_us"] for x in ts.normalised_instants(r, m).filter("field = 'created'").collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1] and len(got[0]) == 120


def _year(order, n=240):
    """Slash dates of days in order, as a client that writes ``order`` would write them, all with a day of 12 at most."""
    days = [datetime(2015, 1 + k * 12 // n, 1 + (k * 12 * 12 // n) % 12, 9, k % 60, tzinfo=UTC) for k in range(n)]
    days.sort()
    return days, [f"{d.month}/{d.day}/{d.year} 9:{d.minute:02}:00" if order == "mdy" else f"{d.day}/{d.month}/{d.year} 9:{d.minute:02}:00" for d in days]


@pytest.mark.parametrize("order", ["mdy", "dmy"])
@pytest.mark.parametrize("declared", [None, "mdy", "dmy"])
def test_sequence_tells_the_order(spark, order, declared):
    """Steps back in time decide, against a wrong declaration too; one contrary neighbour among others does not."""
    days, values = _year(order)
    r = spark.createDataFrame([(i, "m", d, v, None) for i, (d, v) in enumerate(zip(days, values))], "id int, memory string, ingested timestamp, created string, modified string")
    m = spark.createDataFrame([("m", "UTC", declared)], "memory string, tz string, date_order string")
    got = {x["id"]: x["utc_us"] for x in ts.normalised_instants(r, m).filter("field = 'created'").collect()}
    assert got == {i: int((d - EPOCH) / timedelta(microseconds=1)) for i, d in enumerate(days)}


def test_a_switch_of_order_is_found(spark):
    """A client that changes its notation once is read in both; where it changes is told by unambiguous days."""
    days, before = _year("mdy", 120)
    later = [d + timedelta(days=366) for d in days]
    after = [f"{d.day}/{d.month}/{d.year} 9:{d.minute:02}:00" for d in later]
    r = spark.createDataFrame([(i, "m", d, v, None) for i, (d, v) in enumerate(zip(days + later, before + after))], "id int, memory string, ingested timestamp, created string, modified string")
    m = spark.createDataFrame([("m", "UTC", None)], "memory string, tz string, date_order string")
    got = {x["id"]: x["utc_us"] for x in ts.normalised_instants(r, m).filter("field = 'created'").collect()}
    assert got == {i: int((d - EPOCH) / timedelta(microseconds=1)) for i, d in enumerate(days + later)}


def test_neighbours_settle_undeclared_dates(spark):
    """Without a declared order, the order of a group's other dates decides."""
    values = ["25/10/2015 10:00:00", "26/10/2015 10:00:00", "1/11/2015 10:00:00", "13/11/2015 10:00:00"]
    r = spark.createDataFrame([(i, "m", i, v, None, "k") for i, v in enumerate(values)], "id int, memory string, ingested int, created string, modified string, tz string")
    m = spark.createDataFrame([("m", "UTC", None)], "memory string, tz string, date_order string")
    got = {x["id"]: x["utc_us"] for x in ts.normalised_instants(r, m).filter("field = 'created'").collect()}
    assert got[2] == us(2015, 11, 1, 10)


def test_edges(spark):
    m = spark.createDataFrame([("m", "Europe/Berlin", "dmy")], "memory string, tz string, date_order string")
    schema = "id bigint, memory string, ingested timestamp, created string, modified string, _tz string, grp string, r_created string"
    assert ts.normalised_instants(spark.createDataFrame([], schema), m).count() == 0
    rows = [(1, None, None, "2020-01-01 00:00:00", None, "x", "y", "z"), (2, "m", None, "2020-01-01 00:00:00", "2020-01-01T00:00:00.000000Z", None, None, None), (2, "m", None, "2020-01-01 00:00:00", "2020-01-01T00:00:00.000000Z", None, None, None)]
    df = spark.createDataFrame(rows, schema).drop("_tz", "grp", "r_created").withColumns({"tz": F.lit("q"), "field": F.lit("w")})
    got = sorted((r["id"], r["field"], r["utc_us"]) for r in ts.normalised_instants(df, m, rewritten_only=True).collect())
    assert got == [(1, "created", us(2020, 1, 1)), (2, "created", us(2020, 1, 1, offset=1)), (2, "created", us(2020, 1, 1, offset=1))]
