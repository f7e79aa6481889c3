import random

import pytest
from pyspark.sql import functions as F

from oddwire.operators import connections
from oddwire.schema import CONNECTION_FEATURES

SECOND = 1_000_000


@pytest.fixture(scope="module")
def log(spark):
    """Connections of which more than a third go to one host, many at the same time."""
    draw = random.Random(4)
    rows, now = [], 0
    for i in range(900):
        now += draw.choice([0, 1, 200_000, 900_000, 2 * SECOND, 2 * SECOND])
        host = "hot" if draw.random() < 0.4 else draw.choice("abc")
        rows.append((i, now, host, draw.choice(["http", "smtp", "ftp"]), draw.choice([0, 0, 1]),
                     draw.choice([0, 1]), draw.randrange(4)))
    frame = spark.createDataFrame(rows, "id long, us long, host string, service string, se int, re int, port int")
    return rows, frame.withColumn("ts", F.timestamp_micros("us")).drop("us").repartition(5).cache()


def recent_brute(rows, seconds):
    result = {}
    for i, us, host, service, *_ in rows:
        past = [r for r in rows if us - seconds * SECOND <= r[1] <= us]
        h = [r for r in past if r[2] == host]
        s = [r for r in past if r[3] == service]
        both = sum(r[3] == service for r in h)
        result[i] = (
            len(h), sum(r[4] for r in h) / len(h), sum(r[5] for r in h) / len(h), both / len(h),
            (len(h) - both) / len(h), len(s), sum(r[4] for r in s) / len(s), sum(r[5] for r in s) / len(s),
            (len(s) - both) / len(s),
        )
    return result


@pytest.mark.parametrize("seconds, slice_seconds", [(2, 60), (2, 2), (2, 3), (30, 30), (30, 1), (100, 7), (0, 5)])
def test_recent_traffic(log, seconds, slice_seconds):
    rows, frame = log
    got = connections.recent_traffic(
        frame, "host", "service", "ts", F.col("se") == 1, F.col("re") == 1, seconds, slice_seconds
    )
    columns = [
        "count", "serror_rate", "rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_count",
        "srv_serror_rate", "srv_rerror_rate", "srv_diff_host_rate",
    ]
    found = {r["id"]: tuple(r[c] for c in columns) for r in got.collect()}
    assert len(found) == got.count() == len(rows)
    for i, expected in recent_brute(rows, seconds).items():
        assert found[i] == pytest.approx(expected)


def last_brute(rows, n):
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    result = {}
    for at, (i, _, host, service, _, _, port) in enumerate(ordered):
        h = [r for r in ordered[: at + 1] if r[2] == host][-n:]
        s = [r for r in ordered[: at + 1] if r[3] == service][-n:]
        same = [r for r in h if r[3] == service]
        result[i] = (
            len(h), len(same), len(same) / len(h), 1 - len(same) / len(h),
            sum(r[6] == port for r in h) / len(h), sum(r[2] != host for r in s) / len(s),
            sum(r[4] for r in h) / len(h), sum(r[4] for r in same) / len(same),
            sum(r[5] for r in h) / len(h), sum(r[5] for r in same) / len(same),
        )
    return result


@pytest.mark.parametrize("n, slice_seconds, block_rows", [(100, 3600, 10_000), (100, 7, 100), (10, 60, 37), (1, 60, 1)])
def test_last_connections(log, n, slice_seconds, block_rows):
    rows, frame = log
    got = connections.last_connections(
        frame, "host", "service", "ts", "id", F.col("se") == 1, F.col("re") == 1, "port",
        n, slice_seconds, block_rows,
    )
    columns = [c for c in CONNECTION_FEATURES if c.startswith("dst_host_")]
    assert len(columns) == 10
    found = {r["id"]: tuple(r[c] for c in columns) for r in got.collect()}
    assert len(found) == got.count() == len(rows)
    for i, expected in last_brute(rows, n).items():
        assert found[i] == pytest.approx(expected)


def test_rows_without_host_or_service_are_kept(spark):
    rows = [(1, "a", "s"), (2, None, "s"), (3, None, None), (4, None, "s")]
    frame = spark.createDataFrame(rows, "id long, host string, service string").withColumn(
        "ts", F.timestamp_seconds(F.col("id") * 10)
    )
    last = connections.last_connections(
        frame, "host", "service", "ts", "id", F.lit(False), F.lit(False), n=2, slice_seconds=10, block_rows=2
    )
    assert {r["id"]: (r["dst_host_count"], r["dst_host_srv_count"]) for r in last.collect()} == {
        1: (1, 1), 2: (1, 1), 3: (2, 1), 4: (2, 1)
    }
    recent = connections.recent_traffic(
        frame, "host", "service", "ts", F.lit(False), F.lit(False), seconds=20, slice_seconds=20
    )
    assert {r["id"]: (r["count"], r["srv_count"]) for r in recent.collect()} == {
        1: (1, 1), 2: (1, 2), 3: (2, 1), 4: (3, 2)
    }


def test_windows_must_fit(log):
    frame = log[1]
    with pytest.raises(ValueError):
        connections.last_connections(
            frame, "host", "service", "ts", "id", F.lit(True), F.lit(True), n=100, block_rows=99
        )


def test_rows_without_time_are_counted_among_themselves(spark):
    rows = [(1, "a", 10), (2, "a", None), (3, "a", 11), (4, "a", None), (5, None, 11)]
    frame = spark.createDataFrame(rows, "id long, host string, s long").select(
        "id", "host", F.lit("x").alias("service"), F.timestamp_seconds("s").alias("ts")
    )
    recent = connections.recent_traffic(
        frame, "host", "service", "ts", F.lit(None).cast("boolean"), F.lit(True), seconds=5, slice_seconds=1
    )
    assert {r["id"]: (r["count"], r["srv_count"], r["serror_rate"], r["rerror_rate"]) for r in recent.collect()} == {
        1: (1, 1, 0, 1), 2: (2, 2, 0, 1), 3: (2, 3, 0, 1), 4: (2, 2, 0, 1), 5: (1, 3, 0, 1)
    }
    assert connections.recent_traffic(
        frame.limit(0), "host", "service", "ts", F.lit(True), F.lit(True)
    ).count() == 0


def line(fields=41, **changes):
    values = ["0"] * fields
    for name, value in changes.items():
        values[CONNECTION_FEATURES.index(name)] = value
    return ",".join([*values, "smurf."])


def test_quarantine(spark):
    lines = [line(service="http"), line(54 - 1), line(39), line(duration="abc"), ""]
    rows = connections.quarantine_connections(
        spark.createDataFrame([(v,) for v in lines], "value string")
    ).collect()
    reasons = {r["value"]: r["_corrupt_reason"] for r in rows}
    assert [reasons[v] for v in lines] == [None, "field_count", "field_count", "number", "field_count"]
    good = next(r for r in rows if r["_corrupt_reason"] is None)
    assert (good["service"], good["duration"], good["label"]) == ("http", 0.0, "smurf.")


def test_attack_classes(spark):
    names = [("smurf.",), ("perl",), ("normal.",), ("unheard-of.",), (None,)]
    table = connections.with_attack_class(spark.createDataFrame(names, "label string"))
    assert [r["attack_class"] for r in table.collect()] == ["dos", "u2r", "normal", None, None]
