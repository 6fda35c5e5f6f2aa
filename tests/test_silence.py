"""Runs that stop, return or are given time, from a log that arrives in parts."""

import pytest
from pyspark.sql import functions as F

from palindra.streaming import silence

LINE = "run_id bigint, seq bigint, at_us bigint"
SECOND = 1_000_000
BEGIN = 1_000  # a stream drops what is not above its first watermark, 1970


def reports(spark, folder, parts, **options):
    """(run, state, seq, since, until) in seconds, as they came out part by part."""
    told = []
    for part in parts:
        rows = [(run, seq, (BEGIN + at) * SECOND) for run, seq, at in part]
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        log = spark.readStream.schema(LINE).parquet(f"{folder}/in")
        silence.follow(silence.silences(log, 100, **options), folder).awaitTermination()
        found = spark.read.schema(silence.REPORT).parquet(f"{folder}/out").collect()
        at = lambda us: None if us is None else us // SECOND - BEGIN
        told.append(sorted((r.run_id, r.state, r.seq, at(r.since_us), at(r.until_us)) for r in found))
    return told


def beat(run, upto, step=10, first=0):
    return [(run, i, i * step) for i in range(first, upto // step + 1)]


def test_silent_and_back(spark, tmp_path):
    first = [*beat(1, 100), *beat(2, 40), (3, 0, 0), (3, 1, 10)]
    second = [*beat(1, 190, first=11), (4, 0, 115), (4, 1, 190)]
    third = [*beat(1, 400, first=20), (2, 9, 300), (2, 10, 390), (4, 2, 290), (3, 0, 5)]
    one, two, three = reports(spark, str(tmp_path), [first, second, third])
    assert one == []
    # Nothing of 2 and 3 has arrived: the log of the others has gone on.
    assert two == [(2, "silent", 4, 40, None), (3, "silent", 1, 10, None)]
    # 2 is back, 4 was at most 100 seconds away, and 3 sent a line from before its silence.
    back = [(2, "returned", 9, 40, 300), (4, "silent", 2, 290, None)]
    assert three == sorted([*two, *back])


def test_gaps_inside_one_batch_and_grace(spark, tmp_path):
    rows = [*beat(1, 1000), (2, 0, 0), (2, 1, 150), (2, 2, 600), (5, 0, 940)]
    (plain,) = reports(spark, str(tmp_path / "plain"), [rows])
    gaps = [(2, "silent", 1, 150, None), (2, "returned", 2, 150, 600), (2, "silent", 2, 600, None)]
    assert plain == sorted([(2, "silent", 0, 0, None), (2, "returned", 1, 0, 150), *gaps])
    (graced,) = reports(spark, str(tmp_path / "graced"), [rows], started_us=BEGIN * SECOND, grace_seconds=200)
    assert graced == sorted(gaps)


@pytest.mark.parametrize("late, told", [("0 seconds", 1), ("60 seconds", 0)])
def test_watermark_waits(spark, tmp_path, late, told):
    rows = [*beat(1, 150), (2, 0, 0)]
    assert len(reports(spark, str(tmp_path), [rows], late=late)[0]) == told


class _Calls:
    """A handle and value state that only record what a run asks of them."""

    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def listTimers(self):
        self.calls.append("listTimers")
        return iter([])

    def deleteTimer(self, ms):
        self.calls.append(("deleteTimer", ms))

    def registerTimer(self, ms):
        self.calls.append(("registerTimer", ms))


def test_a_batch_asks_the_state_store_little():
    import pandas as pd

    watch, calls = silence.SilenceWatch(100 * SECOND), _Calls()
    watch.init(calls)
    for part in ([(1, 0, 0), (1, 1, 10)], [(1, 2, 20)]):
        rows = pd.DataFrame([(run, seq, at * SECOND) for run, seq, at in part], columns=["run_id", "seq", "at_us"])
        list(watch.handleInputRows((1,), iter([rows]), None))
    # Each line's timer is known from the state: no listing, and the old one goes.
    first, then = (10 + 100) * 1000 + 1, (20 + 100) * 1000 + 1
    assert calls.calls == ["get", "update", ("registerTimer", first), "get", ("deleteTimer", first), "update", ("registerTimer", then)]
