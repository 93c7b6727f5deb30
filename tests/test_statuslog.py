"""Status log with snapshots: equal to the whole log, pruned by day, late updates kept."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fitloom.operators import statuslog as L, store

DAYS = [f"2026-03-{d:02}" for d in range(1, 9)]


def updates(spark, rows):
    at = lambda s: datetime.datetime.fromisoformat(s)
    return spark.createDataFrame([(r, k, s, at(t)) for r, k, s, t in rows], "resume_id string, link string, status string, ts timestamp")


def test_equals_the_whole_log(spark, tmp_path):
    rng = random.Random(6)
    log, snaps = str(tmp_path / "log"), str(tmp_path / "snaps")
    every, read = [], lambda df: sorted(map(str, df.select("resume_id", "link", "status", "ts").collect()))
    assert L.current(spark, log, snaps).count() == 0
    for i, day in enumerate(DAYS):
        # Times of their own may lie before or after the day of arrival, and repeat.
        part = [(rng.choice(["a", "b", None]), f"l{rng.randrange(6)}", rng.choice(["Applied", "Rejected", "Offer"]),
                 f"2026-03-{rng.randrange(1, 12):02}T0{rng.randrange(2)}:00:00") for _ in range(10)]
        every += part
        L.record(updates(spark, part), log, F.lit(day))
        if i in (2, 5):
            L.compact(spark, log, snaps, day)
            L.compact(spark, log, snaps, day)  # written again, nothing changes
        whole = store.by_resume(updates(spark, every))
        want = whole.groupBy("resume_id", "link").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "status")).alias("u")).select("resume_id", "link", "u.*")
        assert read(L.current(spark, log, snaps)) == read(want)
    assert L.newest_snapshot(spark, snaps) == DAYS[5]
    files = L.current(spark, log, snaps).inputFiles()
    plan = L.current(spark, log, snaps)._jdf.queryExecution().toString()
    assert files and plan.count("PartitionFilters: [isnotnull(day") == 2
    jobs = spark.createDataFrame([("a", "l0", "Not Applied"), ("a", "none", "Not Applied")], "resume_id string, link string, application_status string")
    got = {r["link"]: r["application_status"] for r in L.latest(jobs, log, snaps).collect()}
    plain = {r["link"]: r["application_status"] for r in store.latest_status(jobs, updates(spark, every)).collect()}
    assert got == plain and got["none"] == "Not Applied"


def test_unknown_statuses(spark, tmp_path):
    log = str(tmp_path / "log")
    bad = updates(spark, [("a", "x", "Nonsense", "2026-03-01T00:00:00"), ("a", "y", "Applied", "2026-03-01T00:00:00")])
    with pytest.raises(Exception, match="Invalid status"):
        L.record(bad, log, F.lit("2026-03-01"))
    L.record(bad, log, F.lit("2026-03-01"), strict=False)
    assert [r["link"] for r in L.current(spark, log, str(tmp_path / "none")).collect()] == ["y"]
