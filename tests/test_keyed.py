"""Tables partitioned by key: pruned loads, replaced rows, layouts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fitloom import schemas
from fitloom.operators import keyed, store

COLUMNS = "seq int, resume_id string, link string, company string, title string, location string, type string, salary string, description string, date_posted string, source string, match_score int"


def rows(spark, pairs, company="Acme"):
    return spark.createDataFrame([(i, r, x, company, "t", "", None, None, "", "2026-01-01", "s", 1) for i, (r, x) in enumerate(pairs)], COLUMNS)


def load(spark, path, df, buckets=None):
    return store.append_jobs(spark, path, df, [F.col("seq")], F.lit("2026-03-12").cast("date"), F.lit("2026-03-12 10:00:00"), buckets)


def test_a_small_load_reads_and_writes_its_own_buckets(spark, tmp_path):
    path = str(tmp_path / "jobs")
    pairs = [(f"r{i % 7}", f"l{i}") for i in range(500)]
    assert load(spark, path, rows(spark, pairs), 64).inserted == 500
    layout = keyed.layout_of(spark, path)
    assert layout == keyed.Layout(store.JOB_KEY, 64)
    small = layout.placed(store.as_jobs(rows(spark, [("r0", "l0"), ("r0", "new")]), F.current_date(), F.current_timestamp()))
    hit = keyed.hit_buckets(small)
    assert 1 <= len(hit) <= 2
    stored = keyed.read(spark, path, "resume_id string, link string", hit)
    assert {f.split("/bucket=")[1].split("/")[0] for f in stored.inputFiles()} >= {str(b) for b in hit}
    plan = keyed.new_rows(small, path, layout)._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x and "PartitionFilters: [" in x and f"bucket#" in x.split("PartitionFilters")[1])
    assert all(str(b) in scan.split("PartitionFilters: [")[1].split("]")[0] for b in hit)
    assert "ReadSchema: struct<resume_id:string,link:string>" in plan and "company:string" not in plan.split("PartitionFilters: [isnotnull(bucket")[-1].split("ReadSchema")[1][:60]
    before = {b: set(os.listdir(f"{path}/bucket={b}")) for b in range(64) if os.path.isdir(f"{path}/bucket={b}")}
    counts = load(spark, path, rows(spark, [("r0", "l0"), ("r0", "new")]))
    assert (counts.incoming, counts.inserted, counts.skipped) == (2, 1, 1)
    changed = {b for b in before if set(os.listdir(f"{path}/bucket={b}")) != before[b]}
    assert len(changed) <= 1 and changed <= set(hit)


def test_equals_the_plain_table(spark, tmp_path):
    rng = random.Random(3)
    loads = [[(rng.choice(["a", "b", None]), rng.choice(["x", "y", "", None, f"z{rng.randrange(30)}"])) for _ in range(60)] for _ in range(4)]
    plain, parted = str(tmp_path / "plain"), str(tmp_path / "parted")
    for part in loads:
        df = rows(spark, part).withColumn("company", F.when(F.col("seq") != 5, F.col("company")))
        assert load(spark, plain, df) == load(spark, parted, df, 5)
    read = lambda p: sorted(map(str, store.read_jobs(spark, p).drop("created_at").collect()))
    assert read(plain) == read(parted) and store.read_jobs(spark, parted).columns == schemas.JOBS.names
    assert load(spark, parted, rows(spark, [])).incoming == 0


def test_layouts_are_kept(spark, tmp_path):
    path, other = str(tmp_path / "jobs"), str(tmp_path / "plain")
    load(spark, path, rows(spark, [("a", "x")]), 8)
    with pytest.raises(ValueError, match="8 buckets"):
        load(spark, path, rows(spark, [("a", "y")]), 16)
    load(spark, other, rows(spark, [("a", "x")]))
    assert keyed.layout_of(spark, other) is None and keyed.layout_of(spark, str(tmp_path / "absent")) is None
    with pytest.raises(ValueError, match="not partitioned by key"):
        load(spark, other, rows(spark, [("a", "y")]), 8)
    load(spark, path, rows(spark, [("a", f"l{i}") for i in range(40)]))
    more = str(tmp_path / "more")
    keyed.rebucket(spark, path, more, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.JOBS), 32)
    assert load(spark, more, rows(spark, [("a", f"l{i}") for i in range(40)])).inserted == 0
    assert sorted(map(str, store.read_jobs(spark, more).collect())) == sorted(map(str, store.read_jobs(spark, path).collect()))


def test_replaced_rows(spark, tmp_path):
    path = str(tmp_path / "docs")
    frame = lambda xs: spark.createDataFrame(xs, "k string, j long, body string")
    keyed.replace(frame([("a", 1, "old"), ("a", 2, "stays"), ("b", 1, "old")]), path, ["k", "j"], [F.col("body")], 4)
    keyed.replace(frame([("a", 1, "new"), ("c", 9, "z"), ("c", 9, "first")]), path, ["k", "j"], [F.col("body")], 4)
    keyed.replace(frame([]), path, ["k", "j"], [F.col("body")], 4)
    got = sorted(tuple(r) for r in keyed.read(spark, path, "k string, j long, body string").drop("bucket").collect())
    assert got == [("a", 1, "new"), ("a", 2, "stays"), ("b", 1, "old"), ("c", 9, "first")]
    # The same call again changes nothing.
    keyed.replace(frame([("a", 1, "new"), ("c", 9, "first")]), path, ["k", "j"], [F.col("body")], 4)
    assert sorted(tuple(r) for r in keyed.read(spark, path, "k string, j long, body string").drop("bucket").collect()) == got


def test_replacing_in_an_absent_table_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    keyed.replace(spark.createDataFrame([], "k string, v int"), path, ["k"], [F.col("v")], 4)
    assert keyed.read(spark, path, "k string, v int").count() == 0
