import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fitloom import schemas
from fitloom.operators import clustered as C


def jobs(spark, seed, n, hot=0.4):
    """n jobs, a large share of them with one score and date."""
    rnd = random.Random(seed)
    made = [(f"r{rnd.randrange(9)}", 7 if (same := rnd.random() < hot) else rnd.randrange(11), "2026-01-05" if same else f"2026-01-{rnd.randrange(1, 29):02d}",
             f"l{seed}-{i}") for i in range(n)]
    rows = spark.createDataFrame(made, "resume_id string, match_score int, date_found string, link string")
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.JOBS])


def listed(rows):
    return [(r.match_score, r.date_found, r.resume_id, r.link) for r in rows]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "jobs")
    parts = [jobs(spark, s, n) for s, n in ((1, 600), (2, 150), (3, 1))]
    assert [C.add(p, path, 50) for p in parts] == [12, 3, 1]
    everything = [row for p in parts for row in listed(p.collect())]
    return path, sorted(everything, key=lambda r: (-r[0], [-ord(c) for c in r[1]], r[2], r[3]))


def test_every_row_is_stored_once(spark, table):
    path, want = table
    assert sorted(listed(C.read(spark, path).collect())) == sorted(want)


@pytest.mark.parametrize("score", [0, 7, 9, 10, 11])
def test_threshold_reads_the_blocks_it_needs(spark, table, score):
    path, want = table
    found = C.at_least(spark, path, score)
    assert sorted(listed(found.collect())) == sorted(r for r in want if r[0] >= score)
    chosen = [r for r in C.ranges(spark, path) if r["first"]["score"] >= score]
    if chosen:
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.metrics().apply("numFiles").value() == len(chosen)
    assert score < 9 or len(chosen) < 9


@pytest.mark.parametrize("start, n", [(0, 5), (0, 1000), (40, 30), (333, 1), (700, 100), (750, 10), (5000, 3), (10, 0)])
def test_pages(spark, table, start, n):
    path, want = table
    assert listed(C.page(spark, path, start, n).collect()) == want[start:start + n]


def test_page_reads_few_blocks(spark, table):
    path, _ = table
    ranges = C.ranges(spark, path)
    assert len(C.page_blocks(ranges, 0, 10)[0]) < len(ranges) / 2
    assert len(C.page_blocks(ranges, 700, 10)[0]) < len(ranges) / 2


def test_chosen_blocks_hold_the_page():
    rnd = random.Random(4)
    for _ in range(200):
        rows, ranges = [], []
        for b in range(rnd.randrange(1, 9)):
            at = rnd.randrange(8)
            own = [(rnd.randrange(at, at + 3), "d") for _ in range(rnd.randrange(1, 6))]
            rows += [(k, b) for k in own]
            ranges.append(Row(block=b, first=Row(score=max(own)[0], date="d"), last=Row(score=min(own)[0], date="d"), n=len(own)))
        # Any order within one key is a valid listing: take the ones that put each block first and last.
        for sign in (1, -1):
            ordered = sorted(rows, key=lambda r: (-r[0][0], sign * r[1]))
            start, n = rnd.randrange(len(rows) + 2), rnd.randrange(6)
            blocks, skipped = C.page_blocks(ranges, start, n)
            left = [r for r in ordered if r[1] in {b.block for b in blocks}]
            assert left[start - skipped:start - skipped + n] == ordered[start:start + n]


def test_empty_and_compacted(spark, table, tmp_path):
    path, want = table
    none = str(tmp_path / "none")
    assert C.add(jobs(spark, 1, 0), none) == 0
    assert C.read(spark, none).count() == C.page(spark, none, 0, 5).count() == C.at_least(spark, none, 0).count() == 0
    assert C.compact(spark, path, str(tmp_path / "one"), 100) == 8
    assert listed(C.page(spark, str(tmp_path / "one"), 90, 40).collect()) == want[90:130]


def test_blocks_of_a_failed_addition_are_not_read(spark, tmp_path):
    path = str(tmp_path / "jobs")
    C.add(jobs(spark, 5, 60), path, 30)
    stray = jobs(spark, 6, 90).withColumn("run", F.lit("lost")).withColumn("block", F.pmod(F.hash("link"), F.lit(3)))
    stray.write.mode("append").partitionBy("run", "block").parquet(path)
    assert C.read(spark, path).count() == 60
    C.add(jobs(spark, 7, 20), path, 30)
    assert C.read(spark, path).count() == 80
    assert sorted(r.link for r in C.read(spark, path).collect()) == sorted(f"l5-{i}" for i in range(60)) + sorted(f"l7-{i}" for i in range(20))
