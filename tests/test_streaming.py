from pyspark.sql import functions as F

from fitloom import schemas
from fitloom.operators import store
from fitloom.streaming.ingest import ingest

AS_OF = "2026-03-12"
CREATED = "2026-03-12 00:00:00"
SCHEMA = "resume_id string, title string, company string, location string, type string, salary string, description string, link string, date_posted string, source string, match_score int, seq long"


def rule():
    return [F.col("seq")], F.lit(AS_OF).cast("date"), F.lit(CREATED)


def rows(spark, *links, resume="r", company="c"):
    made = [(resume, f"t{i}", company, None, None, None, None, link, None, "s", None, i) for i, link in enumerate(links)]
    return spark.createDataFrame(made, SCHEMA)


def folders(tmp_path):
    return [str(tmp_path / n) for n in ("landing", "jobs", "state", "rejects")]


def land(df, landing):
    df.coalesce(1).write.mode("append").parquet(landing)


def run(spark, landing, jobs, state, rejects):
    ingest(spark.readStream.schema(SCHEMA).parquet(landing), jobs, state, *rule(), rejects).awaitTermination()
    return sorted((r.resume_id, r.link) for r in store.read_jobs(spark, jobs).collect())


def test_stream_and_append_share_a_table(spark, tmp_path):
    landing, jobs, state, rejects = folders(tmp_path)
    assert store.append_jobs(spark, jobs, rows(spark, "old"), *rule()).inserted == 1
    land(rows(spark, "a", "a", "b", "old", ""), landing)
    assert run(spark, landing, jobs, state, rejects) == [("r", ""), ("r", "a"), ("r", "b"), ("r", "old")]
    assert run(spark, landing, jobs, state, rejects) == [("r", ""), ("r", "a"), ("r", "b"), ("r", "old")]
    counts = store.append_jobs(spark, jobs, rows(spark, "b", "c"), *rule())
    assert (counts.inserted, counts.skipped) == (1, 1)
    land(rows(spark, "c", "d", None), landing)
    land(rows(spark, "a", resume="q"), landing)
    assert run(spark, landing, jobs, state, rejects) == [("q", "a"), ("r", ""), ("r", "a"), ("r", "b"), ("r", "c"), ("r", "d"), ("r", "old")]


def test_defaults_and_rejected_rows(spark, tmp_path):
    landing, jobs, state, rejects = folders(tmp_path)
    land(rows(spark, "x", company=None), landing)
    assert run(spark, landing, jobs, state, rejects) == []
    land(rows(spark, "x", "y"), landing)
    assert run(spark, landing, jobs, state, rejects) == [("r", "x"), ("r", "y")]
    row = store.read_jobs(spark, jobs).where("link = 'x'").first()
    assert (row.date_found, row.job_type, row.match_score, row.application_status, row.location) == ("2026-03-12", "Internship", 0, "Not Applied", "")
    assert set(store.read_jobs(spark, jobs).columns) == set(schemas.JOBS.names)
    assert [(r.link, r.reason) for r in spark.read.schema(SCHEMA + ", reason string").parquet(rejects).collect()] == [("x", "company is null")]


def test_a_repeated_batch_adds_only_what_is_missing(spark, tmp_path):
    landing, jobs, state, rejects = folders(tmp_path)
    batch = rows(spark, "a", "b", "")
    store.append_jobs(spark, jobs, batch.where("link = 'a'"), *rule())
    land(batch, landing)
    assert run(spark, landing, jobs, state, rejects) == [("r", ""), ("r", "a"), ("r", "b")]
