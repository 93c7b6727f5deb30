from fitloom.session import listing_session
from fitloom.streaming import resumes as R
from test_files import docx


def run(spark, tmp_path, **options):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    R.ingest_resumes(spark, landing, out, state, **options).awaitTermination()
    known = {(r.source_file.rsplit("/", 1)[1], r.name, r.email) for r in R.read_profiles(spark, out).collect()}
    bad = {(r.source_file.rsplit("/", 1)[1], r.reason) for r in R.read_quarantine(spark, out).collect()}
    return known, bad, R.read_profiles(spark, out).count()


def test_files_added_between_runs_are_parsed_once(spark, tmp_path):
    landing = tmp_path / "landing"
    (landing / "deep").mkdir(parents=True)
    assert run(spark, tmp_path) == (set(), set(), 0)
    (landing / "a.txt").write_text("Jane Roe\njane@x.org", encoding="utf-8")
    docx(landing / "deep" / "b.docx", [("Al", " Poe"), ("al@", "y.org")])
    (landing / "c.pdf").write_bytes(b"%PDF")
    first = {("a.txt", "Jane Roe", "jane@x.org"), ("b.docx", "Al Poe", "al@y.org")}, {("c.pdf", "unsupported format: .pdf")}, 2
    assert run(spark, tmp_path) == first
    assert run(spark, tmp_path) == first
    (landing / "A.TXT").write_text("Zoe Doe", encoding="utf-8")
    (landing / "empty.txt").write_text(" \n")
    (landing / "bad.docx").write_bytes(b"not a zip")
    known, bad, n = run(spark, tmp_path, max_files=1)
    assert known == first[0] | {("A.TXT", "Zoe Doe", "")} or known == first[0] | {("A.TXT", "Zoe Doe", None)}
    assert bad == first[1] | {("empty.txt", "no text found"), ("bad.docx", "no text found")} and n == 3


def test_a_repeated_batch_overwrites_its_folder(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "a.txt").write_text("Jane Roe", encoding="utf-8")
    first = run(spark, tmp_path)
    (tmp_path / "state" / "commits" / "0").unlink()  # as after a driver lost before the batch was committed
    crc = tmp_path / "state" / "commits" / ".0.crc"
    if crc.exists():
        crc.unlink()
    assert run(spark, tmp_path) == first and first[2] == 1


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    for i in range(150):
        folder = tmp_path / "landing" / f"file={i}"
        folder.mkdir(parents=True)
        (folder / "a.txt").write_text(f"Jane Roe\njane{i}@x.org", encoding="utf-8")
    tracker, before = spark.sparkContext.statusTracker(), set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    R.ingest_resumes(spark, *(str(tmp_path / n) for n in ("landing", "out", "state"))).awaitTermination()
    assert R.read_profiles(spark, str(tmp_path / "out")).select("email").distinct().count() == 150
    tasks = [stage.numTasks for job in set(tracker.getJobIdsForGroup()) - before if (info := tracker.getJobInfo(job))
             for stage in map(tracker.getStageInfo, info.stageIds) if stage]
    assert any(n == 4 * spark.sparkContext.defaultParallelism for n in tasks)
    assert max(tasks) < 150


def test_a_listing_session_keeps_the_settings(spark):
    key, tasks = "spark.sql.shuffle.partitions", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "13")
        session = listing_session(spark)
        assert session.conf.get(key) == "13" and session.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
        assert int(session.conf.get(tasks)) <= 4 * spark.sparkContext.defaultParallelism and spark.conf.get(tasks, "10000") == "10000"
    finally:
        spark.conf.set(key, old)
