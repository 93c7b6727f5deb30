import random

from pyspark.sql import functions as F

from fitloom.operators import ranking as R


def test_row_index_with_a_hot_value(spark):
    rng = random.Random(1)
    data = [(i, 7 if rng.random() < 0.6 else rng.randint(0, 10)) for i in range(5000)]
    df = spark.createDataFrame(data, "id int, s int").repartition(5)
    got = {r.id: r.n for r in R.row_index(df, [F.desc("s"), F.col("id").asc()], "n").collect()}
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])))}
    assert got == want


def test_score_breaks(spark):
    data = [("a", 9, 1), ("a", 9, 2), ("a", 7, 3), ("b", 7, 4)]
    df = spark.createDataFrame(data, "resume_id string, match_score int, id int")
    got = sorted((r.resume_id, r.position, r.id, r.is_break, r.header) for r in R.score_breaks(df, ["id"], ["resume_id"]).collect())
    assert got == [("a", 1, 1, True, "★" * 9 + "☆"), ("a", 2, 2, False, None), ("a", 3, 3, True, "★" * 7 + "☆" * 3),
                   ("b", 1, 4, True, "★" * 7 + "☆" * 3)]
    whole = R.score_breaks(df, ["id"]).orderBy("position").collect()
    assert [(r.position, r.is_break) for r in whole] == [(1, True), (2, False), (3, True), (4, False)]


def test_caps(spark):
    data = [("g", u, i, i % 2 == 0) for i, u in enumerate([1] * 4 + [2] * 3 + [3] * 5)]
    df = spark.createDataFrame(data, "g string, u int, i int, ok boolean")
    ids = lambda d: sorted(r.i for r in d.collect())
    order = [F.col("i").asc()]
    assert ids(R.cap_before(df, ["g"], order, 5, F.col("ok"))) == [0, 2, 4]
    assert ids(R.cap_after(df, ["g"], order, 3, F.col("ok"))) == [0, 2, 4]
    assert ids(R.cap_at_boundary(df, ["g"], "u", 5)) == list(range(7))
    assert ids(R.cap_at_boundary(df, ["g"], "u", 4)) == list(range(4))


def test_top_per_group_prunes_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("g"), "id")
    plan = R.top_per_group(df, ["g"], [F.col("id").asc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_null_groups_and_scores_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 3, 1), (None, None, 2), ("a", 3, 3)], "g string, match_score int, i int")
    assert R.score_breaks(df, ["i"], ["g"]).count() == 3
    units = spark.createDataFrame([("a", None), ("a", 1)], "g string, u int")
    assert R.cap_at_boundary(units, ["g"], "u", 5).count() == 2
