from pulse.llm.shared import bounded_sample


def test_a_sample_is_bounded_whatever_the_ids(spark):
    rows = spark.range(3000).selectExpr("cast(null AS long) AS doc_id", "concat('text ', id) AS text").repartition(7)
    got = bounded_sample(rows, 200, "s", "text", 100)
    assert got.count() == 200 and got.distinct().count() == 200
    same = bounded_sample(rows.repartition(3), 200, "s", "text", 100)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, got.collect()))


def test_copies_are_one_and_long_rows_are_none(spark):
    rows = spark.range(1000).selectExpr("cast(id % 3 AS long) AS doc_id", "'the same' AS text")
    assert bounded_sample(rows, 50, "s", "text", 100).count() == 3
    assert bounded_sample(rows, 2, "s", "text", 100).count() == 2
    assert bounded_sample(rows, 50, "s", "text", 7).count() == 0
    assert bounded_sample(rows.where("false"), 50, "s", "text", 7).columns == ["doc_id", "text"]
