"""Folders written again and again, counts that come with a write, promotion by priority."""

from pyspark.sql import functions as F

from millrace.sources import sinks

ROWS = "k long, name string, reason_code string, category string"


def names(df):
    return {r["k"]: r["stored_as"] for r in df.collect()}


def test_quarantine_counts_on_and_repeats_itself(spark, tmp_path):
    path = str(tmp_path / "q")
    first = spark.createDataFrame([(3, "a.jpg", "low", "x"), (1, "a.jpg", "low", "x"), (2, "b", "low", "x"), (9, "a.jpg", "low", "y")], ROWS)
    assert names(sinks.quarantine(first, path, "k", "name")) == {1: "a.jpg", 3: "a_1.jpg", 2: "b", 9: "a.jpg"}
    untouched = sorted(p.name for p in (tmp_path / "q" / "reason_code=low" / "category=y").iterdir())
    more = first.filter("k < 9").union(spark.createDataFrame([(0, "a.jpg", "low", "x"), (0, "a.jpg", "low", "x"), (5, "b", "tall", "x")], ROWS))
    want = {0: "a_2.jpg", 1: "a.jpg", 3: "a_1.jpg", 2: "b", 9: "a.jpg", 5: "b"}
    for _ in range(2):
        assert names(sinks.quarantine(more.repartition(3), path, "k", "name")) == want
    assert sorted(p.name for p in (tmp_path / "q" / "reason_code=low" / "category=y").iterdir()) == untouched


def test_detector_dataset_keeps_the_other_split(spark, tmp_path):
    boxes = spark.createDataFrame([("1", "train", "0 1"), ("2", "val", "0 2")], "stem string, split string, line string")
    sinks.detector_dataset(boxes, str(tmp_path), ["leaf"])
    sinks.detector_dataset(boxes.filter("split = 'val'").withColumn("line", F.lit("0 3")), str(tmp_path), ["leaf"])
    got = spark.read.schema("stem string, line string, split string").csv(f"{tmp_path}/labels").collect()
    assert {(r["stem"], r["split"], r["line"]) for r in got} == {("1", "train", "0 1"), ("2", "val", "0 3")}
    assert "names: [leaf]" in [r["value"] for r in spark.read.text(f"{tmp_path}/data.yaml").collect()]


def test_counts_come_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "c", 1.0), (None, None, 2.0)], "k long, a string, b double").repartition(3)
    seen = sinks.write_complete(df, str(tmp_path / "w"), "a", "b")
    again = df.agg(F.count("*"), F.count_if(F.col("a").isNull() | F.col("b").isNull()), F.count_if(F.col("a").isNull()), F.count_if(F.col("b").isNull())).first()
    assert (seen["n"], seen["n_dropped"], seen["no_a"], seen["no_b"]) == tuple(again) == (4, 3, 2, 2)
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1
    assert sinks.write_complete(df.limit(0), str(tmp_path / "e"), "a")["n"] == 0


def test_promotion_takes_the_first_source_that_has_one(spark):
    keys = spark.createDataFrame([(i,) for i in range(5)], "k long")
    source = lambda *rows: spark.createDataFrame(list(rows), "k long, artefact string")
    got = sinks.promoted(keys, "k", source((1, "z"), (1, "y"), (2, None)), source((1, "a"), (2, "b")), source((3, "c"), (9, "d"), (2, "a")))
    assert {r["k"]: r["artefact"] for r in got.collect()} == {0: None, 1: "y", 2: "b", 3: "c", 4: None}
