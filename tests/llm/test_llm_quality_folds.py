"""Labels of held-out rows reach no part of the model."""

from pyspark.sql import functions as F

from millrace.llm import quality


def test_held_out_labels_change_no_weight(spark):
    texts = ["the cat sat on the mat and looked at dog %d while it rained %d" % (i, i * 7) for i in range(120)] + ["$$$ WIN!! %d ### CASH!! %d @@@ FREE!!" % (i, i * 3) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)], "doc_id long, quality int")
    one_class = labels.withColumn("quality", F.when(quality.fold("doc_id") == 0, 0).otherwise(F.col("quality")))
    assert one_class.filter("quality = 1").count() < 110
    assert quality.fit(df, labels) == quality.fit(df, one_class) == quality.fit(df, labels.filter(quality.fold("doc_id") != 0))
