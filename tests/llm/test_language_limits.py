from pyspark.sql import functions as F

from graphloom.llm import langid


def test_all_rows_set_the_limits(spark):
    many = spark.range(40_000).select(F.concat(F.lit("common words "), F.col("id").cast("string")).alias("text"), F.lit("xx").alias("lang"))
    rare = spark.range(50).select(F.concat(F.lit("seldom seen "), F.col("id").cast("string")).alias("text"), F.lit("yy").alias("lang"))
    # A text that a sample of 20,000 rows by hash would leave out.
    rare = rare.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) > 600_000).limit(1)
    model = langid.train(many.union(rare))
    assert set(model.limits) == set(model.levels) == {"xx", "yy"}
    assert [x[0] for x in model.predict(["seldom seen"])] == ["yy"]
