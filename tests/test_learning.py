from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators.learning import LOSSES, Options, gradient, learn
from graphloom.streaming.candidates import candidate_stream, document_stream

FEATURES = "feature string, label string, value double"


def toy(spark):
    """Two outputs for each of three inputs; the gold one has the feature ``good``."""
    rows = [(i, y, f"{'good' if y == i % 2 else 'bad'}", float(y != i % 2)) for i in range(3) for y in range(2)]
    outputs = spark.createDataFrame(rows, "i int, y int, feature string, cost double").cache()

    def decode(weights, scale):
        w = weights.select("feature", F.col("value").alias("w"))
        scored = outputs.join(w, "feature", "left").withColumn("s", F.coalesce("w", F.lit(0.0)) + scale * F.col("cost"))
        best = scored.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "feature"))).where("k = 1")
        return best.groupBy("feature").agg(F.count("*").cast("double").alias("value")).select("feature", F.lit(None).cast("string").alias("label"), "value")

    gold = outputs.where("cost = 0").groupBy("feature").agg(F.count("*").cast("double").alias("value")).select("feature", F.lit(None).cast("string").alias("label"), "value")
    return decode, gold


def test_learning_separates(spark):
    decode, gold = toy(spark)
    for optimizer in ("sgd", "adagrad"):
        w = {r["feature"]: r["value"] for r in learn(decode, gold, Options(passes=5, optimizer=optimizer)).collect()}
        assert w.get("good", 0) > w.get("bad", 0)


def test_losses_have_gradients(spark):
    decode, gold = toy(spark)
    nothing = gold.where("false")
    for loss in LOSSES:
        rows = gradient(decode, gold, nothing, Options(loss=loss)).collect()
        assert all(r["value"] != 0 for r in rows)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x !\ny")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = candidate_stream(document_stream(spark, str(tmp_path / "in"), docs.schema))
    q = stream.writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, candidate_stream(docs).collect()))
