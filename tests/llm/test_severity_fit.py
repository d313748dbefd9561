"""The ordinal fit: its gradient, shared weights in order, and held-out texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import toxicity


def likelihood(weights, thresholds, names, grades, times):
    z = np.array([sum(weights.get(x, 0.0) for x in set(r)) for r in names])
    above = np.concatenate([np.ones((len(z), 1)), toxicity.squash(z[:, None] - np.array(thresholds)), np.zeros((len(z), 1))], axis=1)
    p = above[np.arange(len(z)), grades] - above[np.arange(len(z)), grades + 1]
    return (times * np.log(p)).sum() - toxicity.SHRINK / 2 * sum(w * w for w in weights.values())


def test_the_fit_is_at_the_top_of_the_penalised_likelihood():
    rnd = random.Random(2)
    names = [[f"f{k}" for k in range(6) if rnd.random() < 0.4] for _ in range(300)]
    grades = np.array([min(2, max(0, round(sum({"f0": 1.0, "f1": 0.8, "f2": -0.7}.get(x, 0.0) for x in r) + rnd.gauss(0, 0.6)))) for r in names])
    times = np.ones(300)
    model = toxicity.fit(names, grades, times)
    assert model.thresholds[0] < model.thresholds[1]
    best = likelihood(model.weights, model.thresholds, names, grades, times)
    for x in list(model.weights):
        for d in (-0.05, 0.05):
            assert likelihood(model.weights | {x: model.weights[x] + d}, model.thresholds, names, grades, times) < best + 1e-3
    for k in range(2):
        for d in (-0.05, 0.05):
            t = list(model.thresholds)
            t[k] += d
            assert likelihood(model.weights, t, names, grades, times) < best + 1e-3


def test_held_out_texts_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id is not null and toxic is not null")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    judged = toxicity.grade_toxicity(docs.join(labels.where("doc_id % 3 = 1").select("doc_id", F.col("toxic").alias("truth")), "doc_id").where("text is not null"), model)
    rows = [(r["truth"] > 0, r["toxic"]) for r in judged.collect()]
    toxic, clean = [y for t, y in rows if t], [y for t, y in rows if not t]
    assert toxic and clean and sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_no_number_of_features_is_cut(spark):
    many = 400
    docs = [(i, " ".join(f"{'bad' if i % 2 else 'good'}word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(many))) for i in range(60)]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    assert len([w for w in model.weights if len(w) > 8]) == 2 * many
