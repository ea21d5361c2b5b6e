"""The unlabelled sample holds as many ids as asked for, whatever the number of rows that share one."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spendlens.llm import toxicity
from spendlens.llm.words import Words


def test_shared_id_takes_one_place(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda known, other, prior: seen.append(len(other)))
    ids = spark.range(200).select(F.col("id").alias("doc_id")).where(~toxicity.held_out(F.col("doc_id")))
    first = ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").first()[0]
    docs = ids.unionByName(spark.range(100).select(F.lit(first).alias("doc_id"))).withColumn("text", F.lit("some words"))
    toxicity.train(docs, ids.withColumn("toxic", F.lit(1)), unlabelled=50)
    assert seen == [50]


def test_weights_do_not_depend_on_the_order_of_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    again = docs.select("doc_id", F.concat("text", F.lit(" another text of the same id")).alias("text")).where("doc_id % 3 = 0")
    docs = docs.select("doc_id", "text").unionByName(again)
    one, two = (toxicity.train(docs.repartition(p, F.rand(s)), labels.repartition(p)) for p, s in ((2, 1), (7, 2)))
    assert one.bias == two.bias and (one.weights == two.weights).all()


def test_scores_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs.select("doc_id", "text"), model).limit(40).collect():
        _, buckets = toxicity.features(Words(pa.array([r.text]), lower=True))
        by_hand = 1 / (1 + math.exp(-(model.bias + sum(float(np.float32(model.weights[b])) for b in buckets.tolist()))))
        assert abs(r.score - by_hand) < 1e-6


def test_the_risk_falls_and_is_never_below_zero():
    """The corrected risk of the fit, by plain loops, against that of the start; rare features alone must not win."""
    rng = np.random.default_rng(4)
    known = [np.unique(np.append(rng.integers(100, 4000, 20), [1, 2])) for _ in range(80)]
    other = [np.unique(np.append(rng.integers(100, 4000, 20), [1, 2] if i % 5 == 0 else [3])) for i in range(400)]

    def risk(model, prior=0.2):
        def f(row):
            return 1 / (1 + math.exp(-(model.bias + sum(model.weights[b] for b in row))))

        positive = sum(-math.log(f(r)) for r in known) / len(known)
        negative = sum(-math.log(1 - f(r)) for r in other) / len(other) - prior * sum(-math.log(1 - f(r)) for r in known) / len(known)
        return prior * positive + max(0.0, negative), f

    start, _ = risk(toxicity.Classifier(np.zeros(toxicity.BUCKETS), math.log(0.25)))
    end, f = risk(toxicity.fit(known, other, 0.2))
    assert 0 <= end < start / 2
    assert min(f(r) for r in known) > 0.5 > max(f(r) for i, r in enumerate(other) if i % 5)
