"""The pipeline's stages on whole tables and odd rows, and the queries against their SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spendlens.llm.queries import ORACLES, QUERIES
from spendlens.session import materialize
from tests.compare import differences, duck
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


@pytest.mark.parametrize("table", ["small", "edges", "empty"])
def test_stages(spark, request, table):
    docs = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        rows, kept = ([tuple(r) for r in x.select("doc_id", "text").collect()] if "text" in x.columns else None for x in (before, docs))
        if name != "tokens":
            assert docs.columns == before.columns
        if name == "quality":
            assert not any(brute.counts(t)[-1] for _, t in kept)
        elif name == "lines":
            assert sorted(t or "" for _, t in kept) == sorted(w[2] for w in brute.kept_lines([t for _, t in rows], 10))
        elif name == "near_copies":
            root = brute.linked([brute.fingerprint(t) for _, t in rows])
            assert len(kept) == len(set(root.values()))
        elif name == "benchmark":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert len(kept) == sum(not w[-1] for w in brute.contamination([t for _, t in rows], items))
        else:
            assert docs.count() == len(rows) and docs.where(~F.col("round_trip")).count() == 0


def test_tokens_keep_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x", True, "d"), (2, None, 8, "y", False, "e")], "doc_id long, text string, n_tokens int, token_ids string, round_trip boolean, decoded string")
    made = materialize(corpus_pipeline.tokens(spark, docs, SF), "clash")
    assert sorted(made.columns) == ["decoded", "doc_id", "n_tokens", "round_trip", "token_ids"]
    assert [(r.doc_id, r.n_tokens, r.decoded, r.round_trip) for r in made.orderBy("doc_id").collect()] == [(1, 2, "d", True), (2, 0, "e", True)]


def test_near_copies_take_one_row_of_equal_id_and_text(spark):
    rows = [(1, "a b c d e f", x) for x in "zyx"] + [(2, "quite another text than that one", "w")]
    kept = [set(map(tuple, corpus_pipeline.near_copies(spark, spark.createDataFrame(rows[::step], "doc_id long, text string, source string").repartition(parts), SF).collect())) for step, parts in ((1, 1), (-1, 3))]
    assert len(kept[0]) == 2 and kept[0] == kept[1]


def test_run_is_the_stages(spark):
    made = corpus_pipeline.run(spark, SF)
    assert made.count() > 100 and "token_ids" in made.columns
