import datetime as dt
import json
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens import schemas
from spendlens.config import JobConfig
from spendlens.operators.cleaning import deduplicate
from spendlens.plans import analysis, budget, etl
from spendlens.plans.catalog import QUERIES
from spendlens.session import drop_scratch, materialize, shared_folder
from spendlens.sources import star
from spendlens.sources.files import load_raw, optional_source, read_csv, read_json
from spendlens.sources.profile import preview, profile, stored_positions
from spendlens.sources.sinks import rounded, write_report, write_table

SF = "/root/testdata/sf0.001"


def test_csv_missing_tokens_and_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("clicks,campaign_id,channel,date,spend,impressions,promo_flag\n5,C1,NA,2024-01-02,1.5,,1\nNaN,N/A,email,2024-01-03,null,7,0\n")
    rows = read_csv(spark, str(tmp_path / "a.csv"), schemas.AD_SPEND).orderBy("date").collect()
    assert (rows[0].date, rows[0].clicks, rows[0].channel, rows[0].impressions) == (dt.date(2024, 1, 2), 5, None, None)
    assert (rows[1].clicks, rows[1].campaign_id, rows[1].spend) == (None, None, None)


def test_csv_malformed_values(spark, tmp_path):
    (tmp_path / "u.csv").write_text("user_id,signup_date,city_tier\nu1,2024-01-01,1\nu2,yesterday,2\n")
    path = str(tmp_path / "u.csv")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv(spark, path, schemas.USERS).collect()
    assert [r.signup_date for r in read_csv(spark, path, schemas.USERS, strict=False).orderBy("user_id").collect()] == [dt.date(2024, 1, 1), None]


def test_csv_quotes_line_breaks_and_pointed_numbers(spark, tmp_path):
    (tmp_path / "c.csv").write_text('campaign_id,channel\n"Big ""sale"", spring",search\n"two\nlines",email\n')
    schema = T.StructType.fromDDL("campaign_id string, channel string")
    rows = read_csv(spark, str(tmp_path / "c.csv"), schema, multi_line=True).collect()
    assert [tuple(r) for r in rows] == [('Big "sale", spring', "search"), ("two\nlines", "email")]
    with pytest.raises(Exception, match="MALFORMED"):
        read_csv(spark, str(tmp_path / "c.csv"), schema).select("channel").collect()
    (tmp_path / "u.csv").write_text("user_id,signup_date,city_tier\nu1,2024-01-01,1.0\nu2,2024-01-02,\n")
    assert [r.city_tier for r in read_csv(spark, str(tmp_path / "u.csv"), schemas.USERS).orderBy("user_id").collect()] == [1, None]
    (tmp_path / "v.csv").write_text("user_id,signup_date,city_tier\nu1,2024-01-01,1.5\n")
    with pytest.raises(Exception, match="not a whole number"):
        read_csv(spark, str(tmp_path / "v.csv"), schemas.USERS).collect()
    assert read_csv(spark, str(tmp_path / "v.csv"), schemas.USERS, strict=False).first().city_tier is None


@pytest.mark.parametrize("row", ["C1", "C1,search,more"])
def test_csv_rows_of_another_length_raise_whatever_is_read(spark, tmp_path, row):
    (tmp_path / "c.csv").write_text(f"campaign_id,channel\nC0,email\n{row}\n")
    schema = T.StructType.fromDDL("campaign_id string")
    with pytest.raises(Exception, match="MALFORMED"):
        read_csv(spark, str(tmp_path / "c.csv"), schema).collect()


def test_first_row_in_file_order_wins(spark, tmp_path):
    for part in range(3):
        lines = "".join(f"{i},{part}-{n}\n" for n, i in enumerate(list(range(200)) * 2))
        (tmp_path / f"part-{part}.csv").write_text("key,payload\n" + lines)
    schema = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("payload", T.StringType())])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        kept = deduplicate(read_csv(spark, str(tmp_path), schema, keep_order=True), ["key"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.key, r.payload) for r in kept) == [(i, f"0-{i}") for i in range(200)]


def test_json_array_and_lines(spark, tmp_path):
    items = [{"product_id": f"p{i}", "category": "Home", "cost": i + 0.25} for i in range(3)]
    (tmp_path / "array.json").write_text(json.dumps(items, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(i) for i in items))
    array = read_json(spark, str(tmp_path / "array.json"), schemas.PRODUCTS)
    lines = read_json(spark, str(tmp_path / "lines.json"), schemas.PRODUCTS, json_lines=True)
    assert array.collect() == lines.collect() and float(array.collect()[2].cost) == 2.25


def test_absent_source_is_empty_but_other_errors_show(spark, tmp_path):
    empty = optional_source(lambda: read_csv(spark, str(tmp_path / "no.csv"), schemas.USERS), spark, schemas.USERS)
    assert empty.count() == 0 and empty.schema == schemas.USERS
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        optional_source(lambda: spark.range(1).select("nope"), spark, schemas.USERS)


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.125, 1), (0.375, 2), (2.5, 3)], "x double, n int")
    assert [r.x for r in rounded(df, 2).collect()] == [0.12, 0.38, 2.5]
    assert [r.x for r in rounded(df, 0).collect()][2] == 2.0


def test_sink_counts_sorts_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(2, 0.5), (None, 0.25), (1, 1.0)], "k int, x double")
    for _ in range(2):
        assert write_table(df, path, "csv", sort_by=["k"]).get["rows"] == 3
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    rows = [line for line in lines if line != "k,x"]
    assert rows[:2] == ["1,1.0", "2,0.5"] and rows[2].endswith(",0.25")
    write_report(df, path, 1)
    assert spark.read.csv(path, header=True).count() == 3


def test_partitioned_facts_are_pruned_on_read(spark, tmp_path):
    path = str(tmp_path / "fact")
    df = spark.range(100).selectExpr("id", "DATE '2024-01-01' + CAST(id % 4 AS INT) AS day")
    write_table(df, path, partition_by=["day"], sort_by=["id"])
    recent = spark.read.parquet(path).where("day >= DATE '2024-01-04'")
    assert recent.count() == 25 and "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().executedPlan().toString()


def test_materialized_tables_live_in_the_configured_folder(spark):
    folder = shared_folder(spark)
    stored = materialize(spark.range(3), "test")
    assert all(urlparse(f).path.startswith(urlparse(folder).path + "/") for f in stored.inputFiles())


def test_scratch_is_removed(spark):
    stored = materialize(spark.range(3), "test")
    folder = Path(stored.inputFiles()[0].removeprefix("file:")).parent
    assert folder.exists()
    drop_scratch(spark)
    assert not folder.exists()


def test_profile_and_preview(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    rows = {r.column_name: r for r in profile({"t": df}).collect()}
    assert (rows["a"].non_null, rows["b"].non_null, rows["b"].n_rows, rows["b"].data_type, rows["b"].n_columns) == (2, 1, 2, "string", 2)
    assert preview(df, 1).count() == 1


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_jobs_from_raw_files_to_reports(spark, tmp_path, file_format):
    """Raw CSV and JSON files -> facts -> analysis and budget reports, against the same queries on the tables."""
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    tables = star.raw_tables(spark, SF)
    for name, (file_name, schema) in schemas.RAW_FILES.items():
        df = tables[name]
        df = df.orderBy("ingest_seq") if "ingest_seq" in df.columns else df
        df = df.select(*schema.fieldNames())
        if name == "products":
            write_table(df.withColumn("cost", F.round("cost", 4)), str(raw / file_name), "json")
        elif name == "order_items":
            write_table(df.withColumn("quantity", F.col("quantity").cast("int")), str(raw / file_name), "csv")
        else:
            write_table(df, str(raw / file_name), "csv")
    # One JSON array, as the catalog file is delivered.
    lines = [json.loads(x) for f in sorted((raw / "products.json").glob("part-*")) for x in f.read_text().splitlines()]
    (raw / "products.json.array").write_text(json.dumps(lines))
    loaded = load_raw(spark, str(raw))
    assert loaded["sessions"].count() == tables["sessions"].count()
    assert read_json(spark, str(raw / "products.json.array"), schemas.PRODUCTS).count() == len(lines)

    (tmp_path / "src").mkdir()
    for name, (file_name, _) in schemas.RAW_FILES.items():
        target = tmp_path / "src" / file_name
        source = raw / "products.json.array" if name == "products" else raw / file_name
        target.symlink_to(source)
    config = JobConfig(str(tmp_path / "src"), out, file_format)
    counts = etl.run(spark, config)
    want = QUERIES["fact_sessions"](spark, SF)
    assert counts["fact_sessions"] == want.count()

    roas = {r.channel: r for r in QUERIES["channel_roas"](spark, SF).collect()}
    fact = etl.read_curated(spark, f"{out}/fact_channel_daily", schemas.FACT_CHANNEL_DAILY, file_format)
    for row in fact.groupBy("channel").agg(F.sum("attributed_revenue").alias("r"), F.sum("total_spend").alias("s")).collect():
        assert (float(row.r), float(row.s)) == pytest.approx((roas[row.channel].attributed_revenue, roas[row.channel].spend))

    budget.run(spark, config)
    share = {r.channel: float(r.allocated_spend) for r in spark.read.csv(f"{out}/budget_allocation", header=True).collect()}
    base = {r.channel: r.allocated_spend for r in QUERIES["allocate_share"](spark, SF).where("scenario_id = 'base'").collect()}
    assert share == pytest.approx(base, abs=0.02)
    assert spark.read.csv(f"{out}/budget_sensitivity", header=True).count() == 9

    analysis.run(spark, config)
    scores = spark.read.csv(f"{out}/analysis/regression_metrics", header=True, inferSchema=True).first()
    assert scores.mae == pytest.approx(QUERIES["regression_metrics"](spark, SF).first().mae, abs=1e-3)
    findings = spark.read.csv(f"{out}/analysis/segment_findings", header=True)
    assert findings.count() == 6
    reports = {p.name for p in (tmp_path / "out" / "analysis").iterdir()}
    assert reports == {
        "channel_roas", "top_campaigns_spend", "top_campaigns_revenue", "campaign_averages", "wasted_spend",
        "daily_trends", "weekly_trends", "promo_days", "promo_weeks", "segment_channel_device", "segment_new_user",
        "segment_city_tier", "category_performance", "segment_spreads", "segment_findings", "inefficiencies",
        "last_touch", "attributed_roas", "roas_comparison", "daily_regression", "regression_metrics",
        "regression_coefficients", "channel_performance", "bounds_allocation", "bounds_allocation_totals",
        "revenue_impact", "preceding_touch", "multi_touch",
    }
    assert spark.read.csv(f"{out}/budget_impact_totals", header=True).count() == 1


def test_analysis_turns_malformed_dates_into_nulls(spark, tmp_path):
    out = str(tmp_path / "out")
    columns = [f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schemas.FACT_SESSIONS]
    fact = QUERIES["fact_sessions"](spark, SF).selectExpr(*columns).withColumn("session_date", F.lit("some day"))
    write_table(fact.limit(50), f"{out}/fact_sessions", "csv")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / schemas.RAW_FILES["ad_spend"][0]).write_text(
        "date,campaign_id,channel,spend,impressions,clicks,promo_flag\nthen,C001,email,1,1,1,0\n2024-01-01,C001,email,1,1,1,0\n"
    )
    analysis.run(spark, JobConfig(str(tmp_path / "raw"), out, "csv"))
    assert spark.read.csv(f"{out}/analysis/daily_trends", header=True).count() == 1


def test_analysis_without_optional_files(spark, tmp_path):
    """Only the session fact exists: every report is written, those without input are empty."""
    out = str(tmp_path / "out")
    write_table(QUERIES["fact_sessions"](spark, SF).selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schemas.FACT_SESSIONS]), f"{out}/fact_sessions")
    analysis.run(spark, JobConfig(str(tmp_path / "nothing"), out))
    assert spark.read.csv(f"{out}/analysis/daily_trends", header=True).count() == 0
    assert spark.read.csv(f"{out}/analysis/segment_channel_device", header=True).count() == 10


def test_positions_follow_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).selectExpr("999 - id AS k").repartition(7).write.parquet(path)
    write_table(spark.read.parquet(path), str(tmp_path / "sorted"), sort_by=["k"])
    placed = stored_positions(spark, str(tmp_path / "sorted")).collect()
    assert sorted((r.position, r.k) for r in placed) == [(i, i) for i in range(1000)]
    raw = [r.position for r in stored_positions(spark, path).collect()]  # several files
    assert sorted(raw) == list(range(1000))
    spark.createDataFrame([], "k long").write.parquet(str(tmp_path / "none"))
    assert stored_positions(spark, str(tmp_path / "none")).collect() == []
