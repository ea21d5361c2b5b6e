"""The report sentences, spelled out: the SQL of these queries takes its wording from the library."""

import pytest

from spendlens.operators import insights

SPREADS = [
    # metric, kind, segment, highest, lowest, best, worst, new, returning
    ("CVR", "channel", "email", 0.25, 0.05, "web", "mobile", None, None),
    ("CVR", "user", "New vs Returning Users", 0.125, 0.0625, "new", "returning", 0.125, 0.0625),
    ("CVR", "city", "City Tier", 0.03125, 0.01, "2", "3", None, None),
    ("ROAS", "channel", "search", 4.5, 1.25, "mobile", "web", None, None),
    ("ROAS", "user", "New vs Returning Users", 3.0, 2.0, "returning", "new", 2.0, 3.0),
    ("ROAS", "city", "City Tier", 2.5, 2.25, "1", "2", None, None),
]

# The wording of the report.
FINDINGS = {
    ("CVR", 1): "email shows a CVR difference between web (CVR: 0.2500) and mobile (CVR: 0.0500).",
    ("CVR", 2): "New users have a CVR of 0.1250 while returning users have 0.0625.",
    ("CVR", 3): "City Tier 2 has the highest CVR of 0.0313, while City Tier 3 has the lowest at 0.0100.",
    ("ROAS", 1): "search shows a ROAS difference between mobile (ROAS: 4.5000) and web (ROAS: 1.2500).",
    ("ROAS", 2): "New users have a ROAS of 2.0000 while returning users have 3.0000.",
    ("ROAS", 3): "City Tier 1 has the highest ROAS of 2.5000, while City Tier 2 has the lowest at 2.2500.",
}
ACTION_STARTS = {
    ("CVR", 1): "Investigate user experience on mobile for email to identify friction points",
    ("CVR", 2): "Tailor marketing messages and landing pages specifically for new users",
    ("CVR", 3): "Study successful campaigns and user behavior in City Tier 2 and apply learnings to optimize strategies for City Tier 3.",
    ("ROAS", 1): "Reallocate ad spend from search on web to search on mobile or other high-performing segments",
    ("ROAS", 2): "Investigate why ROAS differs between new and returning users.",
    ("ROAS", 3): "Evaluate ad spend efficiency in lower performing City Tier 2.",
}


@pytest.fixture(scope="module")
def spreads(spark):
    columns = "metric string, segment_kind string, segment string, max_value double, min_value double, best_member string, worst_member string, new_value double, returning_value double"
    return spark.createDataFrame(SPREADS, columns).selectExpr("*", "max_value - min_value AS spread")


def test_findings_and_actions(spreads):
    rows = {(r.metric, r.rank): r for r in insights.segment_findings(insights.top_segments(spreads)).collect()}
    assert {k: r.finding for k, r in rows.items()} == FINDINGS
    for key, start in ACTION_STARTS.items():
        assert rows[key].action.startswith(start)
        assert rows[key].action.endswith(".") and "%" not in rows[key].action


def test_inefficiencies(spark):
    wasted = spark.createDataFrame(
        [("2024-03-01", "C006", "paid_social", 900.0, 0.5), ("2024-03-02", "C007", "email", 800.0, 0.1)],
        "date string, campaign_id string, channel string, spend double, ROAS double",
    )
    pairs = spark.createDataFrame(
        [("email", "web", 2.0), ("email", "mobile", 0.75), ("search", "web", None)], "channel string, device string, ROAS double"
    )
    first, second = insights.inefficiencies(wasted, pairs).orderBy("area_no").collect()
    assert first.area == "Campaign C006 (paid_social)"
    assert first.description == (
        "Campaign C006 on the paid_social channel has a high spend of 900.00 but a very low ROAS of 0.50, indicating that every "
        "dollar spent brings back 0.50 dollars of revenue."
    )
    assert second.area == "Channel: email, Device: mobile"
    assert second.description == (
        "The email channel on mobile devices exhibits the lowest ROAS (0.75), indicating significant inefficiency in ad spend "
        "for this segment."
    )
    assert [x.split(":")[0] for x in first.reasons] == [
        "Poor targeting", "Irrelevant ad copy/creative", "High competition/CPC", "Poor landing page experience", "Product/offer mismatch",
    ]
    assert [x.split(":")[0] for x in second.experiments] == [
        "Mobile-Specific Creative Testing", "Improve Mobile Landing Page Experience", "A/B Test Mobile CTA and Layout", "Refine Mobile Targeting",
    ]
    lines = insights.inefficiency_lines(insights.inefficiencies(wasted, pairs)).groupBy("area_no", "kind").count().collect()
    assert {tuple(r) for r in lines} == {(1, "reason", 5), (1, "experiment", 4), (2, "reason", 5), (2, "experiment", 4)}


def test_nothing_wasted_leaves_the_segment_only(spark):
    wasted = spark.createDataFrame([], "date string, campaign_id string, channel string, spend double, ROAS double")
    pairs = spark.createDataFrame([("email", "web", 2.0)], "channel string, device string, ROAS double")
    assert [r.area_no for r in insights.inefficiencies(wasted, pairs).collect()] == [2]
