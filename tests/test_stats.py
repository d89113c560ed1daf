from flowdetect.operators.stats import flow_count, flow_stats, tag_counts, tag_share

from tests.fixtures import flows


def test_null_tag_counts_zero(spark):
    df = flows(spark, [{"Tag": None}, {"Tag": "Normal"}, {"Tag": "Normal"}])
    got = {r["Tag"]: r["count"] for r in tag_counts(df).collect()}
    assert got == {None: 0, "Normal": 2}


def test_share_and_flows(spark):
    df = flows(
        spark,
        [{"Tag": "Attack"}, {"Tag": "Normal"}, {"Tag": "Normal"}, {"Tag": "Normal", "day": "Jun13"}],
    )
    got = {(r["day"], r["Tag"]): (r["count"], r["flows"], r["share"]) for r in flow_stats(df).collect()}
    assert got == {
        ("Jun12", "Attack"): (1, 3, 1 / 3),
        ("Jun12", "Normal"): (2, 3, 2 / 3),
        ("Jun13", "Normal"): (1, 1, 1.0),
    }
    shares = {(r["day"], r["Tag"]): r["share"] for r in tag_share(df).collect()}
    assert shares[("Jun12", "Normal")] == 2 / 3
    assert {r["day"]: r["flows"] for r in flow_count(df).collect()} == {"Jun12": 3, "Jun13": 1}


def test_all_null_day_share_is_null(spark):
    df = flows(spark, [{"Tag": None}])
    row = tag_share(df).collect()[0]
    assert row["count"] == 0 and row["share"] is None


def test_duplicates_kept_in_union(spark):
    a = flows(spark, [{"Tag": "Attack"}])
    assert a.unionByName(a).count() == 2
    assert tag_counts(a.unionByName(a)).collect()[0]["count"] == 2
