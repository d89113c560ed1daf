"""Property checks of the per-row rewrites against plain-Python models."""

from hypothesis import given, settings
from hypothesis import strategies as st

from flowdetect.functions.text import address_prefix, hour_text


def java_split_prefix(s: str, parts: int = 2) -> str:
    """Split on '.', drop trailing empty parts (Java's split), keep the first ``parts``, join."""
    pieces = s.split(".")
    while pieces and pieces[-1] == "":
        pieces.pop()
    if not pieces:  # Java returns [""] only for the empty string; all-dot text gives []
        return ""
    return ".".join(pieces[:parts])


def scala_hour(s: str) -> str:
    return s[11:][:2]


TEXT = st.text(alphabet=st.sampled_from(list("ab1.:/ ")), max_size=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=200, max_size=200))
def test_address_prefix_matches_java_split(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(address_prefix("s")).collect()]
    assert got == [java_split_prefix(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("0123456789-T:N/A")), max_size=22), min_size=200, max_size=200))
def test_hour_text_matches_drop_take(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(hour_text("s")).collect()]
    assert got == [scala_hour(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from(["Jun12", "Jun13", "Jun14"]), st.sampled_from(["Normal", "Attack", "Other", None])),
        min_size=1,
        max_size=60,
    )
)
def test_flow_stats_matches_counting(spark, rows):
    from collections import Counter

    from flowdetect.operators.stats import flow_stats

    df = spark.createDataFrame(rows, "day string, Tag string")
    got = {(r["day"], r["Tag"]): (r["count"], r["flows"], r["share"]) for r in flow_stats(df).collect()}

    per_day = Counter(d for d, _ in rows)
    tagged = Counter(d for d, t in rows if t is not None)
    groups = Counter(rows)
    expected = {}
    for (d, t), n in groups.items():
        count = n if t is not None else 0
        share = count / tagged[d] if tagged[d] else None
        expected[(d, t)] = (count, per_day[d], share)
    assert got.keys() == expected.keys()
    for k, (c, f, s) in expected.items():
        gc, gf, gs = got[k]
        assert (gc, gf) == (c, f)
        assert (gs is None and s is None) or abs(gs - s) < 1e-12


@settings(max_examples=4, deadline=None)
@given(st.floats(min_value=0.05, max_value=0.95))
def test_split_share_follows_the_fraction(spark, fraction):
    import hashlib

    from flowdetect.operators.split import PART_COL, split_threshold, with_split

    df = spark.range(0, 4000).withColumnRenamed("id", "event_id")
    got = {r["event_id"]: r[PART_COL] for r in with_split(df, fraction=fraction).collect()}
    threshold = split_threshold(fraction)
    expected = {
        k: "train" if hashlib.md5(str(k).encode()).hexdigest()[:8] < threshold else "test" for k in range(4000)
    }
    assert got == expected
    share = sum(v == "train" for v in got.values()) / len(got)
    assert abs(share - fraction) < 0.04
