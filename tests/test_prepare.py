import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowdetect.operators.coarsen import prepare_flows
from flowdetect.operators.prepare import (
    FEATURES_COL,
    INDEXED_FEATURES_COL,
    distinct_per_feature,
    feature_index_report,
    fit_preparation,
    label_index_report,
)
from flowdetect.schema import LONG_COLS
from flowdetect.sources.events import read_event_flows

from tests.fixtures import flows


def test_tie_is_alphabetical(spark):
    df = prepare_flows(flows(spark, [{"appName": v} for v in ["b", "a", "c", "c"]]))
    prep = fit_preparation(df)
    assert list(prep.string_indexer.labelsArray[1]) == ["c", "a", "b"]


def test_label_never_a_feature(spark):
    prep = fit_preparation(prepare_flows(flows(spark, [{"Tag": "Attack"}, {}])))
    assert "Tag" not in prep.feature_names
    assert len(prep.text_cols) == 9 and prep.long_cols == LONG_COLS
    assert len(prep.feature_names) == 15


def test_label_index_most_frequent_first(spark):
    rows = [{"Tag": "Attack"}] * 5 + [{"Tag": "Normal"}] * 2
    coarse = prepare_flows(flows(spark, rows))
    prep = fit_preparation(coarse)
    assert prep.labels == ["Attack", "Normal"]
    got = {r["Tag"]: (r["indexedLabel"], r["n"]) for r in label_index_report(prep.transform(coarse)).collect()}
    assert got == {"Attack": (0.0, 5), "Normal": (1.0, 2)}


def test_small_long_domain_recoded(spark):
    rows = [{"destinationPort": p} for p in [22, 53, 80, 6667, 80]]
    coarse = prepare_flows(flows(spark, rows))
    prep = fit_preparation(coarse)
    slot = prep.feature_names.index("destinationPort")
    out = prep.transform(coarse).select(
        "destinationPort", vector_to_array(F.col(INDEXED_FEATURES_COL))[slot].alias("code")
    )
    assert dict(map(tuple, out.collect())) == {22: 0.0, 53: 1.0, 80: 2.0, 6667: 3.0}


def test_zero_keeps_code_zero(spark):
    rows = [{"totalSourcePackets": p} for p in [5, 0, 3]]
    coarse = prepare_flows(flows(spark, rows))
    prep = fit_preparation(coarse)
    slot = prep.feature_names.index("totalSourcePackets")
    out = prep.transform(coarse).select(
        "totalSourcePackets", vector_to_array(F.col(INDEXED_FEATURES_COL))[slot].alias("code")
    )
    assert dict(map(tuple, out.collect())) == {0: 0.0, 3: 1.0, 5: 2.0}


def test_many_text_values_stay_nominal(spark):
    rows = [{"source": f"10.{i}.1.1", "Tag": "Attack" if i % 3 else "Normal"} for i in range(37)]
    coarse = prepare_flows(flows(spark, rows))
    prep = fit_preparation(coarse)
    slot = prep.feature_names.index("source")
    assert slot not in prep.categorical_slots  # more than 10 values: not re-coded
    assert prep.max_arity() == 37  # still nominal through the vector: maxBins >= 37
    meta = prep.transform(coarse).schema[INDEXED_FEATURES_COL].metadata["ml_attr"]["attrs"]["nominal"]
    assert any(a["idx"] == slot and len(a["vals"]) == 37 for a in meta)


def test_reports(spark):
    rows = [{"appName": "SSH"}, {"appName": "SSH"}, {"appName": "DNS"}]
    coarse = prepare_flows(flows(spark, rows))
    prep = fit_preparation(coarse)
    prepared = prep.transform(coarse)
    fi = {(r["feature"], r["value"]): (r["idx"], r["n"]) for r in feature_index_report(prepared, prep.text_cols).collect()}
    assert fi[("appName", "SSH")] == (0.0, 2) and fi[("appName", "DNS")] == (1.0, 1)
    d = {r["feature"]: (r["n_distinct"], r["categorical"]) for r in distinct_per_feature(prepared, prep).collect()}
    assert d["appName"] == (2, True) and d["sourcePort"] == (1, True)
    assert prepared.schema[FEATURES_COL] is not None


def test_null_long_raises_by_default(spark):
    import pytest

    coarse = prepare_flows(flows(spark, [{"totalSourceBytes": None}, {}]))
    with pytest.raises(Exception):
        fit_preparation(coarse).transform(coarse).collect()


def test_null_tag_becomes_a_class(spark):
    coarse = prepare_flows(flows(spark, [{"Tag": None}, {"Tag": "Normal"}, {"Tag": "Normal"}]))
    prep = fit_preparation(coarse)
    assert prep.labels == ["Normal", "N/A"]


def test_fold_rare_values(spark):
    from flowdetect.operators.prepare import OTHER_VALUE, fold_rare_values

    rows = [{"source": "10.1.0.0"}] * 3 + [{"source": "10.2.0.0"}] * 2 + [{"source": f"10.{i}.9.9"} for i in range(3, 40)]
    coarse = prepare_flows(flows(spark, rows))
    folded = fold_rare_values(coarse, ["source", "appName"], 3)
    got = sorted(r[0] for r in folded.select("source").distinct().collect())
    # two most frequent kept (ties by value), the rest folded
    assert got == sorted(["10.1", "10.2", OTHER_VALUE])
    assert folded.where(f"source = '{OTHER_VALUE}'").count() == 37
    assert folded.count() == coarse.count()


def test_programs_max_categories(spark):
    from flowdetect.plans import programs

    run = programs.train_day(read_event_flows(spark, "/root/testdata/sf0.001"), "Jun12", num_trees=2, max_categories=8, max_bins="auto")
    try:
        assert run.preparation.max_arity() <= 8
        assert run.max_bins == 32
    finally:
        run.release()


def test_max_arity_counts_keep_bucket(spark):
    rows = [{"appName": v} for v in ["a", "b", "c"]]
    coarse = prepare_flows(flows(spark, rows))
    assert fit_preparation(coarse).max_arity() == 3
    assert fit_preparation(coarse, keep_unseen=True).max_arity() == 4


def test_fold_frequencies_from_fit_rows(spark):
    from flowdetect.operators.prepare import OTHER_VALUE, fold_rare_values

    rows = [{"appName": "A"}] * 3 + [{"appName": "B"}] * 5
    df = prepare_flows(flows(spark, rows))
    fit_rows = prepare_flows(flows(spark, [{"appName": "A"}]))
    folded = fold_rare_values(df, ["appName"], 2, fit_on=fit_rows)  # keeps the fit rows' top value
    got = sorted(r[0] for r in folded.select("appName").distinct().collect())
    assert got == ["A", OTHER_VALUE]


def test_arity_is_checked_before_the_fit(spark):
    from flowdetect.operators.prepare import check_arity

    coarse = prepare_flows(flows(spark, [{"appName": v} for v in ["a", "b", "c", "c"]]))
    check_arity(coarse, ["appName"], limit=3)
    with pytest.raises(ValueError, match="appName"):
        check_arity(coarse, ["appName", "Tag"], limit=2)


def test_training_rows_fit_honours_handle_invalid(spark):
    from flowdetect.plans import programs

    source = read_event_flows(spark, "/root/testdata/sf0.001")
    whole = programs.train_day(source, "Jun12", num_trees=1, fit_on="train", max_bins="auto")
    n = whole.n_rows()
    whole.release()
    assert n == source.where("day = 'Jun12'").count()
    holes = source.withColumn("totalSourceBytes", F.when(F.col("event_id") % 3 != 0, F.col("totalSourceBytes")))
    with pytest.raises(Exception):  # null numbers are an error by default, never a silent loss
        programs.train_day(holes, "Jun12", num_trees=1, fit_on="train", max_bins="auto").n_rows()
    some = programs.train_day(holes, "Jun12", num_trees=1, fit_on="train", handle_invalid="skip", max_bins="auto")
    assert some.n_rows() == holes.where("day = 'Jun12' and totalSourceBytes is not null").count()
    some.release()
