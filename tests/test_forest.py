import math

import pytest
from pyspark.sql import functions as F

from flowdetect.operators.metrics import accuracy, evaluator_accuracy
from flowdetect.plans import programs
from flowdetect.sources.events import read_event_flows

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def one_day(spark):
    run = programs.train_day(read_event_flows(spark, SF01), "Jun14", num_trees=8)
    yield run
    run.release()


def test_importances_from_nodes_equal_spark(one_day):
    got = {r["slot"]: r["importance"] for r in one_day.importances().collect()}
    expected = one_day.forest.featureImportances.toArray()
    assert len(got) == len(expected) == 15
    for slot, value in got.items():
        assert math.isclose(value, expected[slot], abs_tol=1e-12)
    assert math.isclose(sum(got.values()), 1.0, abs_tol=1e-9)


def test_ranks(one_day):
    rows = sorted(one_day.importances().collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, 16))
    assert all(a["importance"] >= b["importance"] for a, b in zip(rows, rows[1:]))


def test_node_table(one_day):
    nodes = one_day.nodes()
    assert nodes.select("tree").distinct().count() == 8
    splits = nodes.where("is_split")
    assert splits.where("feature IS NULL OR gain IS NULL").count() == 0
    assert nodes.where("NOT is_split AND slot IS NOT NULL").count() == 0
    # a continuous split has a threshold, a nominal one its left categories
    assert splits.where("threshold IS NULL AND left_categories IS NULL").count() == 0


def test_accuracy_matches_evaluator_and_beats_majority(one_day):
    pred = one_day.predictions
    ours = one_day.test_error().collect()[0]
    assert math.isclose(ours["accuracy"], evaluator_accuracy(pred), abs_tol=1e-12)
    assert math.isclose(ours["test_error"], 1 - ours["accuracy"], abs_tol=1e-12)
    majority = pred.groupBy("Tag").count().agg(F.max("count")).collect()[0][0] / pred.count()
    assert ours["accuracy"] > majority


def test_decoded_labels(one_day):
    scored = one_day.scored()
    assert scored.where("prediction = indexedLabel AND predictedLabel <> Tag").count() == 0
    assert scored.where("prediction <> indexedLabel AND predictedLabel = Tag").count() == 0


def _flows(spark):
    return read_event_flows(spark, SF001)


def test_one_tag_day(spark):
    flows = _flows(spark).withColumn("Tag", F.lit("Normal"))
    run = programs.train_day(flows, "Jun12", num_trees=4)
    try:
        assert run.test_error().collect()[0]["test_error"] == 0.0
        assert all(r["importance"] == 0.0 for r in run.importances().collect())
    finally:
        run.release()


def test_attack_majority_decodes_right(spark):
    flows = _flows(spark).withColumn("Tag", F.when(F.col("Tag") == "Normal", "Attack").otherwise("Normal"))
    run = programs.train_day(flows, "Jun12", num_trees=4)
    try:
        assert run.preparation.labels[0] == "Attack"
        assert run.scored().where("prediction = indexedLabel AND predictedLabel <> Tag").count() == 0
    finally:
        run.release()


def test_third_tag(spark):
    flows = _flows(spark).withColumn(
        "Tag", F.when(F.col("appName") == "DNS", "Other").otherwise(F.col("Tag"))
    )
    run = programs.train_day(flows, "Jun13", num_trees=4)
    try:
        assert set(run.preparation.labels) == {"Normal", "Attack", "Other"}
        decoded = {r[0] for r in run.scored().select("predictedLabel").distinct().collect()}
        assert decoded <= {"Normal", "Attack", "Other"}
        assert run.scored().where("prediction = indexedLabel AND predictedLabel <> Tag").count() == 0
    finally:
        run.release()


def test_max_bins_default_and_raised(spark):
    run = programs.train_day(_flows(spark), "Jun12", num_trees=2, max_bins="auto")
    try:
        arity = run.preparation.max_arity()
        assert run.max_bins == max(32, arity)
    finally:
        run.release()
    fixed = programs.train_day(_flows(spark), "Jun12", num_trees=2)  # the original setting is the default
    try:
        assert fixed.max_bins == 10000 == fixed.forest.getMaxBins()
    finally:
        fixed.release()
    raised = programs.train_day(_flows(spark), "Jun12", num_trees=2, max_bins=2)  # raised to what the data needs
    try:
        assert raised.max_bins == arity
    finally:
        raised.release()


def _persisted(spark):
    return set(spark.sparkContext._jsc.getPersistentRDDs().keySet())


def test_a_failed_run_keeps_nothing_cached(spark):
    before = _persisted(spark)
    with pytest.raises(ValueError):
        programs.train_day(_flows(spark), "no such day", num_trees=2)
    assert _persisted(spark) <= before


def test_same_forest_from_any_partitioning(spark):
    found = []
    for n in (1, 20, 200):
        run = programs.train_day(_flows(spark).repartition(n), "Jun13", num_trees=3, max_bins="auto")
        found.append(run.importances().orderBy("slot").collect())
        run.release()
    assert found[0] == found[1] == found[2]


def test_every_day_needs_a_day_and_an_empty_csv_folder(spark, scratch):
    flows = _flows(spark)
    before = _persisted(spark)
    with pytest.raises(ValueError, match="no day"):
        programs.train_each_day(flows.withColumn("day", F.when(F.col("event_id") % 10 != 0, F.col("day"))), num_trees=1)
    csv = scratch("each-csv")
    programs.train_each_day(flows, ["Jun12"], num_trees=1, csv_path=csv, max_bins="auto")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        programs.train_each_day(flows, ["Jun12"], num_trees=1, csv_path=csv, max_bins="auto")
    programs.train_each_day(flows, ["Jun12"], num_trees=1, csv_path=csv, csv_mode="overwrite", max_bins="auto")
    assert _persisted(spark) <= before


def test_fit_on_train_only(spark):
    run = programs.train_day(_flows(spark), "Jun15", num_trees=2, fit_on="train")
    try:
        assert run.test_error().collect()[0]["n"] > 0
    finally:
        run.release()


def test_each_day_and_all_days(spark, scratch):
    flows = _flows(spark)
    csv = scratch("each-day-csv")
    res = programs.train_each_day(flows, ["Jun12", "Jun13"], num_trees=2, csv_path=csv, save_models=True)
    from flowdetect.session import local_path
    import os
    assert os.path.isdir(local_path(f"{res.path}/pipelines/day=Jun12/preparation"))
    errors = {r["day"]: r for r in res.test_error().collect()}
    assert set(errors) == {"Jun12", "Jun13"}
    conf = res.confusion().collect()
    assert sum(r["n"] for r in conf if r["day"] == "Jun12") == errors["Jun12"]["n"]
    by_day = res.importances().groupBy("day").agg(F.sum("importance").alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0, abs_tol=1e-9) for r in by_day)
    assert res.importances_wide().count() == 2
    back = spark.read.option("header", True).csv(csv)
    assert {r[0] for r in back.select("day").distinct().collect()} == {"Jun12", "Jun13"}
    n12 = flows.where("day = 'Jun12'").count()
    assert back.where("day = 'Jun12'").count() == n12

    run = programs.train_all_days(flows, num_trees=2)
    try:
        assert run.max_bins == 20000
        total = run.test_error().collect()[0]["n"]
        assert total == flows.count() - run.prepared.where("part = 'train'").count()
        assert accuracy(run.predictions, "indexedLabel", "prediction").count() == 6
    finally:
        run.release()


def test_same_seed_same_forest(spark):
    flows = read_event_flows(spark, SF01)
    a = programs.train_day(flows, "Jun16", num_trees=4)
    b = programs.train_day(flows.repartition(3), "Jun16", num_trees=4)
    try:
        assert a.forest.featureImportances.toArray().tolist() == b.forest.featureImportances.toArray().tolist()
        trees = lambda m: m.toDebugString.split("\n", 1)[1]  # noqa: E731  (first line names the uid)
        assert trees(a.forest) == trees(b.forest)
    finally:
        a.release()
        b.release()


def test_saved_pipelines_score_the_same(spark, scratch):
    from pyspark.ml import PipelineModel

    from flowdetect.operators.coarsen import prepare_flows

    flows = _flows(spark)
    run = programs.train_day(flows, "Jun14", num_trees=2)
    try:
        path = run.save(scratch("pipelines"))
        prep = PipelineModel.load(f"{path}/preparation")
        forest = PipelineModel.load(f"{path}/forest")
        rows = prepare_flows(flows.where("day = 'Jun14'"))
        again = forest.transform(prep.transform(rows)).select("event_id", "predictedLabel")
        ours = run.scored().select("event_id", "predictedLabel")
        assert ours.exceptAll(again.join(ours.select("event_id"), "event_id")).count() == 0
    finally:
        run.release()


def test_sample(one_day):
    rows = one_day.sample(5).collect()
    assert len(rows) == 5
    assert [r["event_id"] for r in rows] == sorted(r["event_id"] for r in rows)
    assert len(rows[0]["features"]) == 15
    first = one_day.scored().orderBy("event_id").limit(5).collect()
    assert [r["event_id"] for r in rows] == [r["event_id"] for r in first]


def test_recomputation_gives_the_same_rows(spark):
    """Dropping the cache and recomputing (as after a lost executor) changes nothing."""
    run = programs.train_day(_flows(spark), "Jun15", num_trees=2)
    before = sorted(map(tuple, run.scored().collect()))
    run.release()
    after = sorted(map(tuple, run.scored().collect()))
    assert before == after


def test_random_split_option(spark):
    flows = _flows(spark)
    run = programs.train_day(flows, "Jun12", num_trees=2, split="random")
    try:
        n_day = flows.where("day = 'Jun12'").count()
        n_test = run.test_error().collect()[0]["n"]
        assert 0 < n_test < n_day
        again = programs.train_day(flows, "Jun12", num_trees=2, split="random")
        assert again.test_error().collect()[0]["n"] == n_test  # seeded
        again.release()
    finally:
        run.release()
    with pytest.raises(ValueError):
        programs.train_day(flows, "Jun12", split="random", fit_on="train")


def test_same_forest_without_a_key_column(spark):
    flows = _flows(spark).drop("event_id")
    a = programs.train_day(flows, "Jun13", num_trees=3, split_key=None)
    b = programs.train_day(flows.repartition(4), "Jun13", num_trees=3, split_key=None)
    try:
        assert a.forest.featureImportances.toArray().tolist() == b.forest.featureImportances.toArray().tolist()
        assert a.test_error().collect()[0]["n"] == b.test_error().collect()[0]["n"]
    finally:
        a.release()
        b.release()


def test_sample_shows_the_assembled_features(spark, one_day):
    from pyspark.ml.functions import vector_to_array

    from flowdetect.operators.coarsen import prepare_flows

    sample = {r["event_id"]: list(r["features"]) for r in one_day.sample(5).collect()}
    rows = prepare_flows(read_event_flows(spark, SF01).where("day = 'Jun14'"))
    assembled = one_day.preparation.transform(rows).select("event_id", vector_to_array("features").alias("f"))
    expected = {r["event_id"]: list(r["f"]) for r in assembled.where(F.col("event_id").isin(list(sample))).collect()}
    assert sample == expected


def test_confusion_adds_up(one_day):
    conf = one_day.confusion().collect()
    err = one_day.test_error().collect()[0]
    assert sum(r["n"] for r in conf) == err["n"]
    hits = sum(r["n"] for r in conf if r["Tag"] == r["predictedLabel"])
    assert math.isclose(hits / err["n"], err["accuracy"], abs_tol=1e-12)


def test_forest_parameters_pass_through(spark):
    run = programs.train_day(
        _flows(spark), "Jun12", num_trees=2, subsampling_rate=0.5, rf_params={"maxMemoryInMB": 512, "minInstancesPerNode": 2}
    )
    try:
        f = run.forest
        assert f.getSubsamplingRate() == 0.5
        assert f.getOrDefault("maxMemoryInMB") == 512 and f.getOrDefault("minInstancesPerNode") == 2
    finally:
        run.release()


def test_day_without_flows_is_a_clear_error(spark):
    with pytest.raises(ValueError, match="Jun99"):
        programs.train_day(_flows(spark), "Jun99", num_trees=2)


def test_fit_on_train_with_folding(spark):
    run = programs.train_day(_flows(spark), "Jun15", num_trees=2, fit_on="train", max_categories=8)
    try:
        assert run.preparation.max_arity() <= 9  # 8 kept values (with the fold bucket) + the unseen index
        assert run.test_error().collect()[0]["n"] > 0
    finally:
        run.release()


def test_each_day_reuses_an_output_folder(spark, scratch):
    out = scratch("each-day-reuse")
    flows = _flows(spark)
    programs.train_each_day(flows, ["Jun12", "Jun13"], out_path=out, num_trees=2)
    second = programs.train_each_day(flows, ["Jun14"], out_path=out, num_trees=2)
    assert [r["day"] for r in second.test_error().collect()] == ["Jun14"]
    assert {r["day"] for r in second.importances().collect()} == {"Jun14"}


def test_each_day_matches_the_one_day_program(spark):
    flows = _flows(spark)
    one = programs.train_day(flows, "Jun14", num_trees=3)
    try:
        expected = {r["slot"]: r["importance"] for r in one.importances().collect()}
    finally:
        one.release()
    res = programs.train_each_day(flows, ["Jun14", "Jun15"], num_trees=3)
    got = {r["slot"]: r["importance"] for r in res.importances().where("day = 'Jun14'").collect()}
    assert got == expected


def test_node_table_scores_like_the_forest(spark, one_day):
    """Walk every tree of the node table with joins; the soft vote equals Spark's prediction."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import Window

    nodes = one_day.nodes().drop("day")
    n_trees = nodes.select("tree").distinct().count()
    rows = one_day.predictions.select(
        "event_id", vector_to_array("indexedFeatures").alias("f"), F.col("prediction").alias("spark_prediction")
    )
    at = rows.select(
        "event_id", "f", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"), F.lit(0).alias("node")
    )
    for _ in range(one_day.forest.getMaxDepth()):
        step = at.join(nodes, ["tree", "node"])
        value = F.element_at(F.col("f"), F.col("slot") + 1)
        go_left = F.when(F.col("threshold").isNotNull(), value <= F.col("threshold")).otherwise(
            F.array_contains(F.col("left_categories"), value)
        )
        nxt = F.when(F.col("is_split"), F.when(go_left, F.col("left_child")).otherwise(F.col("right_child"))).otherwise(
            F.col("node")
        )
        at = step.select("event_id", "f", "tree", nxt.alias("node"))
    leaves = at.join(nodes, ["tree", "node"]).where(~F.col("is_split"))
    total = F.aggregate("class_counts", F.lit(0.0), lambda a, x: a + x)
    votes = leaves.select("event_id", F.posexplode(F.transform("class_counts", lambda x: x / total)).alias("cls", "p"))
    summed = votes.groupBy("event_id", "cls").agg(F.sum("p").alias("v"))
    best = summed.withColumn(
        "r", F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("v").desc(), F.col("cls")))
    ).where("r = 1")
    ours = best.select("event_id", F.col("cls").cast("double").alias("walked"))
    joined = rows.join(ours, "event_id")
    assert joined.count() == rows.count()
    assert joined.where("walked <> spark_prediction").count() == 0


def test_the_source_is_read_once(spark):
    """Counts how often a source column is computed: once per row of the run, for one day and for every day."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    flows = _flows(spark)
    watched = flows.withColumn("totalSourcePackets", counted("totalSourcePackets"))
    run = programs.train_day(watched, "Jun12", num_trees=2, max_bins="auto")
    run.scored().count()
    run.release()
    one_day = flows.where("day = 'Jun12'").count()
    assert seen.value == one_day
    res = programs.train_each_day(watched, num_trees=2, max_bins="auto")
    assert res.test_error().count() == 6
    assert seen.value == one_day + flows.count()
