from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from latelane.ml import delay_model
from latelane.ml.scaling import MedianScaler
from latelane.operators import evaluation, metrics, split
from latelane.plans import drift
from latelane.plans.order_base import build_order_base
from latelane.sources.scratch import written
from latelane.sources.star import marketplace_tables

from .conftest import SMALL


@pytest.fixture(scope="module")
def delivered(spark):
    base = written(build_order_base(marketplace_tables(spark, SMALL)), "order_base")
    return metrics.delivered_only(base)


@pytest.fixture(scope="module")
def trained(delivered):
    return delay_model.train(delivered, trees=20, max_depth=6)


def labelled(spark, n=500):
    """A third of the rows equal to each other, the rest one by one."""
    rows = [(0 if i % 3 == 0 else i, None if i % 3 == 0 else i % 5, i % 4 == 0 and i % 3 != 0)
            for i in range(n)]
    return spark.createDataFrame(rows, "order_id int, review_score int, label boolean")


def test_split_is_exact_and_loses_nothing(spark):
    df = written(labelled(spark), "labelled")
    rows = split.stratified_split(df, "label")
    wanted = {r["label"]: round(r["count"] * 0.2) for r in df.groupBy("label").count().collect()}
    got = {r["label"]: r["n"] for r in rows.groupBy("label").agg(
        F.count_if("is_test").alias("n")).collect()}
    assert got == wanted
    assert Counter(map(tuple, rows.select(df.columns).collect())) == Counter(
        map(tuple, df.collect())
    )
    again = split.stratified_split(df.repartition(3), "label")
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, again.collect()))


def test_split_of_rows_with_their_hashes(spark):
    df = written(labelled(spark), "labelled")
    rows = split.stratified_split(written(split.with_hashes(df), "hashed"), "label")
    plain = split.stratified_split(df, "label")
    assert rows.columns == plain.columns
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, plain.collect()))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (rows, plain)]
    assert ["conv(" in p for p in plans] == [False, True]  # made once, with the rows


def test_rows_without_a_label_are_kept_out_of_the_test_part(spark):
    df = labelled(spark).withColumn("label", F.expr("case when order_id % 7 <> 1 then label end"))
    rows = split.stratified_split(written(df, "partly_labelled"), "label").collect()
    assert len(rows) == df.count()
    assert not any(r["is_test"] for r in rows if r["label"] is None)


def test_split_inside_a_group_of_copies(spark):
    df = spark.createDataFrame([(1, 1, True)] * 50 + [(i, 1, False) for i in range(10)],
                               "order_id int, review_score int, label boolean")
    rows = split.stratified_split(df, "label")
    got = Counter((r["label"], r["is_test"]) for r in rows.collect())
    assert got == {(True, True): 10, (True, False): 40, (False, True): 2, (False, False): 8}


def test_split_needs_two_rows_of_a_label(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1)],
                               "order_id int, review_score int, label int")
    with pytest.raises(ValueError):
        split.stratified_split(df, "label")


def test_approximate_split_share(delivered):
    rows = split.approximate_split(delivered)
    share = rows.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.1 < share < 0.3
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_sample_size_and_repeatability(delivered):
    first, second = (split.fixed_sample(delivered, 80).collect() for _ in range(2))
    assert len(first) == 80 and first == second
    with pytest.raises(ValueError):
        split.fixed_sample(delivered.limit(5), 80)


def test_scaler_uses_exact_median_and_population_deviation(spark):
    df = spark.createDataFrame([(1.0, None, 7.0), (2.0, None, 7.0), (3.0, None, 7.0),
                                (4.0, None, 7.0)], "a double, b double, c double")
    model = MedianScaler(inputCols=["a", "b", "c"]).fit(df)
    stats = {r["feature"]: tuple(r)[1:] for r in model.statistics(df).collect()}
    assert stats["a"] == (2.5, 2.5, pytest.approx(1.118034))
    assert stats["b"] == (0.0, 0.0, 1.0)
    assert stats["c"] == (7.0, 7.0, 1.0)
    new = spark.createDataFrame([(None, 3.0, 8.0)], "a double, b double, c double")
    assert tuple(model.transform(new).first())[3:] == (0.0, 3.0, 1.0)


def test_unseen_category_is_a_zero_vector(trained, delivered):
    row = delay_model.training_rows(delivered).limit(1)
    row = row.withColumn("customer_state", F.lit("elsewhere"))
    row = row.withColumn("payment_type_primary", F.lit(None).cast("string"))
    out = trained.model.transform(row).first()
    assert out["customer_state_slots"].numNonzeros() == 0
    seen = delivered.select("customer_state").distinct().count()
    assert out["customer_state_slots"].size == seen


def test_auc_equals_the_evaluator(spark):
    rows = [(float(i % 7 in (0, 3)), (i * 37 % 101) / 101 if i % 5 else 0.5) for i in range(2000)]
    df = spark.createDataFrame(rows, "label double, score double")
    ours = evaluation.roc_auc(df).first()["roc_auc"]
    exact = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert ours == pytest.approx(exact, abs=1e-12)


def test_auc_by_hand_and_one_sided(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5)], "label int, score double")
    assert evaluation.roc_auc(df).first()[0] == pytest.approx(3.5 / 4)
    assert evaluation.roc_auc(df.where("label = 1")).first()[0] is None


def test_report_by_hand(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4
    report = evaluation.classification_report(spark.createDataFrame(rows, "label int, prediction int"))
    found = {r["class"]: tuple(r)[1:] for r in report.collect()}
    assert found["1"] == pytest.approx((3 / 5, 3 / 4, 2 / 3, 4))
    assert found["0"] == pytest.approx((4 / 5, 4 / 6, 8 / 11, 6))
    assert found["accuracy"] == pytest.approx((0.7, 0.7, 0.7, 10))
    assert found["macro avg"] == pytest.approx((0.7, (0.75 + 4 / 6) / 2, (2 / 3 + 8 / 11) / 2, 10))
    assert found["weighted avg"][0] == pytest.approx((0.6 * 4 + 0.8 * 6) / 10)


def test_report_without_predictions_of_a_class(spark):
    report = evaluation.classification_report(
        spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    )
    assert tuple(report.where("class = '1'").first())[1:] == (0.0, 0.0, 0.0, 1)


def test_model_is_useful_repeatable_and_saved(spark, trained, delivered, tmp_path):
    assert trained.auc().first()[0] > 0.5
    assert trained.test_scores.where("score < 0 or score > 1").isEmpty()
    again = delay_model.train(delivered, trees=20, max_depth=6)
    assert sorted(trained.test_scores.collect()) == sorted(again.test_scores.collect())
    trained.model.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    rows = delay_model.training_rows(delivered)
    difference = delay_model.scored(trained.model, rows).exceptAll(delay_model.scored(loaded, rows))
    assert difference.isEmpty()


def test_model_does_not_depend_on_the_cluster(spark, delivered):
    scores = []
    for partitions in ("4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            trained = delay_model.train(delivered.repartition(int(partitions)), trees=10, max_depth=5)
            scores.append(sorted(map(tuple, trained.test_scores.collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert scores[0] == scores[1]


def test_fit_is_bounded_and_scoring_is_not(delivered):
    rows = written(delay_model.training_rows(delivered), "training_rows")
    some = delay_model.fitting_rows(rows, most=300)
    assert 200 < some.count() < 400 and some.rdd.getNumPartitions() == delay_model.FIT_PARTITIONS
    assert delay_model.fitting_rows(rows, most=10**9).count() == rows.count()
    trained = delay_model.train(delivered, trees=5, max_depth=3, max_training_rows=200)
    assert trained.test_scores.count() == pytest.approx(0.2 * rows.count(), abs=2)


@pytest.mark.parametrize(
    "rate, baseline, tier",
    [(0.56, 0.5, "retrain"), (0.53, 0.5, "watch"), (0.5, 0.5, "stable"),
     (0.5 * 1.1, 0.5, "watch"), (0.5 * 1.05, 0.5, "stable"), (0.0, 0.0, "stable"),
     (None, 0.5, None), (0.5, None, None)],
)
def test_tiers(spark, rate, baseline, tier):
    rates = spark.createDataFrame([(rate, baseline)],
                                  "expected_late_rate double, baseline_late_rate double")
    row = drift.with_tier(rates).first()
    assert row["tier"] == tier


def test_an_empty_batch_is_not_healthy(trained, delivered):
    row = drift.drift_check(trained.model, delivered.where("false"), delivered).first()
    assert (row["orders"], row["tier"], row["recommendation"]) == (0, None, "nothing to compare")


def test_missing_scores_are_counted(spark):
    rows = [(1, 0.9), (0, 0.1), (1, 0.1), (1, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "label int, score double")
    assert tuple(evaluation.roc_auc(df).first()) == (0.75, 2)
    assert tuple(evaluation.roc_auc(df.where("false")).first()) == (None, 0)
    odd = spark.createDataFrame([(1, float("inf")), (0, float("-inf")), (0, 1.7e308)], "label int, score double")
    assert tuple(evaluation.roc_auc(odd).first()) == (1.0, 0)


def test_drift_check_of_any_batch(trained, delivered):
    row = drift.drift_check(trained.model, delivered.where("is_late"), delivered).first()
    baseline = delivered.agg(F.avg(F.col("is_late").cast("int"))).first()[0]
    assert row["baseline_late_rate"] == pytest.approx(baseline)
    assert row["tier"] == "retrain" and row["orders"] == delivered.where("is_late").count()
    assert drift.sampled_drift_check(trained.model, delivered).first()["orders"] == 80


def test_fitting_rows_are_drawn_and_dealt_once(spark, delivered, monkeypatch):
    """Once counted, once dealt: no stage of the fit goes back to the whole training part."""
    passed, deal = spark.sparkContext.accumulator(0), delay_model.fitting_rows

    @F.udf("boolean")
    def seen(order_id):
        passed.add(1)
        return True

    def counted(training, *args):
        return deal(training.where(seen("order_id")), *args)

    monkeypatch.setattr(delay_model, "fitting_rows", counted)
    trained = delay_model.train(delivered, trees=2, max_depth=2)
    n = delivered.count() - trained.test_scores.count()
    assert 0 < passed.value <= 2 * n
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
