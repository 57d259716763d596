from types import SimpleNamespace

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

import __spark_entry__ as entry
from latelane.ml import delay_model, forest
from latelane.sources.scratch import written

ROWS = 2_600_000  # four fifths of them are over two million


def orders(spark, rows):
    """Delivered orders with whole numbers for features and few categories."""
    columns = {c: F.col("id") % (7 + n) for n, c in enumerate(delay_model.NUMERIC)}
    columns |= {c: F.format_string("%s", F.col("id") % (3 + n)) for n, c in enumerate(delay_model.CATEGORICAL)}
    late = (F.col("id") % 11 + F.col("id") * 7919 % 5) > 8
    return spark.range(rows).select(
        F.col("id").alias("order_id"), F.lit(5).alias("review_score"), late.alias("is_late"),
        *[c.alias(name) for name, c in columns.items()],
    )


@pytest.fixture(scope="module")
def many(spark):
    return written(orders(spark, ROWS), "many_orders")


@pytest.fixture(scope="module")
def features(spark):
    """Label and features of 3,000 orders, as the forest gets them."""
    rows = delay_model.fitting_rows(delay_model.training_rows(orders(spark, 3000)))
    before = delay_model.build_pipeline()
    before.setStages(before.getStages()[:-1])
    return written(before.fit(rows).transform(rows).select("order_id", "features", "label"), "features")


def of(many):
    """What a query is given, with the tables its report would need left out."""
    w = object.__new__(entry.Workspace)
    w.delivered, w.marts = many, {}
    return w


@pytest.mark.parametrize("query", ["late_model_metrics", "late_model_quality", "report_summary"])
def test_every_training_row_is_fitted(many, monkeypatch, query):
    class Fitted(Exception):
        pass

    def fit(rows):
        raise Fitted(rows.count(), rows.agg(F.count_distinct("order_id")).first()[0])

    def fifth(rows, *args):  # the split has tests of its own
        return rows.withColumn("is_test", F.col("order_id") % 5 == 0)

    monkeypatch.setattr(delay_model, "stratified_split", fifth)
    monkeypatch.setattr(delay_model, "with_hashes", lambda rows, seed: rows)
    monkeypatch.setattr(delay_model, "build_pipeline", lambda *a: SimpleNamespace(fit=fit))
    with pytest.raises(Fitted) as found:
        entry._queries()[query](of(many))
    assert found.value.args == (ROWS * 4 // 5,) * 2


def test_partitions_follow_the_rows(spark):
    rows = delay_model.training_rows(orders(spark, 5000))
    assert delay_model.fitting_rows(rows).rdd.getNumPartitions() == delay_model.FIT_PARTITIONS
    many = rows.crossJoin(spark.range(420).select())
    dealt = delay_model.fitting_rows(many)
    assert dealt.count() == 2_100_000 and dealt.rdd.getNumPartitions() == 34


@pytest.mark.parametrize(
    "rows, trees, groups",
    [(0, 200, 1), (2_000_000, 200, 1), (2_000_001, 200, 2), (6_388_080, 200, 4), (10**9, 200, 100),
     (10**9, 1, 1), (10**9, 5, 2)],
)
def test_sizes_of_groups(rows, trees, groups):
    sizes = forest.group_sizes(rows, trees)
    assert len(sizes) == groups and sum(sizes) == trees and max(sizes) - min(sizes) < 2
    assert min(sizes) >= min(2, trees)


def test_one_group_is_the_plain_forest(features):
    settings = {"numTrees": 8, "maxDepth": 4, "seed": 42}
    ours, plain = (
        kind(**settings).fit(features)
        for kind in (forest.GroupedForestClassifier, RandomForestClassifier)
    )
    assert ours.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]


def test_groups_make_one_forest(spark, features, monkeypatch, tmp_path):
    """Eleven trees in four groups: all of them, each from all rows, none fitted twice."""
    monkeypatch.setattr(forest.group_sizes, "__defaults__", (9_000,))
    counted, fit = [], RandomForestClassifier._fit_java

    def seen(self, rows):
        counted.append((rows.count(), self.getNumTrees()))
        return fit(self, rows)

    monkeypatch.setattr(RandomForestClassifier, "_fit_java", seen)
    settings = {"numTrees": 11, "maxDepth": 4, "seed": 42}
    model = forest.GroupedForestClassifier(**settings).fit(features)
    assert counted == [(3000, 3), (3000, 3), (3000, 3), (3000, 2)]
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    assert model.getNumTrees == 11 and len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) == 11
    assert all(t.numFeatures == model.numFeatures for t in model.trees) and model.numClasses == 2
    again = forest.GroupedForestClassifier(**settings).fit(features)
    PipelineModel(stages=[model]).write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    scores = [m.transform(features).select("order_id", "probability", "prediction") for m in (model, again, loaded)]
    first, *others = [sorted(x.collect()) for x in scores]
    assert others == [first, first]
    # The forest's probability is the mean of its trees'.
    row = features.first()["features"]
    mean = sum(t.predictProbability(row)[1] for t in model.trees) / 11
    assert model.predictProbability(row)[1] == pytest.approx(mean)
