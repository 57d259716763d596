"""A random forest whose trees are fitted in groups where there are many rows."""

from __future__ import annotations

from math import ceil

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame

# (row, tree) pairs of one fit at most. The fit keeps about 12 bytes of each from pass to pass,
# so this bounds what it holds besides the rows, however many there are.
PAIRS = 400_000_000
# Between the seeds of groups: a partition draws its rows by the seed plus its own number.
SEED_STEP = 1_000_003


def group_sizes(rows: int, trees: int, pairs: int = PAIRS) -> list[int]:
    """Trees of each group; two at least, since a tree on its own is fitted without bootstrap."""
    groups = max(1, min(trees // 2, ceil(rows * trees / pairs)))
    return [trees // groups + (g < trees % groups) for g in range(groups)]


class GroupedForestClassifier(RandomForestClassifier):
    """Spark's forest; every tree is drawn from all rows of the dataset.

    Up to ``PAIRS`` (row, tree) pairs it is Spark's own fit. Beyond that the trees are
    fitted a group at a time, each group with a seed of its own, and put into one model.
    Rows, their layout and the seed alone decide the groups.
    """

    def _fit_java(self, dataset: DataFrame):
        sizes = group_sizes(dataset.count(), self.getNumTrees())
        if len(sizes) == 1:
            return super()._fit_java(dataset)
        rows = dataset.select(self.getFeaturesCol(), self.getLabelCol()).persist()
        try:
            groups = [
                self.copy({self.numTrees: size, self.seed: self.getSeed() + g * SEED_STEP})
                for g, size in enumerate(sizes)
            ]
            fitted = [super(GroupedForestClassifier, group)._fit_java(rows) for group in groups]
        finally:
            rows.unpersist()
        context = dataset.sparkSession.sparkContext
        classes = context._jvm.org.apache.spark.ml.classification
        trees = [tree for model in fitted for tree in model.trees()]
        array = context._gateway.new_array(classes.DecisionTreeClassificationModel, len(trees))
        for place, tree in enumerate(trees):
            array[place] = tree
        model = classes.RandomForestClassificationModel(
            self.uid, array, fitted[0].numFeatures(), fitted[0].numClasses()
        )
        self._transfer_params_to_java()
        return self._java_obj.copyValues(model, context._jvm.org.apache.spark.ml.param.ParamMap())
