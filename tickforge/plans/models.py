"""Feature importance, tuning and ensembles on a seeded table of which one knows what matters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation, labels, learning
from ..sources import synthetic, views
from .base import query, rounded

FEATURES = ["I_0", "R_0", "N_0"]


def _rows(spark, n: int = 300):
    return synthetic.classification(spark, n, 1, 1, 1, seed=3)


def _importance(spark, method: str):
    got = learning.compare_importance(learning.forest(trees=5, depth=3), _rows(spark), FEATURES, "bin", (method,), key="id", start="t0", end="t1", k=2, weight="w")
    return rounded(got, "mean", "std", "accuracy", digits=4)


@query()
def importance_impurity(spark, sf):
    """Mean decrease of impurity over the trees of a forest."""
    return _importance(spark, "impurity")


@query()
def importance_permutation(spark, sf):
    """Mean decrease of out-of-sample accuracy by permuting a feature."""
    return _importance(spark, "permutation")


@query()
def importance_single(spark, sf):
    """Out-of-sample accuracy of each feature alone."""
    return _importance(spark, "single")


@query()
def importance_combined(spark, sf):
    """Means over two halves of the rows, each with its own forest."""
    x = _rows(spark)
    parts = [learning.impurity_importance(learning.forest(trees=5, depth=3).fit(learning.assembled(x.filter(F.col("id") % 2 == h), FEATURES, "bin", "w")), FEATURES) for h in (0, 1)]
    return rounded(spark.createDataFrame(learning.combine_importance(parts), "feature string, mean double, std double"), "mean", "std", digits=4)


@query()
def orthogonal_features(spark, sf):
    """Variances of the principal components that hold 95 % of the variance, and their eigenvalues."""
    out, values = learning.orthogonal_features(_rows(spark), FEATURES)
    row = out.agg(*[F.var_samp(f"pc_{i + 1}").alias(f"v{i}") for i in range(len(values))]).first()
    return rounded(spark.createDataFrame([(i + 1, float(v), row[f"v{i}"]) for i, v in enumerate(values)], "component int, eigenvalue double, variance double"), "eigenvalue", "variance", digits=5)


@query()
def sequential_bagging(spark, sf):
    """Trees on sequential bootstraps: accuracy on all rows by majority, and out of bag."""
    x = learning.assembled(_rows(spark), FEATURES, "bin", "w")
    spans = _rows(spark).select("id", F.explode(F.array(*[F.lit(b) for b in range(3)])).alias("bag"), F.col("id").alias("a"), (F.col("id") + 2).alias("z"))
    draws = labels.sequential_bootstrap(spans, by=["bag"], event="id", first="a", last="z").select("bag", "id")
    trees = learning.bootstrap_bagging(x, draws, "id", 3, depth=4)
    voted = learning.accuracy(learning.majority(trees, x), "__label", "prediction", by=[]).first()[0]
    return rounded(spark.createDataFrame([(float(voted), float(learning.out_of_bag(x, draws, "id", trees)))], "accuracy double, out_of_bag double"), "accuracy", "out_of_bag", digits=4)


@query()
def tuned_search(spark, sf):
    """Purged cross-validated accuracy of every setting of a small grid, best first."""
    x = _rows(spark)
    f = learning.purged_folds(x.select("id", "t0", "t1"), 2, by=[], start="t0", end="t1").persist()
    got = learning.search(lambda depth, trees: learning.forest(trees=trees, depth=depth), {"depth": [1, 3], "trees": [3]}, learning.assembled(x, FEATURES, "bin", "w"), f, "id")
    return rounded(spark.createDataFrame([(p["depth"], p["trees"], s) for p, s in got], "depth int, trees int, accuracy double"), "accuracy", digits=4)


@query()
def permuted_column(spark, sf):
    """A column dealt anew: as many rows, the same values, other places."""
    x = views.ticks(spark, sf).select("seq", "price")
    y = learning.permuted(x.withColumn("before", F.col("price")), "price", seed=5)
    return rounded(y.agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.avg((F.col("price") == F.col("before")).cast("double")).alias("same")), "total", "same", digits=3)


@query()
def rescaled_spectrum(spark, sf):
    """Eigenvalues of a covariance before and after the spectrum is held to a condition number of 5."""
    import numpy as np

    x = synthetic.correlated_returns(spark, 400, 4, 3, seed=2)
    _, cov, _ = allocation.matrices(allocation.moments(x, "asset", "t"))
    raised = allocation.rescale_spectrum(cov, 5.0)
    both = zip(np.linalg.eigvalsh(cov), np.linalg.eigvalsh(raised), strict=True)
    return rounded(spark.createDataFrame([(i, 1e4 * float(a), 1e4 * float(b)) for i, (a, b) in enumerate(both)], "place int, before double, after double"), "before", "after", digits=6)
