"""Cross-validation without leaks, feature importance, tuning and ensembles on MLlib."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import full, ordered
from .align import indexed


def folds(rows: DataFrame, k: int, *, by: list[str], order: list[str]) -> DataFrame:
    """rows with place (from 0) and fold 0 .. k - 1: contiguous, the first ones one longer where sizes differ."""
    if not by and rows.schema[order[0]].dataType.typeName() not in ("string", "binary"):
        return _folds_of_one(rows, k, order)
    w = ordered(by, order)
    return rows.withColumns({"place": (F.row_number().over(w) - 1).cast("long"), "fold": (F.ntile(k).over(w) - 1).cast("long")})


def _folds_of_one(rows: DataFrame, k: int, order: list[str], ranges: int = 200) -> DataFrame:
    """folds() of one long table: rows are numbered within ranges of the first order column, after the rows of ranges before."""
    at = F.col(order[0])
    cut = rows.agg(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], 10_000).alias("__cuts"), F.count("*").alias("__n"))
    x = rows.crossJoin(F.broadcast(cut)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= at)))
    counts = x.groupBy("__range").agg(F.count("*").alias("__here"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over some 200 rows
    offsets = counts.select("__range", F.coalesce(F.sum("__here").over(before), F.lit(0)).alias("__before"))
    x = x.join(F.broadcast(offsets), "__range").withColumn("place", F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1)
    small, longer = F.expr(f"__n div {k}"), F.expr(f"__n % {k}")
    in_long = F.col("place") < longer * (small + 1)
    fold = F.when(in_long, F.floor(F.col("place") / (small + 1))).otherwise(longer + F.floor((F.col("place") - longer * (small + 1)) / F.greatest(small, F.lit(1))))
    return x.withColumns({"place": F.col("place").cast("long"), "fold": fold.cast("long")}).select(*rows.columns, "place", "fold")


def shuffled_folds(rows: DataFrame, k: int, *, by: list[str], key: str, seed: int = 0) -> DataFrame:
    """rows with place and fold 0 .. k - 1 in an order that the seed and the key give by hash, whatever the partitions."""
    dealt = rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))))
    return folds(dealt, k, by=by, order=["__h", key]).drop("__h")


def _join(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a with the few rows of b of its series; without series, b is broadcast."""
    return a.join(b, by) if by else a.crossJoin(F.broadcast(b))


def purged_folds(events: DataFrame, k: int, *, by: list[str], start: str, end: str, embargo: float = 0.0) -> DataFrame:
    """Rows (event..., place, fold, role) of each fold's test and train events.

    Train events end by the test block's first start, or stand at or after the first event that
    starts when the last test event has ended, plus int(n * embargo) places. Folds are few, so their
    bounds are joined to all events; no event is compared with another.
    """
    x = folds(events, k, by=by, order=[start])
    bounds = x.groupBy(*by, "fold").agg(F.min(start).alias("__t0"), F.max(end).alias("__t1"), F.min("place").alias("__a"), F.max("place").alias("__z"))
    n = x.groupBy(*by).agg(F.count("*").alias("__n"))
    own = x.withColumnRenamed("fold", "__own")
    after = _join(own, bounds, by).groupBy(*by, "fold").agg(F.sum((F.col(start) < F.col("__t1")).cast("long")).alias("__after"))
    edges = _join(bounds.join(after, [*by, "fold"]), n, by)
    late = F.col("place") >= F.col("__after") + F.floor(F.col("__n") * F.lit(embargo))
    test = (F.col("place") >= F.col("__a")) & (F.col("place") <= F.col("__z"))
    role = F.when(test, "test").when((F.col(end) <= F.col("__t0")) | late, "train")
    out = _join(own, edges, by).withColumn("role", role).filter("role is not null")
    return out.select(*events.columns, "place", "fold", "role")


def accuracy(scored: DataFrame, label: str, prediction: str, *, by: list[str], weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return scored.groupBy(*by).agg((F.sum(w * (F.col(label) == F.col(prediction)).cast("double")) / F.sum(w)).alias("accuracy"))


def log_loss(scored: DataFrame, label: str, p: str, *, by: list[str], weight: str | None = None, floor: float = 1e-15) -> DataFrame:
    """neg_log_loss of p, the probability of label 1, held to [floor, 1 - floor]."""
    w = F.col(weight) if weight else F.lit(1.0)
    q = F.greatest(F.least(F.col(p), F.lit(1 - floor)), F.lit(floor))
    own = F.ln(F.when(F.col(label) == 1, q).otherwise(1 - q))
    return scored.groupBy(*by).agg((F.sum(w * own) / F.sum(w)).alias("neg_log_loss"))


def confusion(scored: DataFrame, label: str, prediction: str, *, by: list[str]) -> DataFrame:
    return scored.groupBy(*by, label, prediction).agg(F.count("*").alias("n"))


def class_report(scored: DataFrame, label: str, prediction: str, *, by: list[str]) -> DataFrame:
    """precision, recall, f1 and support of each label; null where undefined."""
    c = confusion(scored, label, prediction, by=by)
    hit = F.sum(F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0))
    said = c.groupBy(*by, F.col(prediction).alias("class")).agg(F.sum("n").alias("__said"))
    was = c.groupBy(*by, F.col(label).alias("class")).agg(F.sum("n").alias("support"), hit.alias("__hit"))
    x = was.join(said, [*by, "class"], "full").withColumns({"precision": F.try_divide(F.coalesce("__hit", F.lit(0)).cast("double"), F.col("__said")), "recall": F.try_divide(F.col("__hit").cast("double"), F.col("support"))})
    return x.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("__said", "__hit")


def roc_curve(scored: DataFrame, label: str, p: str, *, by: list[str]) -> DataFrame:
    """(threshold, tpr, fpr): for each distinct score, the rates of rows at or above it."""
    x = scored.groupBy(*by, F.col(p).alias("threshold")).agg(F.sum((F.col(label) == 1).cast("long")).alias("__p"), F.sum((F.col(label) != 1).cast("long")).alias("__n"))
    w = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    share = lambda c: F.try_divide(F.sum(c).over(w).cast("double"), F.sum(c).over(full(by)))
    return x.select(*by, "threshold", share("__p").alias("tpr"), share("__n").alias("fpr"))


def roc_auc(scored: DataFrame, label: str, p: str, *, by: list[str]) -> DataFrame:
    """Area under the ROC curve by rank sums; ties count half."""
    x = scored.groupBy(*by, F.col(p).alias("__s")).agg(F.sum((F.col(label) == 1).cast("double")).alias("__p"), F.sum((F.col(label) != 1).cast("double")).alias("__n"))
    below = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("__w", F.col("__p") * (below + F.col("__n") / 2))
    return x.groupBy(*by).agg(F.try_divide(F.sum("__w"), F.sum("__p") * F.sum("__n")).alias("auc"))


# ---- models


def assembled(data: DataFrame, features: list[str], label: str, weight: str | None = None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    own = data.withColumns({"__label": (F.col(label) > 0).cast("double"), "__weight": F.col(weight).cast("double") if weight else F.lit(1.0)})
    return VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="skip").transform(own)


def forest(trees: int = 100, depth: int = 5, seed: int = 42, subset: str = "sqrt", **more):
    """A random forest over assembled() columns; subset "all" makes it bagged trees."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="__features", labelCol="__label", weightCol="__weight", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy=subset, **more)


def linear_svc(c: float = 1.0):
    """A linear support vector classifier; MLlib has no kernels."""
    from pyspark.ml.classification import LinearSVC

    return LinearSVC(featuresCol="__features", labelCol="__label", weightCol="__weight", regParam=1.0 / c, standardization=True)


def balanced_weights(data: DataFrame, label: str) -> DataFrame:
    """data with weight n / (classes * n of its class)."""
    w = Window.partitionBy(label)
    n = data.select(F.count("*").alias("__n"), F.count_distinct(label).alias("__k"))
    return data.crossJoin(F.broadcast(n)).withColumn("weight", F.col("__n") / (F.col("__k") * F.count("*").over(w))).drop("__n", "__k")


def score(model, test: DataFrame, metric: str) -> float:
    from pyspark.ml.functions import vector_to_array

    if metric not in ("accuracy", "neg_log_loss"):
        raise ValueError("metric must be accuracy or neg_log_loss")
    out = model.transform(test)
    if metric == "accuracy":
        return accuracy(out, "__label", "prediction", by=[], weight="__weight").first()[0]
    return log_loss(out.withColumn("__p", vector_to_array("probability")[1]), "__label", "__p", by=[], weight="__weight").first()[0]


def cross_validate(estimator, data: DataFrame, assigned: DataFrame, key: str, metric: str = "accuracy") -> list[float]:
    """One score a fold; assigned is purged_folds() of the same rows by `key`."""
    out = []
    for f in [r[0] for r in assigned.select("fold").distinct().orderBy("fold").collect()]:
        mine = assigned.filter(F.col("fold") == f).select(key, "role")
        x = data.join(mine, key).persist()  # fitting reads its rows several times
        out.append(score(estimator.fit(x.filter("role = 'train'")), x.filter("role = 'test'"), metric))
        x.unpersist()
    return out


def impurity_importance(model, features: list[str]) -> list[tuple[str, float, float]]:
    """(feature, mean, std of the mean) over trees, zeros left out, means summing to 1."""
    per = np.array([t.featureImportances.toArray() for t in model.trees])
    per[per == 0] = np.nan
    with np.errstate(all="ignore"):
        mean, std = np.nanmean(per, axis=0), np.nanstd(per, axis=0, ddof=1) * len(per) ** -0.5
    return [(f, float(m), float(s)) for f, m, s in zip(features, mean / np.nansum(mean), std, strict=True)]


def permuted(data: DataFrame, column: str, seed: int) -> DataFrame:
    """data with a column's values dealt anew among its rows: places of one order meet values of another."""
    a = indexed(data, "__i")
    b = indexed(data.select(F.col(column).alias("__v")).orderBy(F.rand(seed)), "__i")
    return a.join(b, "__i").withColumn(column, F.col("__v")).drop("__i", "__v")


def permutation_importance(estimator, raw: DataFrame, features: list[str], label: str, assigned: DataFrame, key: str, metric: str = "neg_log_loss", weight: str | None = None, seed: int = 1) -> list[tuple[str, float, float]]:
    """(feature, mean, std of the mean) of the share of a fold's score that goes when a feature is permuted."""
    shares: dict[str, list[float]] = {f: [] for f in features}
    for k in [r[0] for r in assigned.select("fold").distinct().orderBy("fold").collect()]:
        x = raw.join(assigned.filter(F.col("fold") == k).select(key, "role"), key).persist()
        model = estimator.fit(assembled(x.filter("role = 'train'"), features, label, weight))
        test = x.filter("role = 'test'")
        base = score(model, assembled(test, features, label, weight), metric)
        for i, f in enumerate(features):
            got = score(model, assembled(permuted(test, f, seed + i), features, label, weight), metric)
            room = -got if metric == "neg_log_loss" else 1 - got
            shares[f].append((base - got) / room if room else 0.0)
        x.unpersist()
    return [(f, float(np.mean(v)), float(np.std(v, ddof=1) * len(v) ** -0.5) if len(v) > 1 else 0.0) for f, v in shares.items()]


def single_importance(estimator, raw: DataFrame, features: list[str], label: str, assigned: DataFrame, key: str, metric: str = "accuracy", weight: str | None = None) -> list[tuple[str, float, float]]:
    """(feature, mean, std of the mean) of cross-validated scores with that feature alone."""
    out = []
    for f in features:
        v = cross_validate(estimator, assembled(raw, [f], label, weight), assigned, key, metric)
        out.append((f, float(np.mean(v)), float(np.std(v, ddof=1) * len(v) ** -0.5) if len(v) > 1 else 0.0))
    return out


def feature_importance(method: str, estimator, raw: DataFrame, features: list[str], label: str, *, key: str, start: str, end: str, k: int = 10, embargo: float = 0.0, metric: str = "accuracy", weight: str | None = None, seed: int = 1) -> tuple[list[tuple[str, float, float]], float]:
    """(importances, out-of-sample accuracy) of one method over purged folds of all rows: "impurity", "permutation" or "single".

    Each importance is (feature, mean, std of the mean); the accuracy is the folds' mean with all features.
    """
    if method not in ("impurity", "permutation", "single"):
        raise ValueError("method must be impurity, permutation or single")
    raw = raw.persist()  # every fold and feature reads the rows and their folds again
    assigned = purged_folds(raw.select(key, start, end), k, by=[], start=start, end=end, embargo=embargo).persist()
    data = assembled(raw, features, label, weight)
    accuracy_of_all = float(np.mean(cross_validate(estimator, data, assigned, key)))
    if method == "impurity":
        found = impurity_importance(estimator.fit(data), features)
    elif method == "permutation":
        found = permutation_importance(estimator, raw, features, label, assigned, key, metric, weight, seed)
    else:
        found = single_importance(estimator, raw, features, label, assigned, key, metric, weight)
    assigned.unpersist()
    raw.unpersist()
    return found, accuracy_of_all


def compare_importance(estimator, raw: DataFrame, features: list[str], label: str, methods: tuple[str, ...] = ("impurity", "permutation", "single"), **options) -> DataFrame:
    """(method, feature, mean, std, accuracy) of each method, one table for all."""
    rows = []
    for method in methods:
        found, score_of_all = feature_importance(method, estimator, raw, features, label, **options)
        rows += [(method, f, m, s, score_of_all) for f, m, s in found]
    return raw.sparkSession.createDataFrame(rows, "method string, feature string, mean double, std double, accuracy double")


def combine_importance(parts: list[list[tuple[str, float, float]]]) -> list[tuple[str, float, float]]:
    """Means of means and of deviations over chunks of the data."""
    names = [f for f, _, _ in parts[0]]
    return [(f, float(np.mean([p[i][1] for p in parts])), float(np.mean([p[i][2] for p in parts]))) for i, f in enumerate(names)]


def orthogonal_features(data: DataFrame, features: list[str], share: float = 0.95) -> tuple[DataFrame, list[float]]:
    """data with pc_1 .. pc_k, standardised features on the eigenvectors that hold `share` of variance, and their eigenvalues.

    Means, deviations and the correlation matrix are one aggregation; only the k x k solve is local.
    """
    n = len(features)
    aggs = [F.avg(f) for f in features] + [F.stddev_samp(f) for f in features] + [F.corr(features[i], features[j]) for i in range(n) for j in range(i)]
    row = list(data.agg(*aggs).first())
    mean, std = row[:n], row[n : 2 * n]
    corr, at = np.eye(n), 2 * n
    for i in range(n):
        for j in range(i):
            corr[i, j] = corr[j, i] = row[at] if row[at] is not None else 0.0
            at += 1
    values, vectors = np.linalg.eigh(corr)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(n)])
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12)) + 1
    z = [(F.col(f) - m) / (s or 1.0) for f, m, s in zip(features, mean, std, strict=True)]
    columns = {f"pc_{c + 1}": sum((z[i] * float(vectors[i, c]) for i in range(n)), F.lit(0.0)) for c in range(k)}
    return data.withColumns(columns), [float(v) for v in values[:k]]


def log_uniform(u: Column, low: float, high: float) -> Column:
    """Values whose logarithm is uniform, from uniform u."""
    return F.lit(low) * F.pow(F.lit(high / low), u)


def log_uniform_draws(n: int, low: float, high: float, seed: int) -> list[float]:
    rng = random.Random(seed)
    return [low * (high / low) ** rng.random() for _ in range(n)]


def search(make: Callable[..., object], grid: dict[str, list], data: DataFrame, assigned: DataFrame, key: str, metric: str = "accuracy", draws: int | None = None, seed: int = 0) -> list[tuple[dict, float]]:
    """Mean cross-validated score of each setting, best first: the whole grid, or `draws` of it at random."""
    settings: Iterator[tuple] | list[tuple] = list(product(*grid.values()))
    if draws is not None and draws < len(settings):
        settings = random.Random(seed).sample(settings, draws)
    out = [(dict(zip(grid, s, strict=True)), float(np.mean(cross_validate(make(**dict(zip(grid, s, strict=True))), data, assigned, key, metric)))) for s in settings]
    return sorted(out, key=lambda x: -x[1])


def bootstrap_bagging(data: DataFrame, draws: DataFrame, key: str, bags: int, depth: int = 5) -> list:
    """One decision tree a bag, each row weighted by how often the bag's sequential bootstrap drew it.

    draws has (bag, key) rows; predict with majority().
    """
    from pyspark.ml.classification import DecisionTreeClassifier

    out = []
    for b in range(bags):
        times = draws.filter(F.col("bag") == b).groupBy(key).agg(F.count("*").cast("double").alias("__times"))
        x = data.join(times, key).withColumn("__weight", F.col("__weight") * F.col("__times"))
        out.append(DecisionTreeClassifier(featuresCol="__features", labelCol="__label", weightCol="__weight", maxDepth=depth, seed=b).fit(x))
    return out


def majority(models: list, data: DataFrame) -> DataFrame:
    out, names = data, []
    for i, m in enumerate(models):
        m = m.copy()
        m.setPredictionCol(f"__p{i}").setRawPredictionCol(f"__r{i}").setProbabilityCol(f"__q{i}")
        out = m.transform(out).drop(f"__r{i}", f"__q{i}")
        names.append(f"__p{i}")
    votes = sum((F.col(c) for c in names), F.lit(0.0))
    return out.withColumn("prediction", (votes * 2 > len(names)).cast("double")).drop(*names)


def out_of_bag(data: DataFrame, draws: DataFrame, key: str, models: list) -> float:
    """Accuracy where each row is judged by the trees whose bags lack it."""
    votes = None
    for b, m in enumerate(models):
        mine = data.join(draws.filter(F.col("bag") == b).select(key).distinct(), key, "left_anti")
        p = m.transform(mine).select(key, "__label", "prediction")
        votes = p if votes is None else votes.unionByName(p)
    own = votes.groupBy(key, "__label").agg((F.avg("prediction") > 0.5).cast("double").alias("prediction"))
    return accuracy(own, "__label", "prediction", by=[]).first()[0]


def forecast_sharpe(scored: DataFrame, prediction: str, ret: str) -> DataFrame:
    """Mean over deviation of the return times the predicted side (1 for label 1, else -1)."""
    r = F.when(F.col(prediction) > 0, 1.0).otherwise(-1.0) * F.col(ret)
    return scored.agg(F.try_divide(F.avg(r), F.stddev_samp(r)).alias("sharpe"))


