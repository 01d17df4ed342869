"""Supervised model catalog on ``pyspark.ml`` with the reference's parameter
conventions, plus the two families Spark lacks as estimators (ridge
classifier, SAMME boosting) built from Spark fits, and an exact Gaussian
naive Bayes written as aggregates.

Contract: ``fit_model(name, task, train, val, hyperparams)`` ->
``(model, metrics DataFrame, effective hyperparameters)``.  Frames carry a
``features`` vector and a ``label`` double.
"""

from __future__ import annotations

import math
import time
import warnings

import numpy as np
import pandas as pd
from pyspark.ml import Model, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
    MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.functions.exprs import with_scalars

from loomkit.operators import metrics as M
from loomkit.operators.hinge import fit_wave_svc
from loomkit.operators.neighbours import KnnModel
from loomkit.operators.trees import ForestModel, fit_boosting, fit_extra_trees
from loomkit.session import written

MAX_TREE_DEPTH = 30  # Spark's limit


def _n_and_std(train: DataFrame) -> tuple[int, float, float, int]:
    r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sp"),
                  F.stddev_samp("label").alias("ss"),
                  F.count_distinct("label").alias("k")).first()
    return int(r["n"]), float(r["sp"] or 0.0), float(r["ss"] or 0.0), int(r["k"])


class ArgmaxOfRegressions(Model):
    """One regression per class on +-1 targets; prediction = argmax score."""

    def __init__(self, models: list, classes: list[float]):
        super().__init__()
        self.models, self.classes = models, classes

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.models):
            out = m.setPredictionCol(f"_s{i}").transform(out)
        if len(self.models) == 1:
            pred = F.when(F.col("_s0") >= 0, F.lit(self.classes[1])).otherwise(self.classes[0])
        else:
            best, best_v = F.lit(self.classes[0]), F.col("_s0")
            for i in range(1, len(self.models)):
                best = F.when(F.col(f"_s{i}") > best_v, F.lit(self.classes[i])).otherwise(best)
                best_v = F.greatest(best_v, F.col(f"_s{i}"))
            pred = best
        return out.withColumn("prediction", pred.cast("double")).drop(
            *[f"_s{i}" for i in range(len(self.models))])


class SammeModel(Model):
    """Weighted vote of depth-1 trees: argmax_c sum_t alpha_t [h_t(x) = c]."""

    def __init__(self, stumps: list, alphas: list[float], classes: list[float]):
        super().__init__()
        self.stumps, self.alphas, self.classes = stumps, alphas, classes

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        cols = []
        for t, m in enumerate(self.stumps):
            out = m.setPredictionCol(f"_h{t}").setRawPredictionCol(f"_r{t}") \
                   .setProbabilityCol(f"_p{t}").transform(out)
            cols.append(f"_h{t}")
        scores = [sum((F.when(F.col(h) == c, F.lit(a)).otherwise(0.0)
                       for h, a in zip(cols, self.alphas)), F.lit(0.0)) for c in self.classes]
        best, best_v = F.lit(self.classes[0]), scores[0]
        for c, s in zip(self.classes[1:], scores[1:]):
            best = F.when(s > best_v, F.lit(c)).otherwise(best)
            best_v = F.greatest(best_v, s)
        drop = [c for t in range(len(self.stumps)) for c in (f"_h{t}", f"_r{t}", f"_p{t}")]
        return out.withColumn("prediction", best.cast("double")).drop(*drop)


def fit_samme(train: DataFrame, rounds: int = 50, learning_rate: float = 1.0, seed: int = 42,
              checkpoint_every: int = 5) -> SammeModel:
    """AdaBoost SAMME: depth-1 trees with ``weightCol``; weights updated by a
    column expression; the weighted frame is checkpointed every few rounds."""
    from loomkit.session import cut_lineage

    classes = sorted(r[0] for r in train.select("label").distinct().collect())
    k = len(classes)
    n = train.count()
    cur = cut_lineage(train.select("features", "label").withColumn("w", F.lit(1.0 / n)))
    stumps, alphas = [], []
    for t in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=1, weightCol="w", seed=seed + t).fit(cur)
        pred = tree.setPredictionCol("_h").transform(cur).drop("rawPrediction", "probability")
        miss = (F.col("_h") != F.col("label")).cast("double")
        err = pred.agg((F.sum(F.col("w") * miss) / F.sum("w")).alias("e")).first()["e"]
        if err is None or err >= 1.0 - 1.0 / k:
            break
        err = max(err, 1e-12)
        alpha = learning_rate * (math.log((1 - err) / err) + math.log(k - 1))
        stumps.append(tree)
        alphas.append(alpha)
        if err <= 1e-12:
            break
        nxt = pred.withColumn("w", F.col("w") * F.exp(F.lit(alpha) * miss)).drop("_h")
        total = nxt.agg(F.sum("w")).first()[0]
        nxt = nxt.withColumn("w", F.col("w") / F.lit(total))
        cur = cut_lineage(nxt) if (t + 1) % checkpoint_every == 0 else nxt
    return SammeModel(stumps, alphas, classes)


class WeightedMedianOfTrees(Model):
    """AdaBoost.R2 prediction: the median of the trees' values, each with the
    weight ``log(1 / beta)``."""

    def __init__(self, trees: list, weights: list[float]):
        super().__init__()
        self.trees, self.weights = trees, weights

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for t, m in enumerate(self.trees):
            out = m.setPredictionCol(f"_h{t}").transform(out)
        votes = F.array_sort(F.array(*[F.struct(F.col(f"_h{t}").alias("p"), F.lit(w).alias("w"))
                                       for t, w in enumerate(self.weights)]))
        half = sum(self.weights) / 2.0
        reach = F.aggregate(votes, F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p")),
                            lambda a, v: F.struct((a["w"] + v["w"]).alias("w"), F.coalesce(
                                a["p"], F.when(a["w"] + v["w"] >= half - 1e-12, v["p"])).alias("p")))
        return out.withColumn("prediction", reach["p"]).drop(*[f"_h{t}" for t in range(len(self.trees))])


def fit_ada_r2(train: DataFrame, rounds: int = 50, learning_rate: float = 1.0, depth: int = 3,
               seed: int = 42, checkpoint_every: int = 5) -> WeightedMedianOfTrees:
    """AdaBoost.R2 with linear loss: trees of ``depth`` on ``weightCol``; the
    next weight is ``w * beta ** (learning_rate * (1 - error / largest error))``."""
    from loomkit.session import cut_lineage

    cur = cut_lineage(train.select("features", "label").withColumn("w", F.lit(1.0)))
    trees, weights = [], []
    for t in range(rounds):
        tree = DecisionTreeRegressor(maxDepth=depth, weightCol="w", seed=seed + t).fit(cur)
        pred = tree.setPredictionCol("_h").transform(cur).withColumn("_e", F.abs(F.col("_h") - F.col("label")))
        top = pred.agg(F.max("_e")).first()[0] or 0.0
        if top == 0.0:
            trees, weights = [*trees, tree], [*weights, 1.0 + 2.0 * sum(weights)]  # a perfect tree decides
            break
        loss = F.col("_e") / F.lit(top)
        mean = pred.agg(F.sum(F.col("w") * loss) / F.sum("w")).first()[0]
        if mean >= 0.5 and trees:
            break
        beta = max(mean, 1e-12) / max(1.0 - mean, 1e-12)
        trees.append(tree)
        weights.append(learning_rate * math.log(1.0 / beta) if mean < 0.5 else 1.0)
        if mean >= 0.5:
            break
        nxt = pred.withColumn("w", F.col("w") * F.pow(F.lit(beta), F.lit(learning_rate) * (1 - loss))).drop("_h", "_e")
        cur = cut_lineage(nxt) if (t + 1) % checkpoint_every == 0 else nxt
    return WeightedMedianOfTrees(trees, weights)


# ---------------------------------------------------------------- kernels

class RandomFourier(Transformer):
    """``sqrt(2 / n) cos(W x + b)``: a linear model over these columns is one
    with the kernel ``exp(-gamma |x - y|^2)``, up to sampling error."""

    def __init__(self, dim: int, gamma: float, n: int = 256, seed: int = 42):
        super().__init__()
        r = np.random.default_rng(seed)
        self.w = r.normal(0.0, math.sqrt(2.0 * gamma), (dim, n))
        self.b = r.uniform(0.0, 2.0 * math.pi, n)
        self.scale = math.sqrt(2.0 / n)

    def _transform(self, df: DataFrame) -> DataFrame:
        w, b, scale = self.w, self.b, self.scale

        @F.pandas_udf("array<double>")
        def waves(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            z = scale * np.cos(np.vstack(x.to_numpy()) @ w + b)
            return pd.Series(list(z))

        return df.withColumn("_rff", array_to_vector(waves(vector_to_array("features"))))


def kernel_gamma(train: DataFrame, gamma) -> tuple[int, float]:
    """Dimension and kernel width: ``scale`` is 1 / (d * variance of all
    entries), ``auto`` 1 / d, a number itself."""
    row = train.select(vector_to_array("features").alias("x")).select(
        F.size("x").alias("d"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("s"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("q")) \
        .agg(F.max("d").alias("d"), F.sum("d").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    d = int(row["d"])
    if gamma == "auto":
        return d, 1.0 / d
    if gamma != "scale":
        return d, float(gamma)
    var = row["q"] / row["n"] - (row["s"] / row["n"]) ** 2
    return d, 1.0 / (d * var) if var > 0 else 1.0


# ---------------------------------------------------------------- naive Bayes

def fit_gaussian_nb(train: DataFrame, feature_cols: list[str], label: str,
                    var_smoothing: float = 1e-9) -> DataFrame:
    """Per class: prior, mean and population variance of every feature (one
    ``groupBy``); ``var_smoothing * max feature variance`` added."""
    g = train.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"mu_{c}") for c in feature_cols],
        *[F.var_pop(c).alias(f"var_{c}") for c in feature_cols])
    eps = train.agg(F.greatest(*[F.var_pop(c) for c in feature_cols]).alias("e")) \
               .select((F.col("e") * var_smoothing).alias("eps"))
    total = train.agg(F.count(F.lit(1)).alias("total"))
    out = with_scalars(with_scalars(g, eps), total)
    for c in feature_cols:
        out = out.withColumn(f"var_{c}", F.col(f"var_{c}") + F.col("eps"))
    return out.withColumn("log_prior", F.log(F.col("n") / F.col("total"))).drop("eps", "total")


def predict_gaussian_nb(df: DataFrame, params: DataFrame, feature_cols: list[str], label: str,
                        key_cols: list[str]) -> DataFrame:
    """argmax_c log prior + sum log N(x | mu, var); ties -> smallest class.

    The parameter table (one row per class, bounded by the class count) is
    read once and turned into one log-likelihood expression per class: the
    scoring is a projection, with no join and no shuffle."""
    rows = sorted(params.collect(), key=lambda r: r[label])
    lls = []
    for r in rows:
        ll = F.lit(float(r["log_prior"]))
        for c in feature_cols:
            mu, var = float(r[f"mu_{c}"]), float(r[f"var_{c}"])
            ll = ll - F.lit(0.5 * math.log(2 * math.pi * var)) \
                - (F.col(c) - F.lit(mu)) ** 2 / F.lit(2 * var)
        lls.append((r[label], ll))
    best, best_v = F.lit(lls[0][0]), lls[0][1]
    for cls, ll in lls[1:]:  # strict '>' keeps the smallest class on ties
        best = F.when(ll > best_v, F.lit(cls)).otherwise(best)
        best_v = F.greatest(best_v, ll)
    return df.select(*key_cols, best.alias("prediction"))


class GaussianNbModel(Model):
    """Gaussian naive Bayes over the ``features`` vector."""

    def __init__(self, params: DataFrame, columns: list[str]):
        super().__init__()
        self.by_class, self.columns = params, columns

    def _transform(self, df: DataFrame) -> DataFrame:
        wide = spread_features(df, self.columns)
        return predict_gaussian_nb(wide, self.by_class, self.columns, "label", [*df.columns])


def spread_features(df: DataFrame, columns: list[str]) -> DataFrame:
    x = vector_to_array("features")
    return df.withColumns({c: x[i] for i, c in enumerate(columns)})


# ---------------------------------------------------------------- catalog

def _tree_params(hp: dict) -> dict:
    depth = hp.get("max_depth")
    if depth in (None, "None") or int(depth) > MAX_TREE_DEPTH:
        warnings.warn(f"max_depth={depth}: Spark's trees end at {MAX_TREE_DEPTH} levels", stacklevel=3)
    depth = MAX_TREE_DEPTH if depth in (None, "None") else min(int(depth), MAX_TREE_DEPTH)
    return {"maxDepth": depth, "minInstancesPerNode": int(hp.get("min_samples_leaf", 1))}


# What each boosting entry of the catalog starts from.
BOOSTING = {
    "gradient_boosting": {"n_estimators": 100, "max_depth": 3},
    "hist_gbm": {"n_estimators": 100, "max_depth": 3},
}
SECOND_ORDER = {
    "lightgbm": {"n_estimators": 200, "num_leaves": 31, "max_depth": -1, "min_child_samples": 20,
                 "min_child_weight": 1e-3, "reg_lambda": 0.0},
    "xgboost": {"n_estimators": 200, "max_depth": 6},
}


def _boosting(name: str, cls: bool, hp: dict, n_classes: int):
    """Spark's gradient-boosted trees under a catalog entry's parameters."""
    p = {**BOOSTING[name], **hp}
    depth = int(p.get("max_depth") or 3)
    depth = depth if depth >= 1 else MAX_TREE_DEPTH
    made = {"maxIter": int(hp.get("max_iter", p["n_estimators"])), "stepSize": float(p.get("learning_rate", 0.1)),
            "maxDepth": min(depth, MAX_TREE_DEPTH), "subsamplingRate": float(p.get("subsample", 1.0)),
            "minInstancesPerNode": int(p.get("min_samples_leaf", 1))}
    if name == "hist_gbm":  # bins finely
        made["maxBins"] = 255
    if not cls:
        return GBTRegressor(**made)
    gbt = GBTClassifier(**made)
    return gbt if n_classes <= 2 else OneVsRest(classifier=gbt)


def _second_order(name: str, cls: bool, hp: dict, n_classes: int, train: DataFrame) -> ForestModel:
    objective = "regression" if not cls else "binary" if n_classes <= 2 else "multiclass"
    return fit_boosting(train, objective, {**SECOND_ORDER[name], **hp})


def _extra_trees(cls: bool, hp: dict, train: DataFrame) -> ForestModel:
    depth = hp.get("max_depth")
    return fit_extra_trees(train, cls, int(hp.get("n_estimators", 100)),
                           None if depth in (None, "None") else int(depth),
                           hp.get("max_features", "sqrt" if cls else None),
                           int(hp.get("min_samples_leaf", 1)), int(hp.get("random_state", 42)))


def build_estimator(name: str, task: str, hp: dict, n: int, std_pop: float, std_samp: float,
                    n_classes: int):
    """Map a catalog name + reference-style hyperparameters to a Spark estimator."""
    cls = task != "regression"
    if name == "linear":
        return LinearRegression(regParam=0.0, solver="normal")
    if name == "ridge":
        alpha = float(hp.get("alpha", 1.0))
        reg = alpha / n * std_pop if std_pop else 0.0
        return LinearRegression(elasticNetParam=0.0, standardization=False, solver="normal",
                                regParam=reg)
    if name == "lasso":
        return LinearRegression(elasticNetParam=1.0, regParam=float(hp.get("alpha", 1.0)),
                                standardization=False, maxIter=int(hp.get("max_iter", 1000)))
    if name == "elasticnet":
        alpha, r = float(hp.get("alpha", 1.0)), float(hp.get("l1_ratio", 0.5))
        l1, l2 = alpha * r, alpha * (1 - r)
        reg = l1 + std_pop * l2
        return LinearRegression(regParam=reg, elasticNetParam=(l1 / reg if reg else 0.0),
                                standardization=False, solver="normal")
    if name == "logistic":
        c = float(hp.get("C", 1.0))
        reg = 0.0 if hp.get("penalty") == "none" else 1.0 / (c * n)
        return LogisticRegression(regParam=reg, standardization=False,
                                  maxIter=int(hp.get("max_iter", 1000)))
    if name == "svm":
        if hp.get("kernel", "rbf") not in ("linear", "poly", "rbf"):
            raise ValueError(f"parameter kernel={hp['kernel']!r} is not offered (linear, poly, rbf)")
        if not cls:
            return LinearRegression(loss="huber", regParam=1.0 / (float(hp.get("C", 1.0)) * n))
        svc = LinearSVC(regParam=1.0 / (float(hp.get("C", 1.0)) * n))
        return svc if n_classes <= 2 else OneVsRest(classifier=svc)
    if name == "decision_tree":
        p = _tree_params(hp)
        return DecisionTreeClassifier(**p) if cls else DecisionTreeRegressor(**p)
    if name == "random_forest":
        p = _tree_params(hp)
        p["numTrees"] = int(hp.get("n_estimators", 100))
        fs = hp.get("max_features", "sqrt" if cls else "all")
        p["featureSubsetStrategy"] = {"sqrt": "sqrt", "log2": "log2"}.get(str(fs), "all")
        return RandomForestClassifier(**p) if cls else RandomForestRegressor(**p)
    if name in BOOSTING:
        return _boosting(name, cls, hp, n_classes)
    if name == "mlp":
        if not cls:
            raise ValueError("parameter task='regression': Spark has no MLP regressor")
        if hp.get("activation", "relu") != "logistic":
            warnings.warn(f"activation={hp.get('activation', 'relu')}: Spark's MLP has sigmoid layers only", stacklevel=3)
        sizes = hp.get("hidden_layer_sizes", "(100,)")
        if isinstance(sizes, str):  # the catalog writes "(64,32)"
            sizes = [x for x in sizes.strip("()[] ").split(",") if x.strip()]
        return ("mlp", [int(h) for h in sizes], int(hp.get("max_iter", 200)))
    raise ValueError(f"unknown model: {name!r}")


CATALOG = ("linear", "ridge", "lasso", "elasticnet", "logistic", "svm", "decision_tree",
           "random_forest", "extra_trees", "gradient_boosting", "hist_gbm", "ada_boost", "mlp",
           "naive_bayes", "xgboost", "lightgbm", "knn")


def fit_model(name: str, task: str, train: DataFrame, val: DataFrame, hp: dict | None = None):
    """Fit on ``train``, score on ``val``; returns (model, metrics, hyperparams)."""
    hp = dict(hp or {})
    n, sp, ss, k = _n_and_std(train)
    cls = task != "regression"
    if name == "ridge" and cls:
        classes = sorted(r[0] for r in train.select("label").distinct().collect())
        targets = classes[1:] if len(classes) == 2 else classes
        models = []
        for c in targets:
            t = train.withColumn("label", F.when(F.col("label") == c, 1.0).otherwise(-1.0))
            est = build_estimator("ridge", "regression", hp, n, 1.0, 1.0, 2)
            models.append(est.fit(t))
        model = ArgmaxOfRegressions(models, classes)
    elif name == "naive_bayes":
        if not cls:
            raise ValueError("parameter task='regression': naive Bayes classifies")
        columns = [f"_f{i}" for i in range(len(train.select("features").first()[0]))]
        model = GaussianNbModel(fit_gaussian_nb(spread_features(train, columns), columns, "label",
                                                float(hp.get("var_smoothing", 1e-9))), columns)
    elif name in SECOND_ORDER:
        model = _second_order(name, cls, hp, k, train)
    elif name == "extra_trees":
        model = _extra_trees(cls, hp, train)
    elif name == "knn":
        model = KnnModel(train, hp, regression=not cls)
    elif name == "ada_boost" and not cls:
        model = fit_ada_r2(train, int(hp.get("n_estimators", 50)), float(hp.get("learning_rate", 1.0)))
    elif name == "ada_boost":
        model = fit_samme(train, int(hp.get("n_estimators", 50)),
                          float(hp.get("learning_rate", 1.0)))
    else:
        est = build_estimator(name, task, hp, n, sp, ss, k)
        if isinstance(est, tuple):
            d = len(train.select("features").first()[0])
            est = MultilayerPerceptronClassifier(layers=[d, *est[1], k], maxIter=est[2], seed=42)
        from pyspark.ml import Pipeline, PipelineModel
        if name == "svm" and hp.get("kernel", "rbf") == "rbf":
            waves = RandomFourier(*kernel_gamma(train, hp.get("gamma", "scale")))
            if cls:
                top = 2 if k <= 2 else int(train.agg(F.max("label")).first()[0]) + 1
                model = fit_wave_svc(train, waves.w, waves.b, waves.scale, 1.0 / (float(hp.get("C", 1.0)) * n), top)
            else:
                model = PipelineModel([waves, est.setFeaturesCol("_rff").fit(waves.transform(train))])
        elif name == "svm" and hp.get("kernel") == "poly":
            from pyspark.ml.feature import PolynomialExpansion
            est.setFeaturesCol("_poly")
            poly = PolynomialExpansion(degree=int(hp.get("degree", 3)), inputCol="features",
                                       outputCol="_poly")
            model = Pipeline(stages=[poly, est]).fit(train)
        else:
            model = est.fit(train)
    scored = model.transform(val)
    # read by every metric below: rows are scored once
    scored = written(scored.select(*[c for c in ("label", "prediction", "probability") if c in scored.columns]))
    if cls:
        mets = with_scalars(M.accuracy(scored, "label", "prediction"),
                            M.f1_macro(scored, "label", "prediction"))
        if "probability" in scored.columns:
            p = vector_to_array("probability")
            told = scored.select("label", p.alias("_p")).withColumn("_true", F.try_element_at("_p", F.col("label").cast("int") + 1))
            mets = with_scalars(mets, M.log_loss(told.where("_true is not null"), "_true"))
            if k == 2:
                mets = with_scalars(mets, M.auroc(told.withColumn("_p1", F.col("_p")[1]), "label", "_p1", positive=1.0))
            else:
                each = told.select("label", F.posexplode("_p").alias("_cls", "_score")) \
                    .withColumn("_cls", F.col("_cls").cast("double"))
                mets = with_scalars(mets, M.auroc_ovr(each, "label", "_cls", "_score")
                                    .withColumnRenamed("auroc_ovr", "auroc"))
    else:
        mets = M.regression(scored, "label", "prediction")
    return model, mets, hp


def auto_train(train: DataFrame, val: DataFrame, task: str, time_limit: float = 600.0,
               candidates: tuple = ("logistic", "random_forest", "gradient_boosting"),
               hyperparams: dict | None = None):
    """Fit candidates in order until the time budget is spent; leaderboard
    ranked on the validation metric (accuracy or r2); best = first row."""
    from pyspark import StorageLevel

    spark = train.sparkSession
    tr = train.persist(StorageLevel.MEMORY_AND_DISK)
    start, rows, models = time.time(), [], {}
    metric = "accuracy" if task != "regression" else "r2"
    if task == "regression":
        candidates = tuple("linear" if c == "logistic" else c for c in candidates)
    try:
        for c in candidates:
            if time.time() - start > time_limit:
                break
            t0 = time.time()
            model, mets, _ = fit_model(c, task, tr, val, (hyperparams or {}).get(c, {}))
            value = mets.select(metric).first()[0]
            rows.append((c, float(value) if value is not None else None, time.time() - t0))
            models[c] = model
    finally:
        tr.unpersist()
    board = spark.createDataFrame(rows, f"model string, {metric} double, fit_seconds double")
    from pyspark.sql import Window
    w = Window.orderBy(F.col(metric).desc_nulls_last(), F.col("model"))
    # the leaderboard has one row per candidate: a tiny, bounded frame
    board = board.withColumn("rank", F.row_number().over(w))
    best = board.orderBy("rank").first()
    return board, (models.get(best["model"]) if best else None)


__all__ = ["fit_model", "auto_train", "fit_samme", "fit_gaussian_nb", "predict_gaussian_nb",
           "build_estimator", "CATALOG", "Transformer"]
