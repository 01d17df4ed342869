"""Queries for supervised models (survey 2.5), attribution (2.9), search
(2.8) and batch scoring (2.10).  Fits are rows-only checks (metrics frames);
Gaussian naive Bayes is exact and has a DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkit.functions.exprs import with_scalars

from loomkit.functions.exprs import hash_unit
from loomkit.operators import supervised as SV
from loomkit.plans.registry import register, sql_hash
from loomkit.plans.q_splits import LI_KEY, LI_KEY_SQL, lineitem_keyed
from loomkit.session import load_table

_PLAN = [{"column": "o_orderkey", "op": "drop"}, {"column": "o_custkey", "op": "drop"},
         {"column": "o_orderstatus", "op": "drop"}, {"column": "o_totalprice", "op": "standard_scale"}]


def model_data(spark, sf, task: str):
    """orders -> (train, val) with ``features`` and ``label``.

    binary: status F; multiclass: status index; regression: total price from
    the other columns.  Hash split 80/20 on the order key."""
    from loomkit.operators.profile import coarse_schema_dict
    from loomkit.plans.features import build_feature_pipeline
    o = load_table(spark, sf, "orders")
    if task == "binary":
        o = o.withColumn("label", (F.col("o_orderstatus") == "F").cast("double"))
    elif task == "multiclass":
        o = o.withColumn("label", F.when(F.col("o_orderstatus") == "F", 0.0)
                         .when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0))
    else:
        o = o.withColumn("label", F.col("o_totalprice"))
    plan = _PLAN if task != "regression" else \
        [*_PLAN[:3], {"column": "o_totalprice", "op": "drop"}]
    u = hash_unit(42, "o_orderkey")
    train_raw = o.where(u < 0.8)
    schema = coarse_schema_dict(train_raw.drop("label"))
    fm = build_feature_pipeline(train_raw.drop("label"), plan, schema)
    feats = fm._transform(o.withColumn("_u", u), keep=["o_orderkey", "label", "_u"])
    return (feats.where(F.col("_u") < 0.8).drop("_u"), feats.where(F.col("_u") >= 0.8).drop("_u"))


def _fit_query(name, task, hp=None):
    def q(spark, sf):
        train, val = model_data(spark, sf, task)
        _model, mets, _ = SV.fit_model(name, "regression" if task == "regression" else
                                       "classification", train, val, hp or {})
        return mets.withColumn("model", F.lit(name))
    return q


for _name, _task, _hp in [
    ("linear", "regression", {}),
    ("ridge", "regression", {"alpha": 1.0}),
    ("ridge_classifier", "multiclass", {"alpha": 1.0}),
    ("lasso", "regression", {"alpha": 0.1}),
    ("elasticnet", "regression", {"alpha": 0.1, "l1_ratio": 0.5}),
    ("logistic", "binary", {"C": 1.0}),
    ("svm", "binary", {"C": 1.0}),
    ("decision_tree", "multiclass", {"max_depth": 5}),
    ("random_forest", "multiclass", {"n_estimators": 20, "max_depth": 5}),
    ("extra_trees", "multiclass", {"n_estimators": 20, "max_depth": 5}),
    ("gradient_boosting", "binary", {"n_estimators": 10}),
    ("hist_gbm", "regression", {"max_iter": 10}),
    ("ada_boost", "multiclass", {"n_estimators": 5}),
    ("mlp", "multiclass", {"hidden_layer_sizes": [8], "activation": "logistic", "max_iter": 50}),
    ("xgboost", "binary", {"n_estimators": 10, "max_depth": 3}),
    ("lightgbm", "regression", {"n_estimators": 10}),
]:
    _model = "ridge" if _name == "ridge_classifier" else _name
    register(f"fit_{_name}")(_fit_query(_model, _task, _hp))


# ------------------------------------------------- first splits against SQL

_SPLIT_FEATS = ["l_quantity", "l_discount", "l_tax"]


def _split_frame(spark, sf, label):
    from pyspark.ml.functions import array_to_vector
    li = load_table(spark, sf, "lineitem")
    return li.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in _SPLIT_FEATS])).alias("features"),
                     label.cast("double").alias("label"))


def _first_splits(spark, model):
    """The root split of every tree (one row a tree of the model)."""
    f = model.forest
    rows = [(t, _SPLIT_FEATS[f.feature[r]], f.threshold[r], f.value[f.left[r]][0], f.value[f.left[r] + 1][0])
            for t, r in enumerate(f.roots) if f.feature[r] >= 0]
    return spark.createDataFrame(rows, "tree int, feature string, threshold double, left_value double, right_value double")


def _long_sql(label_sql: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS feature, {c}::DOUBLE AS v, ({label_sql})::DOUBLE AS y FROM lineitem"
                              for i, c in enumerate(_SPLIT_FEATS))


@register("fit_xgboost_split", f"""
WITH u AS ({_long_sql("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END")}), m AS (SELECT avg(y) AS p FROM u WHERE i = 0),
c AS (SELECT i, feature, v, sum(p - y) AS g, sum(p * (1 - p)) AS h FROM u, m GROUP BY i, feature, v),
w AS (SELECT *, sum(g) OVER (PARTITION BY i ORDER BY v) AS gl, sum(h) OVER (PARTITION BY i ORDER BY v) AS hl,
        sum(g) OVER (PARTITION BY i) AS ga, sum(h) OVER (PARTITION BY i) AS ha FROM c)
SELECT 0::INT AS tree, feature, v AS threshold, round(-0.5 * gl / (hl + 1), 6) AS left_value,
  round(-0.5 * (ga - gl) / (ha - hl + 1), 6) AS right_value FROM w WHERE hl >= 1 AND ha - hl >= 1
ORDER BY gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) DESC, i, v LIMIT 1""", digits=6)
def q_fit_xgboost_split(spark, sf):
    """One round with one split: the largest gain of the whole gradient table."""
    data = _split_frame(spark, sf, F.col("l_returnflag") == "R")
    return _first_splits(spark, SV.fit_boosting(data, "binary", {"n_estimators": 1, "max_depth": 1, "learning_rate": 0.5}))


_ET_TREES = 7


@register("fit_extra_trees_split", f"""
WITH u AS ({_long_sql("l_linenumber")}), r AS (SELECT i, min(v) AS low, max(v) AS high FROM u GROUP BY i),
k AS (SELECT t, i, low + (('0x' || substr(md5('42:' || t || ':1:' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE)
        * (high - low) AS cut FROM r, range({_ET_TREES}) x(t)),
g AS (SELECT i, feature, v, count(*) AS n, sum(y) AS s FROM u GROUP BY i, feature, v),
c AS (SELECT t, i, feature, cut, sum(n) FILTER (v <= cut) AS nl, sum(s) FILTER (v <= cut) AS sl,
        sum(n) FILTER (v > cut) AS nr, sum(s) FILTER (v > cut) AS sr FROM g JOIN k USING (i) GROUP BY t, i, feature, cut),
b AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY sl * sl / nl + sr * sr / nr DESC, i) AS rn FROM c
      WHERE nl > 0 AND nr > 0),
m AS (SELECT avg(y) AS mean FROM u WHERE i = 0)
SELECT t::INT AS tree, feature, round(cut, 6) AS threshold, round(sl / nl - mean, 6) AS left_value,
  round(sr / nr - mean, 6) AS right_value FROM b, m WHERE rn = 1""", digits=6)
def q_fit_extra_trees_split(spark, sf):
    """Depth-1 trees: each takes the best of three random thresholds (values
    are leaf means around the mean of all)."""
    return _first_splits(spark, SV.fit_extra_trees(_split_frame(spark, sf, F.col("l_linenumber")), False, _ET_TREES,
                                                   max_depth=1))


@register("auto_train")
def q_auto_train(spark, sf):
    train, val = model_data(spark, sf, "binary")
    board, _best = SV.auto_train(train, val, "classification", time_limit=120,
                                 candidates=("logistic", "decision_tree", "random_forest"),
                                 hyperparams={"decision_tree": {"max_depth": 8},
                                              "random_forest": {"n_estimators": 20,
                                                                "max_depth": 8}})
    return board


_NB_FEATS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
_NB_TRAIN = f"(SELECT * FROM lineitem WHERE {sql_hash(42, LI_KEY_SQL)} < 0.7)"


@register("fit_naive_bayes", f"""
WITH e AS (SELECT greatest({', '.join(f'var_pop({c})' for c in _NB_FEATS)}) * 1e-9 AS eps FROM {_NB_TRAIN}),
p AS (SELECT l_returnflag AS cls, ln(count(*) / (SELECT count(*) FROM {_NB_TRAIN})) AS lp,
        {', '.join(f'avg({c}) AS mu_{c}, var_pop({c}) + (SELECT eps FROM e) AS var_{c}' for c in _NB_FEATS)}
      FROM {_NB_TRAIN} GROUP BY l_returnflag),
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cls,
        lp {''.join(f' - 0.5 * ln(2 * pi() * var_{c}) - pow({c} - mu_{c}, 2) / (2 * var_{c})' for c in _NB_FEATS)} AS ll
      FROM lineitem, p),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
        ORDER BY ll DESC, cls) AS rn FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cls AS prediction FROM r WHERE rn = 1""")
def q_fit_naive_bayes(spark, sf):
    li = lineitem_keyed(spark, sf)
    train = li.where(hash_unit(42, *LI_KEY) < 0.7)
    params = SV.fit_gaussian_nb(train, _NB_FEATS, "l_returnflag")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_price_cents"]
    out = SV.predict_gaussian_nb(li, params, _NB_FEATS, "l_returnflag", keys)
    return out.drop("l_price_cents")


# ---------------------------------------------------------------- attribution

def _li_lr(spark, sf, feats):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    li = load_table(spark, sf, "lineitem")
    va = VectorAssembler(inputCols=feats, outputCol="features")
    model = LinearRegression(labelCol="l_extendedprice", solver="normal").fit(va.transform(li))
    return li, va, model


@register("shap_linear", """
SELECT 'l_quantity' AS feature, round(abs(regr_slope(l_extendedprice, l_quantity)) *
  avg(abs(l_quantity - (SELECT avg(l_quantity) FROM lineitem))), 2) AS importance FROM lineitem""")
def q_shap_linear(spark, sf):
    from loomkit.functions.exprs import r6
    from loomkit.operators.explain import shap_linear
    li, _va, model = _li_lr(spark, sf, ["l_quantity"])
    out = shap_linear(li, {"l_quantity": float(model.coefficients[0])})
    return out.withColumn("importance", r6("importance", 2))


_SHAP_VALUES_SQL = """(SELECT feature, cls, (x - m) * w AS value FROM (
  SELECT 'l_quantity' AS feature, l_quantity AS x, (SELECT avg(l_quantity) FROM lineitem) AS m FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount, (SELECT avg(l_discount) FROM lineitem) FROM lineitem
  UNION ALL SELECT 'l_tax', l_tax, (SELECT avg(l_tax) FROM lineitem) FROM lineitem) v,
  (SELECT * FROM (VALUES ('A', 1.0), ('N', -1.0), ('R', 0.5)) t(cls, w)) c)"""


def _shap_values(spark, sf):
    li = load_table(spark, sf, "lineitem")
    feats = ["l_quantity", "l_discount", "l_tax"]
    means = li.agg(*[F.avg(c).alias(c) for c in feats])
    j = with_scalars(li.select(*feats), means.select(*[F.col(c).alias(f"m_{c}") for c in feats]))
    per_f = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) - F.col(f"m_{c}")).alias("d"))
                      for c in feats])
    cls = F.array(*[F.struct(F.lit(k).alias("cls"), F.lit(w).alias("w"))
                    for k, w in [("A", 1.0), ("N", -1.0), ("R", 0.5)]])
    return j.select(F.explode(per_f).alias("f"), cls.alias("cs")) \
            .select("f.*", F.explode("cs").alias("c")) \
            .select("feature", "c.cls", (F.col("d") * F.col("c.w")).alias("value"))


@register("shap_aggregate", f"""
SELECT feature, round(avg(abs(value)), 6) AS importance FROM {_SHAP_VALUES_SQL} GROUP BY feature""")
def q_shap_aggregate(spark, sf):
    from loomkit.functions.exprs import r6
    from loomkit.operators.explain import shap_aggregate
    return shap_aggregate(_shap_values(spark, sf)).withColumn("importance", r6("importance"))


@register("importance_top20", """
WITH g AS (SELECT p_brand AS feature, avg(l_discount) AS a FROM lineitem JOIN part ON l_partkey = p_partkey
           GROUP BY p_brand),
i AS (SELECT feature, round(abs(a - (SELECT avg(l_discount) FROM lineitem)), 6) AS importance FROM g)
SELECT * FROM i ORDER BY importance DESC, feature LIMIT 20""")
def q_importance_top20(spark, sf):
    from loomkit.functions.exprs import r6
    from loomkit.operators.explain import importance_top
    li = load_table(spark, sf, "lineitem")
    part = load_table(spark, sf, "part").select("p_partkey", "p_brand")
    g = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("feature")).agg(F.avg("l_discount").alias("a"))
    overall = li.agg(F.avg("l_discount").alias("o"))
    imp = with_scalars(g, overall).select(
        "feature", r6(F.abs(F.col("a") - F.col("o"))).alias("importance"))
    return importance_top(imp, 20)


@register("importance_permutation")
def q_importance_permutation(spark, sf):
    from loomkit.operators import metrics as M
    from loomkit.operators.explain import permutation_importance
    from loomkit.plans.q_splits import LI_KEY, lineitem_keyed
    feats = ["l_quantity", "l_discount", "l_tax"]
    _li, va, model = _li_lr(spark, sf, feats)
    li = lineitem_keyed(spark, sf)

    def score(scored):
        return M.regression(scored, "l_extendedprice", "prediction").select("r2")

    return permutation_importance(model, li, feats, LI_KEY, va.transform, score)


@register("shap_sampled")
def q_shap_sampled(spark, sf):
    from loomkit.operators.explain import shap_aggregate, shap_sampled
    from loomkit.operators.splits import sample_head_capped
    from loomkit.plans.q_splits import LI_KEY, lineitem_keyed
    feats = ["l_quantity", "l_discount", "l_tax"]
    _li, va, model = _li_lr(spark, sf, feats)
    li = lineitem_keyed(spark, sf)
    # the reference explains at most 200 rows against 50 background rows
    explain = sample_head_capped(li, LI_KEY, 200, seed=1)
    background = sample_head_capped(li, LI_KEY, 50, seed=2)
    vals = shap_sampled(model, explain, background, feats, va.transform, n_permutations=10)
    return shap_aggregate(vals)


# ---------------------------------------------------------------- search

@register("hpo_search")
def q_hpo_search(spark, sf):
    from loomkit.plans.search import hpo_search
    train, val = model_data(spark, sf, "binary")
    space = {"max_depth": {"type": "int", "low": 2, "high": 6},
             "min_samples_leaf": {"type": "int", "low": 1, "high": 50, "log": True}}
    table, _best, _value = hpo_search("decision_tree", "classification", train, val, space,
                                      n_trials=4, seed=42, parallelism=2)
    return table


@register("rank_trials", """
WITH t AS (SELECT l_orderkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'r2' WHEN 'N' THEN 'mae'
    ELSE 'accuracy' END AS metric, l_linenumber AS trial, l_quantity AS value, l_partkey, l_suppkey,
    l_extendedprice FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, metric ORDER BY
    CASE WHEN metric = 'mae' THEN -value ELSE value END DESC, trial, l_partkey, l_suppkey,
    l_extendedprice) AS rn FROM t)
SELECT run_id, metric, trial, value FROM r WHERE rn = 1""")
def q_rank_trials(spark, sf):
    from loomkit.plans.search import rank_trials
    li = load_table(spark, sf, "lineitem")
    t = li.select(F.col("l_orderkey").alias("run_id"),
                  F.when(F.col("l_returnflag") == "A", "r2").when(F.col("l_returnflag") == "N", "mae")
                  .otherwise("accuracy").alias("metric"), F.col("l_linenumber").alias("trial"),
                  F.col("l_quantity").alias("value"), "l_partkey", "l_suppkey", "l_extendedprice")
    out = rank_trials(t, ["run_id"], "metric", "value",
                      ["trial", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("run_id", "metric", "trial", "value")


# ---------------------------------------------------------------- scoring

@register("score_batch")
def q_score_batch(spark, sf):
    from loomkit.operators.scoring import score_batch
    _li, va, model = _li_lr(spark, sf, ["l_quantity", "l_discount", "l_tax"])
    rows = load_table(spark, sf, "lineitem").withColumn("prediction", F.lit("input column"))
    return score_batch(model, rows, prepare=va.transform)


@register("score_with_labels", f"""
WITH e AS (SELECT greatest({', '.join(f'var_pop({c})' for c in _NB_FEATS)}) * 1e-9 AS eps FROM {_NB_TRAIN}),
p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls,
        ln(count(*) / (SELECT count(*) FROM {_NB_TRAIN})) AS lp,
        {', '.join(f'avg({c}) AS mu_{c}, var_pop({c}) + (SELECT eps FROM e) AS var_{c}' for c in _NB_FEATS)}
      FROM {_NB_TRAIN} GROUP BY l_returnflag),
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cls,
        lp {''.join(f' - 0.5 * ln(2 * pi() * var_{c}) - pow({c} - mu_{c}, 2) / (2 * var_{c})' for c in _NB_FEATS)} AS ll
      FROM lineitem, p),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
        ORDER BY ll DESC, cls) AS rn FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(cls AS BIGINT) AS prediction,
  ['A', 'N', 'R'][cls + 1] AS label FROM r WHERE rn = 1""")
def q_score_with_labels(spark, sf):
    from loomkit.operators.profile import target_classes
    from loomkit.operators.scoring import score_with_labels
    from loomkit.operators.transforms import encode_target
    li = lineitem_keyed(spark, sf)
    classes_df = target_classes(li, "l_returnflag")
    enc = encode_target(li, "l_returnflag", classes_df, out="cls")
    train = enc.where(hash_unit(42, *LI_KEY) < 0.7)
    params = SV.fit_gaussian_nb(train, _NB_FEATS, "cls")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    pred = SV.predict_gaussian_nb(enc, params, _NB_FEATS, "cls", keys)
    classes = [r.class_label for r in classes_df.orderBy("class_index").collect()]
    return score_with_labels(pred, classes, encoded=True)
