"""Physical-plan properties of the registered queries: no cartesian products
and no nested-loop joins (one-row aggregates are attached as literals,
candidate lists are exploded, all other joins are equi-joins)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

# model fits whose plans are many separate jobs; their joins are covered elsewhere
SLOW = {"auto_train", "hpo_search", "reco_svd", "reco_svdpp", "reco_nmf", "reco_als_implicit",
        "importance_permutation", "cluster_gmm_diag", "cluster_minibatch_kmeans"}
NAMES = sorted(n for n in E.queries() if n not in SLOW)


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_products(spark, name):
    plan = E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
