"""Registered model queries use the rounds and trials that their operators ask for."""

import pytest

from longpanel.operators import models as ML
from longpanel.plans.catalog import load


@pytest.mark.parametrize("query", ["model_walk_forward_boosted", "model_feature_importance"])
def test_boosted_queries_run_every_round(spark, sf_dir, monkeypatch, query):
    from pyspark.ml.regression import GBTRegressor

    class Seen(Exception):
        pass

    def fitted(self, *a, **k):
        raise Seen(self.getMaxIter())

    monkeypatch.setattr(GBTRegressor, "fit", fitted)
    with pytest.raises(Seen) as found:
        load().queries[query](spark, sf_dir).count()
    assert found.value.args == (20,)


def test_noise_benchmark_runs_every_trial(spark, sf_dir):
    got = load().queries["model_noise_benchmark"](spark, sf_dir).collect()
    assert got and {r.n_trials for r in got} == {200}
