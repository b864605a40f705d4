"""Queries for splits, leakage checks, models and surrogate tests."""

from pyspark.sql import functions as F

from ...operators import models as ML
from ...operators import validate as V
from ...sources.panels import return_series, weekly_panel
from .base import FACTORS, Catalog, panel_sql, rounded, study

CATALOG = Catalog()
add = CATALOG.add

_ORD = f"""WITH {panel_sql()},
o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS ord FROM (SELECT DISTINCT ts FROM panel)),
n AS (SELECT count(*) AS n FROM o)"""
_WF = f"""{_ORD},
f AS (SELECT unnest(range(0, (n - 120) // 20 + 1)) AS k FROM n),
sp AS (SELECT CAST(k AS INT) AS fold, 'train' AS role, ord, ts FROM f JOIN o ON ord >= k * 20 AND ord < k * 20 + 100 - 3
  UNION ALL SELECT CAST(k AS INT), 'test', ord, ts FROM f JOIN o ON ord >= k * 20 + 100 AND ord < k * 20 + 120)"""
WALK = V.PurgedWalkForward(train_span=100, test_span=20, embargo=2, label_horizon=3)


@add("validate_walk_forward", f"{_WF} SELECT * FROM sp")
def walk(spark, d):
    return WALK.split(weekly_panel(spark, d))


@add("validate_walk_forward_expanding", f"""{_ORD},
f AS (SELECT unnest(range(0, (n - 250) // 25 + 1)) AS k FROM n)
SELECT CAST(k AS INT) AS fold, 'train' AS role, ord, ts FROM f JOIN o ON ord < k * 25 + 200 - 1
  UNION ALL SELECT CAST(k AS INT), 'test', ord, ts FROM f JOIN o ON ord >= k * 25 + 200 AND ord < k * 25 + 250""")
def walk_expanding(spark, d):
    return V.PurgedWalkForward(200, 50, step=25, expanding=True).split(weekly_panel(spark, d))


_CP = f"""{_ORD},
e AS (SELECT g, CAST(floor(n * g / 6.0) AS BIGINT) AS lo, CAST(floor(n * (g + 1) / 6.0) AS BIGINT) AS hi FROM n, range(6) t(g)),
pk AS (SELECT a.g AS ga, b.g AS gb, CAST(row_number() OVER (ORDER BY a.g, b.g) - 1 AS INT) AS fold FROM e a JOIN e b ON a.g < b.g),
bl AS (SELECT fold, lo, hi FROM pk JOIN e ON g = ga OR g = gb),
sp AS (SELECT fold, 'test' AS role, ord, ts FROM bl JOIN o ON ord >= lo AND ord < hi
  UNION ALL SELECT fold, 'train', ord, ts FROM pk JOIN o ON NOT EXISTS (
    SELECT 1 FROM bl WHERE bl.fold = pk.fold AND ord >= lo - 3 AND ord < hi + 2))"""
CPCV = V.CombinatorialPurgedCV(6, 2, embargo=2, label_horizon=3)


@add("validate_combinatorial", f"{_CP} SELECT * FROM sp")
def combinatorial(spark, d):
    return CPCV.split(weekly_panel(spark, d))


@add("validate_leakage_report", f"""{_CP},
tr AS (SELECT fold, ord FROM sp WHERE role = 'train'), te AS (SELECT fold, ord FROM sp WHERE role = 'test'),
hits AS (SELECT tr.fold, tr.ord, bool_or(te.ord = tr.ord) AS same, bool_or(te.ord > tr.ord AND te.ord - tr.ord <= 5) AS bef,
  bool_or(te.ord < tr.ord AND tr.ord - te.ord <= 2) AS aft FROM tr JOIN te ON te.fold = tr.fold GROUP BY tr.fold, tr.ord)
SELECT fold, count(*) AS n_train, (SELECT count(*) FROM te WHERE te.fold = hits.fold) AS n_test,
  count(*) FILTER (WHERE same) AS n_shared, count(*) FILTER (WHERE NOT same AND bef) AS n_label_overlap,
  count(*) FILTER (WHERE NOT same AND aft) AS n_embargo FROM hits GROUP BY fold""")
def leakage(spark, d):
    # a stricter horizon than the split was made for shows where it would leak
    return V.leakage_report(CPCV.split(weekly_panel(spark, d)), label_horizon=5, embargo=2)


FEATS = ["rev_5", "drive", "log_volume"]


@add("model_walk_forward_linear")
def wf_linear(spark, d):
    s = study(spark, d)
    p = ML.walk_forward(s, FEATS, "y1", V.PurgedWalkForward(200, 50, label_horizon=2), kind="linear",
                        regParam=0.01)
    return rounded(p, 6)


@add("model_walk_forward_boosted")
def wf_boosted(spark, d):
    s = study(spark, d)
    p = ML.walk_forward(s, FEATS, "y1", V.PurgedWalkForward(250, 50, label_horizon=2))
    return rounded(ML.fold_scores(p, "y1"), 6)


@add("model_feature_importance")
def importance(spark, d):
    s = study(spark, d)
    return rounded(ML.importance(ML.fit(s, FEATS, "y1"), FEATS, spark), 6)


@add("model_training_summary", f"""WITH {panel_sql()}
SELECT count(*) AS n_train, count(DISTINCT ts) AS n_groups FROM panel WHERE prev_close IS NOT NULL""")
def training_summary(spark, d):
    return ML.training_summary(weekly_panel(spark, d), ["close", "volume"], "prev_close")


@add("model_phase_randomize")
def phase(spark, d):
    return rounded(ML.phase_randomize(return_series(spark, d), 3), 8)


@add("model_noise_benchmark")
def noise(spark, d):
    def lag_one(x):
        import numpy as np
        return float(np.mean(x[1:] * x[:-1]))

    return rounded(ML.noise_benchmark(return_series(spark, d), lag_one), 6)
