"""Model queries. Fits are not expressible in SQL; tests hold them against invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import churn as churn_op
from ..operators import models as op
from . import churn, features
from .churn import _ALL
from .inputs import sql

NAMES = ["n_events", "active_days", "n_purchase", "failure_share", "value", "longest_gap", "resurrections"]


def labelled(spark, sf):
    rows = churn.features(spark, sf).join(churn.labels(spark, sf).select("user_id", "churned"), "user_id")
    return rows.join(churn_op.splits(churn.points(spark, sf)).select("user_id", "split"), "user_id").select("user_id", "split", "churned", *NAMES)


def _model(kind):
    return lambda spark, sf: op.classified(labelled(spark, sf), NAMES, "churned", "split", kind).select("user_id", "split", "churned", "score")


def on_matrix(kind):
    """Scores of a model fitted on the churn matrix, categories included."""
    return lambda spark, sf: op.classified(features.labelled(spark, sf), features.op.CHURN_NUMERIC, "churned", "split", kind, features.op.CHURN_CATEGORICAL).select("user_id", "split", "churned", "score")


def _weights(kind):
    return lambda spark, sf: op.importance(features.labelled(spark, sf), features.op.CHURN_NUMERIC, "churned", "split", kind, features.op.CHURN_CATEGORICAL)


#: A labelling that SQL has too, for the measures of any labelling.
BANDS = ["n_events", "active_days", "n_purchase", "value"]
_Z = ", ".join(f"coalesce(({c} - (SELECT avg({c}) FROM f)) / nullif((SELECT stddev_pop({c}) FROM f), 0), 0) AS {c}" for c in BANDS)
_D = " + ".join(f"pow(z.{c} - m.{c}, 2)" for c in BANDS)
_VALIDITY = f"""SELECT round_even((sum(n * o) / (count(*) - 1)) / (sum(inner_) / (sum(n) - count(*))), 6) AS calinski_harabasz,
    (SELECT round_even(avg(w), 6) FROM (SELECT a.c, max((a.scatter + b.scatter) / sqrt({_D.replace('z.', 'a.').replace('m.', 'b.')})) AS w FROM wi a JOIN wi b ON a.c <> b.c GROUP BY a.c)) AS davies_bouldin FROM wi"""


def banded(spark, sf):
    return churn.features(spark, sf).withColumn("band", F.col("user_id") % 3).select("user_id", "band", *BANDS)


QUERIES = {
    "cluster_validity": (lambda spark, sf: op.validity(banded(spark, sf), BANDS, "band"), sql(
        _VALIDITY, "e", "u", **_ALL, z=f"SELECT user_id % 3 AS c, {_Z} FROM f", m=f"SELECT c, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in BANDS)} FROM z GROUP BY c",
        wi=f"SELECT m.c, any_value(n) AS n, {', '.join(f'any_value(m.{c}) AS {c}' for c in BANDS)}, any_value({' + '.join(f'm.{c} * m.{c}' for c in BANDS)}) AS o, avg(sqrt({_D})) AS scatter, sum({_D}) AS inner_ FROM z JOIN m ON z.c = m.c GROUP BY m.c")),
    "pca_explained_variance": (lambda spark, sf: op.explained(banded(spark, sf), BANDS, len(BANDS)), None),
    "pca_centroids": (lambda spark, sf: op.component_centroids(banded(spark, sf), BANDS, "band"), None),
    "model_matrix_logistic": (on_matrix("logistic"), None),
    "model_matrix_forest": (on_matrix("forest"), None),
    "model_importance_logistic": (_weights("logistic"), None),
    "model_importance_forest": (_weights("forest"), None),
    "model_churn_baseline": (_model("baseline"), None),
    "model_churn_logistic": (_model("logistic"), None),
    "model_churn_forest": (_model("forest"), None),
    "model_user_clusters": (lambda spark, sf: op.clustered(churn.features(spark, sf).select("user_id", *NAMES), NAMES, 3), None),
    "model_cluster_choice": (lambda spark, sf: op.cluster_candidates(churn.features(spark, sf).select("user_id", *NAMES), NAMES, [2, 3, 4], 5), None),
    "model_churn_importance": (lambda spark, sf: op.importance(labelled(spark, sf), NAMES, "churned", "split"), None),
    "model_user_components": (lambda spark, sf: op.components(churn.features(spark, sf).select("user_id", *NAMES), NAMES), None),
}
