"""Models on feature tables: churn classifiers, clusters of users and principal components."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import probability
from . import kmeans

SEED = 1729


def standardised(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named columns with mean 0 and population deviation 1; constant ones become 0."""
    stats = rows.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names))
    out = rows.join(F.broadcast(stats))  # one row
    scaled = {n: F.coalesce((F.col(n) - F.col(f"m_{n}")) / F.nullif(F.col(f"s_{n}"), F.lit(0.0)), F.lit(0.0)) for n in names}
    return out.withColumns(scaled).select(*rows.columns)


def fitted(rows: DataFrame, names: list[str], label: str, split: str, kind: str = "logistic", categories: list[str] | None = None) -> tuple[PipelineModel, DataFrame, list[str]]:
    """A balanced model fitted on split = train, the rows as it takes them, and the names of its columns.

    Missing numbers become the training median and are scaled by the training mean and deviation. Missing categories
    become the training mode; each value that training has is a column ``feature=value``, and other values have none.
    With one class in training there is nothing to fit, which is an error.
    """
    classes = list(categories or [])
    train = rows.where(F.col(split) == "train")
    modes = [F.mode(F.col(c).cast("string"), True).alias(c) for c in classes]
    n, positives, *frequent = train.agg(F.count("*"), F.sum(label), *modes).first()
    share = (positives or 0) / n if n else 0.0
    if not 0 < share < 1:
        raise ValueError("training has one class; only the baseline can be fitted")
    filled = rows.withColumns({c: F.col(c).cast("double") for c in names} | {c: F.coalesce(F.col(c).cast("string"), F.lit(m or "")) for c, m in zip(classes, frequent, strict=True)})
    weight = F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    filled = filled.withColumn("_w", weight).withColumn("_y", F.col(label).cast("double"))
    shared = {"featuresCol": "_x", "labelCol": "_y", "weightCol": "_w"}
    model = LogisticRegression(regParam=1 / n, **shared) if kind == "logistic" else RandomForestClassifier(numTrees=100, seed=SEED, **shared)
    steps = [Imputer(strategy="median", inputCols=names, outputCols=[f"_i_{c}" for c in names]), VectorAssembler(inputCols=[f"_i_{c}" for c in names], outputCol="_n"), StandardScaler(withMean=True, inputCol="_n", outputCol="_z")]
    if classes:  # a value that training lacks gets the last index, which the encoder drops
        steps.append(StringIndexer(inputCols=classes, outputCols=[f"_k_{c}" for c in classes], handleInvalid="keep", stringOrderType="alphabetAsc"))
        steps.append(OneHotEncoder(inputCols=[f"_k_{c}" for c in classes], outputCols=[f"_h_{c}" for c in classes], dropLast=True))
    steps += [VectorAssembler(inputCols=["_z", *(f"_h_{c}" for c in classes)], outputCol="_x"), model]
    held = filled.where(F.col(split) == "train").persist()  # every stage reads it
    try:
        out = Pipeline(stages=steps).fit(held)
    finally:
        held.unpersist()
    known = [f"{c}={v}" for c, values in zip(classes, out.stages[3].labelsArray, strict=True) for v in values] if classes else []
    return out, filled, [*names, *known]


def classified(rows: DataFrame, names: list[str], label: str, split: str, kind: str = "logistic", categories: list[str] | None = None) -> DataFrame:
    """Rows with ``score``, four places, of a model that ``fitted`` makes; kind "baseline" scores with the share of training."""
    if kind == "baseline":
        n, positives = rows.where(F.col(split) == "train").agg(F.count("*"), F.sum(label)).first()
        return rows.withColumn("score", probability(F.lit(float((positives or 0) / n if n else 0.0))))
    model, filled, _ = fitted(rows, names, label, split, kind, categories)
    return model.transform(filled).select(*rows.columns, probability(vector_to_array("probability")[1]).alias("score"))


def clustered(rows: DataFrame, names: list[str], k: int, tries: int = 5) -> DataFrame:
    """Rows with ``cluster`` of the k-means fit with the least cost over some seeds, named in order of their size."""
    made = VectorAssembler(inputCols=names, outputCol="_x").transform(standardised(rows.withColumns({c: F.col(c).cast("double") for c in names}), names)).persist()
    try:
        fits = [KMeans(k=k, seed=SEED + i, featuresCol="_x", predictionCol="_c").fit(made) for i in range(tries)]
    finally:
        made.unpersist()
    best = min(fits, key=lambda m: m.summary.trainingCost)
    out = best.transform(made)
    sizes = out.groupBy("_c").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_c").collect()  # k rows
    names_ = F.create_map(*(x for i, r in enumerate(sizes, 1) for x in (F.lit(r["_c"]), F.lit(f"cluster_{i:02d}"))))
    return out.select(*rows.columns, names_[F.col("_c")].alias("cluster"))


def cluster_candidates(rows: DataFrame, names: list[str], ks: list[int], least_size: int, seeds: int = 3, starts: int = 20) -> DataFrame:
    """(k, silhouette, stability, davies_bouldin, calinski_harabasz, smallest, status) of each number of clusters.

    The measures are those of the fit of least cost over ``starts`` seeds; more clusters than there are different rows
    are rejected at once. Stability is the mean adjusted Rand index between that fit and those of further seeds.
    All fits of all numbers share their passes over the rows (see ``kmeans``).
    """
    from .segmentation import chosen_clusters

    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.xxhash64(*rows.columns))  # of the values as they come, without the rounding of a mean
    numbers = standardised(keyed.withColumns({c: F.col(c).cast("double") for c in names}), names)
    made = VectorAssembler(inputCols=names, outputCol="_x").transform(numbers).select("_key", "_x", *names).persist()
    held, found = [made], []
    try:
        different = made.select(*names).distinct().count()
        kept = [k for k in ks if k <= different]
        fits = kmeans.fitted(made, names, "_key", [(k, SEED + i) for k in kept for i in range(starts + seeds - 1)])
        named = {}
        for k in kept:
            own = [f for f in fits if f.k == k]
            named |= {f"c{k}_{i}": f for i, f in enumerate([min(own[:starts], key=lambda f: f.cost), *own[starts:]])}
        if kept:  # read once for each measure
            held.append(VectorAssembler(inputCols=names, outputCol="_x").transform(kmeans.labelled(made, names, named)).persist())
        alike = kmeans.agreements(held[1], [(f"c{k}_0", f"c{k}_{i}") for k in kept for i in range(1, seeds)])
        for k in ks:
            if k not in kept:
                found.append((k, None, None, None, None, 0))
                continue
            score = ClusteringEvaluator(featuresCol="_x", predictionCol=f"c{k}_0").evaluate(held[1])
            shape = validity(held[1], names, f"c{k}_0").first()
            stable = [alike[f"c{k}_0", f"c{k}_{i}"] for i in range(1, seeds)]
            found.append((k, round(score, 6), round(sum(stable) / len(stable), 6) if stable else 1.0, shape["davies_bouldin"], shape["calinski_harabasz"], min(named[f"c{k}_0"].sizes)))
    finally:
        for one in held:
            one.unpersist()
    return chosen_clusters(spark.createDataFrame(found, "k int, silhouette double, stability double, davies_bouldin double, calinski_harabasz double, smallest long"), least_size)


def importance(rows: DataFrame, names: list[str], label: str, split: str, kind: str = "logistic", categories: list[str] | None = None) -> DataFrame:
    """rank, feature, importance and signed_value of a fitted model's columns, greatest first, then the later name.

    A logistic model's importance is the size of its coefficient; a forest's is the impurity that splits on the column
    take away, summed over its trees, and has no sign. The baseline has one constant row.
    """
    kinds = "rank int, feature string, importance double, signed_value double"
    if kind == "baseline":
        return rows.sparkSession.createDataFrame([(1, "baseline_prevalence", 1.0, None)], kinds)
    model, _, columns = fitted(rows, names, label, split, kind, categories)
    values = model.stages[-1].coefficients.toArray() if kind == "logistic" else model.stages[-1].featureImportances.toArray()
    if len(values) != len(columns):
        raise ValueError(f"{len(values)} weights for {len(columns)} columns")
    found = sorted(((round(abs(float(v)), 6), c, round(float(v), 6) if kind == "logistic" else None) for v, c in zip(values, columns, strict=True)), key=lambda r: r[:2], reverse=True)
    return rows.sparkSession.createDataFrame([(i, c, size, signed) for i, (size, c, signed) in enumerate(found, 1)], kinds)


def covariance(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Covariance of the population of the standardised columns, as one aggregate of their products."""
    made = standardised(rows.withColumns({c: F.col(c).cast("double") for c in names}), names)
    places = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = made.agg(*(F.coalesce(F.avg(F.col(names[i]) * F.col(names[j])), F.lit(0.0)) for i, j in places)).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), v in zip(places, found, strict=True):
        out[i, j] = out[j, i] = v
    return out


def axes(rows: DataFrame, names: list[str], k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the variance and loadings of the first components; of each component the largest loading is positive (ties: the first)."""
    values, vectors = np.linalg.eigh(covariance(rows, names))  # columns squared, whatever the rows
    order = np.argsort(-values, kind="stable")[:k]
    vectors = vectors[:, order]
    largest = np.argmax(np.round(np.abs(vectors), 9), axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(len(order))] < 0, -1.0, 1.0)
    total = values.sum()
    return (values[order] / total if total > 0 else np.zeros(len(order))), vectors


def explained(rows: DataFrame, names: list[str], k: int = 2) -> DataFrame:
    """component and explained_variance, its share of the variance of the standardised columns."""
    shares, _ = axes(rows, names, k)
    return rows.sparkSession.createDataFrame([(f"pc_{i + 1}", round(float(x), 6)) for i, x in enumerate(shares)], "component string, explained_variance double")


def components(rows: DataFrame, names: list[str], k: int = 2) -> DataFrame:
    """Rows with the first principal components of the standardised columns."""
    _, loadings = axes(rows, names, k)
    made = standardised(rows.select("*", *(F.col(c).cast("double").alias(f"_z_{c}") for c in names)), [f"_z_{c}" for c in names])
    scores = {f"pc_{i + 1}": F.bround(sum((F.col(f"_z_{c}") * float(w) for c, w in zip(names, loadings[:, i], strict=True)), F.lit(0.0)), 6) + F.lit(0.0) for i in range(loadings.shape[1])}
    return made.select(*rows.columns, *(v.alias(c) for c, v in scores.items()))


def component_centroids(rows: DataFrame, names: list[str], cluster: str, k: int = 2) -> DataFrame:
    """cluster, size and the mean of each principal component."""
    found = components(rows, names, k)
    return found.groupBy(cluster).agg(F.count("*").alias("size"), *(F.bround(F.avg(f"pc_{i + 1}"), 6).alias(f"pc_{i + 1}") for i in range(k)))


def validity(rows: DataFrame, names: list[str], cluster: str) -> DataFrame:
    """davies_bouldin and calinski_harabasz of a labelling of the standardised columns, six places; null with one cluster.

    Two passes: means of clusters, then distances from them; what meets pairwise are the clusters, not the rows.
    """
    made = standardised(rows.withColumns({c: F.col(c).cast("double") for c in names}), names).select(F.col(cluster).alias("c"), F.array(*names).alias("x"))
    means = made.groupBy("c").agg(F.count("*").alias("n"), F.array(*(F.avg(F.col("x")[i]) for i in range(len(names)))).alias("m"))

    def squared(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)

    within = made.join(F.broadcast(means), "c").withColumn("d", squared("x", "m")).groupBy("c", "n", "m").agg(F.avg(F.sqrt("d")).alias("scatter"), F.sum("d").alias("inner"))  # a row a cluster
    other = within.select(F.col("c").alias("c2"), F.col("m").alias("m2"), F.col("scatter").alias("scatter2"))
    worst = within.join(other, F.col("c") != F.col("c2")).groupBy("c").agg(F.max((F.col("scatter") + F.col("scatter2")) / F.nullif(F.sqrt(squared("m", "m2")), F.lit(0.0))).alias("worst"))
    origin = F.aggregate("m", F.lit(0.0), lambda s, v: s + v * v)  # the standardised mean of all rows is 0
    outer = within.agg(F.sum(F.col("n") * origin).alias("outer"), F.sum("inner").alias("inner"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ratio = (F.col("outer") / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(F.col("inner") / F.nullif(F.col("n") - F.col("k"), F.lit(0)), F.lit(0.0))
    return outer.select(F.bround(ratio, 6).alias("calinski_harabasz")).join(worst.agg(F.bround(F.avg("worst"), 6).alias("davies_bouldin")))  # one row each
