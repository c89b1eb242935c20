"""Anomaly models and classifiers as Spark jobs."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk import config as C
from conductrisk.operators.ordered import percentiles
from conductrisk.operators.sequences import event_sequences
from conductrisk.operators.tree_attributions import forest_attributions
from conductrisk.session import stage

SEED = 42
POSITIVE_WEIGHT = 10.0


# --- preparation --------------------------------------------------------------------------
def feature_vectors(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    """One vector per row from the features that exist."""
    present = [f for f in features if f in df.columns]
    return VectorAssembler(inputCols=present, outputCol=name, handleInvalid="keep").transform(df.fillna(0, present))


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """Centre and scale by the population deviation; a constant column only is centred."""
    moments = df.agg(F.struct(*[
        x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))
    ]).alias("m")).scalar()
    scaled = {}
    for f in features:
        scale = F.when(F.col(f"__m.s_{f}") > 1e-9, F.col(f"__m.s_{f}")).otherwise(1.0)
        scaled[f"{f}_scaled"] = (F.col(f) - F.col(f"__m.m_{f}")) / scale
    return df.withColumn("__m", moments).withColumns(scaled).drop("__m")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight of each class: rows / (2 * rows of the class)."""
    counts = df.agg(F.struct(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p")).alias("c")).scalar()
    sized = df.withColumn("__c", counts)
    own = F.when(F.col(label) == 1, F.col("__c.p")).otherwise(F.col("__c.n") - F.col("__c.p"))
    return sized.withColumn("weight", F.col("__c.n") / (2 * F.greatest(F.lit(1), own))).drop("__c")


def positive_weights(df: DataFrame, label: str = "label", weight: float = POSITIVE_WEIGHT) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 1, weight).otherwise(1.0))


# --- linear sequence autoencoder ------------------------------------------------------------
def _flat(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("flat", F.flatten("sequence"))


class SequenceModel:
    """Scaling and principal components of flattened sequences: a linear autoencoder.

    Fitting needs two passes: moments per position and the covariance, both of fixed size.
    """

    def __init__(self, mean: np.ndarray, scale: np.ndarray, components: np.ndarray):
        self.mean, self.scale, self.components = mean, scale, components

    @classmethod
    def fit(cls, seqs: DataFrame, latent: int = C.LATENT_SIZE, width: int | None = None) -> "SequenceModel":
        """`width` features per row share one scale, as rows of a sequence do."""
        vectors = _flat(seqs).select(array_to_vector("flat").alias("v"))
        summary = vectors.agg(
            Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")
        ).select("s.mean", "s.variance", "s.count").first()
        n = max(int(summary["count"]), 1)
        mean, var = summary["mean"].toArray(), summary["variance"].toArray() * (n - 1) / n
        if width:
            second = (var + mean * mean).reshape(-1, width).mean(axis=0)
            first = mean.reshape(-1, width).mean(axis=0)
            rows = len(mean) // width
            mean, var = np.tile(first, rows), np.tile(np.maximum(second - first * first, 0), rows)
        scale = np.where(var > 1e-12 * (1 + mean * mean), np.sqrt(np.maximum(var, 0)), 1.0)
        model = cls(mean, scale, np.zeros((len(mean), 0)))
        k = min(latent, len(mean))
        if k:
            scaled = _flat(seqs).select(array_to_vector(model._scaled(F.col("flat"))).alias("v"))
            model.components = PCA(k=k, inputCol="v", outputCol="p").fit(scaled).pc.toArray()
        return model

    def _scaled(self, flat: Column) -> Column:
        constants = F.from_json(F.lit(json.dumps([self.mean.tolist(), self.scale.tolist()])), "array<array<double>>")
        centred = F.zip_with(flat, constants[0], lambda x, m: x - m)
        return F.zip_with(centred, constants[1], lambda x, s: x / s)

    def score(self, seqs: DataFrame) -> DataFrame:
        """Add `error` (mean squared reconstruction error) and `latent` (projection scores)."""
        mean, scale, w = self.mean, self.scale, self.components
        schema = T.StructType([
            T.StructField("error", T.DoubleType()), T.StructField("latent", T.ArrayType(T.DoubleType()))])

        @F.pandas_udf(schema)
        def project(flat: pd.Series) -> pd.DataFrame:
            if len(flat) == 0:
                return pd.DataFrame({"error": [], "latent": []})
            x = (np.stack(flat.to_numpy()) - mean) / scale
            z = x @ w
            error = ((x - z @ w.T) ** 2).mean(axis=1)
            return pd.DataFrame({"error": error, "latent": list(z)})

        return _flat(seqs).withColumn("__s", project("flat")).select(
            *[c for c in seqs.columns if c != "sequence"], F.col("__s.error").alias("error"), F.col("__s.latent").alias("latent"))


def event_model(events: DataFrame, latent: int = 8) -> tuple[SequenceModel, DataFrame]:
    """Model on single events (hour, weekday, source index) and the scored sequences."""
    indexed = StringIndexer(inputCol="source", outputCol="source_index", handleInvalid="keep").fit(events).transform(events)
    timed = indexed.withColumns({"hour": F.hour("date"), "day_of_week": F.weekday("date")})
    seqs = event_sequences(timed, ["hour", "day_of_week", "source_index"]).select("id", "user", "date", "sequence")
    model = SequenceModel.fit(seqs, latent, 3)
    return model, model.score(seqs)


# --- isolation forest --------------------------------------------------------------------------
TREES = 100
TREE_ROWS = 256


def _average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    c = 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """Nodes [feature, threshold, left, right, size]; feature -1 marks a leaf."""
    nodes: list[list[float]] = []
    stack = [(np.arange(len(x)), 0, None)]
    while stack:
        rows, depth, slot = stack.pop()
        at = len(nodes)
        if slot is not None:
            nodes[slot[0]][slot[1]] = at
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([-1, 0.0, -1, -1, len(rows)])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        left = x[rows, f] <= cut
        nodes.append([f, cut, -1, -1, len(rows)])
        stack.append((rows[~left], depth + 1, (at, 3)))
        stack.append((rows[left], depth + 1, (at, 2)))
    return nodes


def tree_samples(df: DataFrame, features: list[str], key: str, trees: int = TREES, rows: int = TREE_ROWS) -> DataFrame:
    """__k, features, tree, at, rn: the `rows` rows of each tree, those with the smallest hash of (key, tree).

    Only rows whose hash is under a bound that lets about four times as many pass leave the scan, so few rows are
    shuffled and ranked; with the sample that small the chance to get too few is below 1e-100. Trees and hashes are made in
    compiled code, without lambdas.
    """
    base = df.select(F.col(key).cast("string").alias("__k"), *[F.col(f).cast("double").alias(f) for f in features])
    steps = 1_000_000_000
    bound = int(min(1.0, 4.0 * rows / max(1, df.count())) * steps)
    drawn = base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "at", F.xxhash64("__k", "tree")).filter(F.pmod("at", F.lit(steps)) < bound)
    order = Window.partitionBy("tree").orderBy(F.pmod("at", F.lit(steps)), "__k")
    return drawn.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= rows)


def fit_forest(df: DataFrame, features: list[str], key: str, trees: int = TREES, rows: int = TREE_ROWS) -> list[np.ndarray]:
    """Trees grown in parallel, each on its own `rows` rows of the whole table (see `tree_samples`)."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("rn")[features].to_numpy(dtype=float)
        limit = int(math.ceil(math.log2(max(len(x), 2))))
        return pd.DataFrame({"tree": [tree], "nodes": [json.dumps(_grow(x, np.random.default_rng(SEED + tree), limit))]})

    grown = tree_samples(df, features, key, trees, rows).groupBy("tree").applyInPandas(grow, "tree int, nodes string").orderBy("tree")
    # at most `trees` small rows come back: the fitted model
    return [np.array(json.loads(r["nodes"]), dtype=float) for r in grown.collect()]


def _paths(tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(feature, threshold, left, right, path length if a leaf, depth of the tree); a leaf is its own child."""
    feature, leaf = tree[:, 0].astype(int), tree[:, 0] < 0
    own = np.arange(len(tree))
    left, right = (np.where(leaf, own, tree[:, i].astype(int)) for i in (2, 3))
    depth = np.zeros(len(tree))
    for i in np.flatnonzero(~leaf):  # a node comes before its children
        depth[left[i]] = depth[right[i]] = depth[i] + 1
    return np.maximum(feature, 0), tree[:, 1], left, right, depth + _average_path(tree[:, 4]), int(depth.max())


def score_forest(df: DataFrame, forest: list[np.ndarray], features: list[str], contamination: float = 0.05,
                 rows: int = TREE_ROWS) -> DataFrame:
    """Add `decision` (below 0 is an outlier) and `prediction` (-1 or 1)."""
    largest = max(int(t[0][4]) for t in forest)
    norm = float(_average_path(min(rows, largest)))
    walks = [_paths(t) for t in forest]

    @F.pandas_udf(T.DoubleType())
    def normality(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        flat, first = x.ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros(len(x))
        for feature, cut, left, right, length, depth in walks:
            at = np.zeros(len(x), dtype=int)
            for _ in range(depth):
                at = np.where(flat[first + feature[at]] <= cut[at], left[at], right[at])
            total += length[at]
        return pd.Series(-np.power(2.0, -total / len(walks) / norm))

    # the percentile and the result read the scores
    scored = stage(df.withColumn("normality", normality(*[F.col(f).cast("double") for f in features])), "normalities")
    offset = percentiles(scored, "normality", [contamination]).select(F.col("p")[0]).scalar()
    return scored.withColumn("decision", F.col("normality") - offset).withColumn(
        "prediction", F.when(F.col("decision") < 0, -1).otherwise(1)).drop("normality")


# --- one-class kernel detector ----------------------------------------------------------------------
def kernel_scores(df: DataFrame, features: list[str], contamination: float = 0.05, size: int = 64,
                  gamma: float | None = None) -> DataFrame:
    """Kernel density by random Fourier features; the sparsest share is flagged.

    The density of a row is the product of its feature map with the mean feature map: one
    aggregation, no pair of rows is ever compared. Maps are made a batch at a time and never stored; the densities
    are written once, as the percentile and the result read them. A row without one of its features is no part of the mean and
    gets no decision.
    """
    rng = np.random.default_rng(SEED)
    gamma = gamma or 1.0 / len(features)
    weights = rng.normal(0, math.sqrt(2 * gamma), (size, len(features)))
    shifts = rng.uniform(0, 2 * math.pi, size)
    scaled = standardised(df, features)
    inputs = [F.col(f"{f}_scaled").cast("double") for f in features]

    def maps(columns) -> np.ndarray:
        x = np.zeros((len(columns[0]), size))
        for c, w in zip(columns, weights.T, strict=True):
            x += np.asarray(c, dtype=float)[:, None] * w
        return np.cos(x + shifts) * math.sqrt(2 / size)

    def sums(batches):
        for batch in batches:
            z = maps([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            z = z[~np.isnan(z).any(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array([z.sum(axis=0).tolist()], pa.list_(pa.float64())), pa.array([len(z)])], ["z", "n"])

    parts = scaled.select(*inputs).mapInArrow(sums, "z array<double>, n long")
    total = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("z")[i]).alias(f"z{i}") for i in range(size)]).first()
    centre = np.array([total[f"z{i}"] / total["n"] for i in range(size)]) if total["n"] else np.zeros(size)

    @F.pandas_udf(T.DoubleType())
    def density_of(*columns: pd.Series) -> pd.Series:
        return pd.Series(maps(columns) @ centre)

    density = stage(scaled.withColumn("density", density_of(*inputs)).drop(*[f"{f}_scaled" for f in features]), "densities")
    cut = percentiles(density, "density", [contamination]).select(F.col("p")[0]).scalar()
    return density.withColumn("decision", F.col("density") - cut).withColumn(
        "prediction", F.when(F.col("decision") < 0, -1).when(F.col("decision") >= 0, 1)).drop("density")


# --- classifiers ----------------------------------------------------------------------------------------
def fit_boosted(df: DataFrame, features: list[str], label: str = "label", trees: int = 200):
    """Gradient-boosted trees with weighted positives."""
    rows = positive_weights(feature_vectors(df, features), label)
    return GBTClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=5, stepSize=0.1,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED,
    ).fit(rows)


def fit_forest_classifier(df: DataFrame, features: list[str], label: str = "label", trees: int = 200):
    """Random forest with balanced class weights, the fallback classifier."""
    rows = balanced_weights(feature_vectors(df, features), label)
    return RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=10, seed=SEED).fit(rows)


def probability(model, df: DataFrame, features: list[str], name: str = "probability_1") -> DataFrame:
    scored = model.transform(feature_vectors(df, features))
    keep = [c for c in df.columns]
    return scored.select(*keep, vector_to_array("probability")[1].alias(name))


def risk_history(model, daily: DataFrame, features: list[str]) -> DataFrame:
    """Daily risk int(p * 100) per user."""
    return probability(model, daily, features, "p").withColumn("risk_score", F.floor(F.col("p") * 100).cast("int")).drop("p")


def fit_sequence_classifier(labelled: DataFrame):
    """Logistic regression on flattened, standardised sequences, positives weighted 1:10."""
    rows = positive_weights(labelled.withColumn("label", F.col("sequence_label")).withColumn(
        "features", array_to_vector(F.flatten("sequence"))))
    return LogisticRegression(weightCol="weight", regParam=0.01, maxIter=50).fit(rows)


def score_sequences(model, labelled: DataFrame) -> DataFrame:
    rows = labelled.withColumn("features", array_to_vector(F.flatten("sequence")))
    return model.transform(rows).select("user", "day", "sequence_label", vector_to_array("probability")[1].alias("p"))


# --- attributions ----------------------------------------------------------------------------------------
def attributions(model, df: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    """Exact Shapley values of the positive probability of a forest against the mean row, from the paths of its leaves."""
    return forest_attributions(model, df, features, key)


def global_importance(attributed: DataFrame, features: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"phi_{f}").alias("phi")) for f in features])
    return attributed.select(F.explode(pairs).alias("p")).groupBy("p.feature").agg(F.avg(F.abs("p.phi")).alias("importance"))


def top_attributions(attributed: DataFrame, features: list[str], key: list[str], top: int = 8) -> DataFrame:
    """The strongest attributions of each row by absolute value, sorted inside the row."""
    pairs = F.array(*[F.struct((-F.abs(F.col(f"phi_{f}"))).alias("o"), F.lit(f).alias("feature"), F.col(f"phi_{f}").alias("phi")) for f in features])
    return attributed.select(*key, F.posexplode(F.slice(F.sort_array(pairs), 1, top)).alias("pos", "p")).select(
        *key, (F.col("pos") + 1).alias("position"), "p.feature", "p.phi")
