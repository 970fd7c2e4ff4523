"""Preference scores usable both as a Column and on numpy feature arrays inside a task."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, functions as F

from routelore.functions import scalars as S


@dataclass(frozen=True)
class LogitScorer:
    """Logistic model with named weights. ``decimals`` rounds the probability."""

    intercept: float
    weights: Mapping[str, float] = field(default_factory=dict)
    decimals: int | None = None

    @property
    def features(self) -> list[str]:
        return list(self.weights)

    def column(self, prefix: str = "") -> Column:
        z = F.lit(float(self.intercept))
        for name, w in self.weights.items():
            z = z + F.lit(float(w)) * F.col(prefix + name)
        p = S.sigmoid(z)
        return F.round(p, self.decimals) if self.decimals is not None else p

    def probability(self, features: Mapping[str, np.ndarray]) -> np.ndarray:
        z = self.intercept
        for name, w in self.weights.items():
            z = z + w * features[name]
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -700.0, 700.0)))
        return np.round(p, self.decimals) if self.decimals is not None else p


@dataclass(frozen=True)
class TreeScorer:
    """Tree ensemble flattened to arrays: per node split feature (-1 at a leaf), threshold, children and value."""

    names: tuple[str, ...]
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    tree_weights: np.ndarray
    boosted: bool

    @property
    def features(self) -> list[str]:
        return list(self.names)

    def probability(self, features: Mapping[str, np.ndarray]) -> np.ndarray:
        shape = np.broadcast_shapes(*[np.shape(features[n]) for n in self.names])
        x = np.stack([np.broadcast_to(features[n], shape).astype(np.float32).ravel() for n in self.names], axis=1)
        total = np.zeros(len(x))
        for root, weight in zip(self.roots, self.tree_weights):
            at = np.full(len(x), root)
            while True:
                inner = self.feature[at] >= 0
                if not inner.any():
                    break
                rows = np.nonzero(inner)[0]
                node = at[rows]
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                at[rows] = np.where(goes_left, self.left[node], self.right[node])
            total += weight * self.value[at]
        p = 1.0 / (1.0 + np.exp(-2.0 * total)) if self.boosted else total / self.tree_weights.sum()
        return p.reshape(shape)


def from_pipeline(model, features, scratch: str | None = None):
    """Scorer of a fitted pipeline. Missing features count as 0 when serving, so the imputer is left out.

    Linear: scaling is folded into the weights. Trees: the node table of the saved model, whose size is set by the
    number and depth of trees, is read back and flattened.
    """
    from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
    from pyspark.ml.feature import StandardScalerModel

    last = model.stages[-1]
    if isinstance(last, LogisticRegressionModel):
        coefficients, intercept = np.asarray(last.coefficients.toArray(), float), float(last.intercept)
        for stage in model.stages:
            if isinstance(stage, StandardScalerModel):
                std, mean = np.asarray(stage.std.toArray()), np.asarray(stage.mean.toArray())
                scale = np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0)
                intercept -= float((coefficients * mean * scale).sum())
                coefficients = coefficients * scale
        return LogitScorer(intercept, dict(zip(features, (float(c) for c in coefficients))))
    if not isinstance(last, (GBTClassificationModel, RandomForestClassificationModel)):
        raise TypeError(f"no scorer for {type(last).__name__}")
    import uuid

    from pyspark.sql import SparkSession

    from routelore.sources.staging import scratch_folder

    spark = SparkSession.active()
    path = f"{scratch or scratch_folder(spark)}/model-{uuid.uuid4().hex}"
    last.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    boosted = isinstance(last, GBTClassificationModel)
    index = {(r["treeID"], r["id"]): i for i, r in enumerate(nodes)}
    inner = [r["leftChild"] >= 0 for r in nodes]

    def leaf_value(r) -> float:
        if boosted:
            return float(r["prediction"])
        stats = np.asarray(r["impurityStats"], float)
        return float(stats[1] / stats.sum()) if stats.sum() > 0 else 0.0

    return TreeScorer(
        tuple(features),
        np.array([i for i, r in enumerate(nodes) if r["id"] == 0]),
        np.array([r["split"]["featureIndex"] if k else -1 for r, k in zip(nodes, inner)]),
        np.array([r["split"]["leftCategoriesOrThreshold"][0] if k else 0.0 for r, k in zip(nodes, inner)]),
        np.array([index[(r["treeID"], r["leftChild"])] if k else 0 for r, k in zip(nodes, inner)]),
        np.array([index[(r["treeID"], r["rightChild"])] if k else 0 for r, k in zip(nodes, inner)]),
        np.array([leaf_value(r) for r in nodes]),
        np.asarray(last.treeWeights, float),
        boosted,
    )
