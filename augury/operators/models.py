"""Forecasters on Spark ML and the published champion."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.operators.isotonic import IsotonicCalibrator
from augury.sources import files


class Forecaster(Protocol):
    feature_names: list[str]

    def fit(self, train: DataFrame, features: list[str], label: str) -> Forecaster: ...
    def predict_proba(self, df: DataFrame) -> DataFrame: ...
    def save(self, path: str) -> None: ...


class SparkForecaster:
    """logistic_regression, random_forest, gradient_boosting, or any Spark ML classifier.

    A model whose training labels were all equal still gives the probability of the
    positive class: 0 or 1 where it knows one class only.
    """

    PRESETS = ("logistic_regression", "random_forest", "gradient_boosting")

    def __init__(self, kind: str | object = "logistic_regression", **params):
        if isinstance(kind, str) and kind not in self.PRESETS:
            raise ValueError(f"unknown model {kind!r}; there are {', '.join(self.PRESETS)}")
        self.kind, self.params = kind, params
        self.feature_names: list[str] = []
        self.model: PipelineModel | None = None
        self.only: float | None = None

    def _classifier(self, n: int, label: str, classes: int = 2):
        if not isinstance(self.kind, str):
            return self.kind.copy({self.kind.labelCol: label, self.kind.featuresCol: "__x"})
        both = {"labelCol": label, "featuresCol": "__x"} | self.params
        strength = both.pop("C", 1.0)
        if self.kind == "logistic_regression":
            return LogisticRegression(**{"maxIter": 1000, "regParam": 1 / (strength * max(n, 1)), "standardization": False} | both)
        if self.kind == "random_forest":
            return RandomForestClassifier(**{"numTrees": 100, "seed": 0} | both)
        trees = GBTClassifier(**{"maxIter": 100, "seed": 0} | both)
        # boosting knows two classes: of more, each is told from the rest
        return trees if classes <= 2 else OneVsRest(classifier=trees, labelCol=label, featuresCol="__x", parallelism=classes)

    def fit(self, train: DataFrame, features: list[str], label: str = "label") -> SparkForecaster:
        self.feature_names = list(features)
        n, low, high = train.agg(F.count("*"), F.min(label), F.max(label)).first()
        if n == 0:
            raise ValueError("no training rows")
        self.only = float(low) if low == high else None
        if self.only is None:
            self.model = Pipeline(stages=[VectorAssembler(inputCols=self.feature_names, outputCol="__x", handleInvalid="keep"), self._classifier(n, label, int(high) + 1)]).fit(train)
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with predicted_prob, the probability of the positive class."""
        if self.only is not None:
            return df.withColumn("predicted_prob", F.lit(1.0 if self.only > 0 else 0.0))
        if self.model is None:
            raise RuntimeError("fit the model before predicting")
        out = self.model.transform(df)
        return out.select(*df.columns, F.coalesce(F.get(self._probabilities(out), F.lit(1)), F.lit(0.0)).alias("predicted_prob"))

    @staticmethod
    def _probabilities(scored: DataFrame) -> Column:
        """The classifier's, or each class's own chance against the rest, scaled to a sum of one."""
        if "probability" in scored.columns:
            return vector_to_array("probability")
        own = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        whole = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
        return F.transform(own, lambda x: x / whole)

    def class_probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` with probabilities, one for each class; for labels of more than two classes."""
        if self.model is None:
            raise RuntimeError("fit the model before predicting")
        out = self.model.transform(df)
        return out.select(*df.columns, self._probabilities(out).alias("probabilities"))

    def save(self, path: str) -> None:
        if self.model is None and self.only is None:
            raise RuntimeError("fit the model before saving")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
        kind = self.kind if isinstance(self.kind, str) else type(self.kind).__name__
        files.write_text(SparkSession.active(), f"{path}/forecaster.json", json.dumps({"kind": kind, "features": self.feature_names, "only": self.only}))

    @classmethod
    def load(cls, path: str) -> SparkForecaster:
        meta = json.loads(files.read_text(SparkSession.active(), f"{path}/forecaster.json"))
        out = cls(meta["kind"] if meta["kind"] in cls.PRESETS else "logistic_regression")
        out.feature_names, out.only = meta["features"], meta["only"]
        if out.only is None:
            out.model = PipelineModel.load(f"{path}/model")
        return out


class BoostedForecaster(SparkForecaster):
    """Gradient-boosted trees, the default model."""

    def __init__(self, **params):
        super().__init__("gradient_boosting", **params)


def gate_to_dict(segments: DataFrame, decision: DataFrame) -> dict:
    """The gate's result as a document: bounded by the list of required segments."""
    d = decision.first().asDict()
    rows = [r.asDict() for r in segments.orderBy("segment").collect()]
    return d | {"segment_results": [{k: r[k] for k in ("segment", "num_trades", "total_pnl", "passes", "reason")} for r in rows]}


class Champion:
    """The published model: a directory with model, optional calibrator and champion.json."""

    def __init__(self, manifest: dict):
        self.manifest = manifest

    @classmethod
    def publish(cls, folder: str, model: SparkForecaster, gate: dict, plugin_family: str, calibrator: IsotonicCalibrator | None = None, model_name: str = "champion", now: datetime | None = None) -> Champion:
        """Writes nothing unless the gate says GO; the manifest comes last."""
        if gate.get("decision") != "GO":
            raise ValueError(f"gate decision is {gate.get('decision')}; only GO can be published")
        model.save(f"{folder}/{model_name}")
        if calibrator is not None:
            calibrator.save(f"{folder}/{model_name}_calibrator")
        manifest = {
            "model_name": model_name,
            "model_path": f"{folder}/{model_name}",
            "calibrator_path": f"{folder}/{model_name}_calibrator" if calibrator is not None else None,
            "published_at": (now or datetime.now(UTC)).isoformat(),
            "plugin_family": plugin_family,
            "publish_gate": gate,
        }
        files.write_text(SparkSession.active(), f"{folder}/champion.json", json.dumps(manifest, indent=2))
        return cls(manifest)

    @classmethod
    def load(cls, path: str) -> Champion:
        manifest = json.loads(files.read_text(SparkSession.active(), path))
        for key in ("model_name", "model_path", "published_at", "plugin_family", "publish_gate"):
            if key not in manifest:
                raise KeyError(f"champion manifest lacks {key!r}")
        return cls(manifest | {"calibrator_path": manifest.get("calibrator_path")})

    def allowed_segments(self) -> set[str]:
        return {r["segment"] for r in self.manifest["publish_gate"].get("segment_results", []) if r["passes"]}

    def load_model(self) -> SparkForecaster:
        return SparkForecaster.load(self.manifest["model_path"])

    def load_calibrator(self) -> IsotonicCalibrator | None:
        path = self.manifest.get("calibrator_path")
        return IsotonicCalibrator.load(path) if path else None
