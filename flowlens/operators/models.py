"""Model training and scoring with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from flowlens.functions import scores as S


def _members(label: str, seed: int, size: dict):
    kw = {"featuresCol": "scaled", "labelCol": label, "seed": seed, "maxDepth": size.get("depth", 5)}
    gbt = GBTClassifier(**kw, maxIter=size.get("gbt", 20))
    forest = RandomForestClassifier(**kw, numTrees=size.get("trees", 50))
    linear = LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=size.get("lr", 50))
    for i, m in enumerate((gbt, forest, linear), start=1):
        for param, name in ((m.probabilityCol, "prob"), (m.rawPredictionCol, "raw"), (m.predictionCol, "pred")):
            m.set(param, f"{name}_{i}")
    return [gbt, forest, linear]


def fit_stage1(train: DataFrame, *, features, label: str = "label", seed: int = 42, **size) -> PipelineModel:
    """Scaler and three members."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep"),
                            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), *_members(label, seed, size)]).fit(train)


def score_members(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Append p_1, p_2, p_3: attack probabilities of the members."""
    d = model.transform(df)
    for i in (1, 2, 3):
        d = d.withColumn(f"p_{i}", vector_to_array(f"prob_{i}")[1])
    return d.drop("raw", "scaled", *[f"{c}_{i}" for i in (1, 2, 3) for c in ("prob", "raw", "pred")])


def _log_loss(p, label):
    q = S.clip(p, 1e-9)
    return F.avg(-(F.col(label) * F.log(q) + (1 - F.col(label)) * F.log(1 - q)))


def tune_fusion(scored: DataFrame, *, label: str = "label", step: float = 0.05, temperatures=(0.8, 0.9, 1.0, 1.1, 1.2, 1.4)) -> dict:
    """Member weights, then temperature, with the least log loss.

    Every grid point is one more aggregate of a single pass; one row reaches the driver.
    """
    k = round(1 / step)
    grid = [(a / k, b / k, (k - a - b) / k) for a in range(k + 1) for b in range(k + 1 - a)]
    ps = ["p_1", "p_2", "p_3"]
    row = scored.agg(*[_log_loss(S.fuse_logit(ps, w), label).alias(f"g{i}") for i, w in enumerate(grid)]).first()
    best = min(range(len(grid)), key=lambda i: row[i])
    fused = S.fuse_logit(ps, grid[best])
    row_t = scored.agg(*[_log_loss(S.temperature_scale(fused, t), label).alias(f"t{i}") for i, t in enumerate(temperatures)]).first()
    bt = min(range(len(temperatures)), key=lambda i: row_t[i])
    return {"weights": grid[best], "temperature": temperatures[bt], "log_loss": row_t[bt]}


def fit_stage2(train: DataFrame, *, features, family: str = "family", seed: int = 42, trees: int = 30, depth: int = 6) -> PipelineModel:
    """Family model: index, scale, multiclass forest."""
    return Pipeline(stages=[StringIndexer(inputCol=family, outputCol="family_idx", stringOrderType="alphabetAsc", handleInvalid="skip"),
                            VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep"),
                            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
                            RandomForestClassifier(featuresCol="scaled", labelCol="family_idx", numTrees=trees, maxDepth=depth, seed=seed)]).fit(train)


def family_probabilities(model: PipelineModel, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Append family_probs; also the class names in order."""
    d = df
    for st in model.stages[1:]:
        d = st.transform(d)
    return d.withColumn("family_probs", vector_to_array("probability")).drop("raw", "scaled", "rawPrediction", "probability", "prediction"), model.stages[0].labels


# ── extension surface ────────────────────────────────────────────────────────
def normalize_with(df: DataFrame, *, group_a, labels, identity, mode: str = "binary", rate=None, source: str, scenario: str = "", extra=None) -> DataFrame:
    """Normaliser plug-in: three DataFrame functions of a source give the canonical table."""
    from flowlens import values as V
    from flowlens.operators import features as X
    d = df.transform(group_a).transform(labels).transform(identity).transform(X.group_b).transform(X.group_c)
    d = d.transform(X.group_d, mode=mode, rate=rate).transform(X.group_e)
    d = d.transform(X.add_metadata, source_dataset=source, scenario_id=scenario, mode=mode).transform(X.drop_unlabeled)
    extra = dict(extra or {})
    d = d.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else d
    return X.validate_schema(d.select(*V.CANONICAL_45, *V.METADATA, *extra), extra=list(extra))


def score_with(df: DataFrame, scorer, *, columns) -> DataFrame:
    """Model plug-in: any function or Transformer that adds the named probability columns."""
    d = scorer.transform(df) if hasattr(scorer, "transform") and not callable(scorer) else scorer(df)
    missing = [c for c in columns if c not in d.columns]
    if missing:
        raise ValueError(f"scorer gave no {missing}")
    return d
