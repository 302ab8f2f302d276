"""The learned second opinion: one-vs-rest boosted trees, isotonic calibration, scoring and sampled Shapley values."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline import staging
from emberline.operators import ordering


@dataclass
class Model:
    features: list[str]
    classes: list[str]
    prepare: PipelineModel
    trees: list
    calibrators: list
    version: str


def _prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Doubles with a missing flag next to each feature."""
    return df.withColumns({f: F.col(f).cast("double") for f in features} | {f"{f}_missing": F.col(f).isNull().cast("double") for f in features})


def validation_regions(df: DataFrame, region: str) -> list[str]:
    """Every fourth region by name; whole regions, so no place is on both sides."""
    names = [r[0] for r in df.select(region).filter(F.col(region).isNotNull()).distinct().orderBy(region).collect()]
    return names[::4] or names[:1]


def train(df: DataFrame, features: list[str], classes: list[str], label: str, region: str, rounds: int = 20, seed: int = 0) -> Model:
    """Trees on the other regions, calibration on the validation regions. Rows are weighted to balance the classes."""
    d = _prepared(df.filter(F.col(label).isin(classes)), features)
    held = F.col(region).isin(validation_regions(d, region))
    if min(d.filter(held).count(), d.filter(~held).count()) < 50:
        held = F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(5)) == 0
    prepare_cols = [f"{f}_filled" for f in features]
    from pyspark.ml import Pipeline

    prepare = Pipeline(stages=[Imputer(inputCols=features, outputCols=prepare_cols), VectorAssembler(inputCols=prepare_cols + [f"{f}_missing" for f in features], outputCol="_x")]).fit(d)
    fit, val = prepare.transform(d.filter(~held)), prepare.transform(d.filter(held))
    total = fit.count()
    trees, calibrators = [], []
    for c in classes:
        y = (F.col(label) == c).cast("double")
        n = max(fit.filter(F.col(label) == c).count(), 1)
        weight = F.when(y == 1, total / (2.0 * n)).otherwise(total / (2.0 * max(total - n, 1)))
        tree = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=seed).fit(fit.withColumns({"_y": y, "_w": weight}))
        raw = tree.transform(val).select(vector_to_array("probability")[1].alias("p"), y.alias("y"))
        iso = IsotonicRegression(featuresCol="p", labelCol="y").fit(raw)
        trees.append(tree)
        calibrators.append((list(iso.boundaries), list(iso.predictions)))
    ordered = F.sha1(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in features]))
    digest = d.select(F.conv(F.substring(ordered, 1, 10), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.sha1(F.sum("h").cast("string"))).first()[0]
    return Model(features, classes, prepare, trees, calibrators, f"gbt-{(digest or '')[:8]}")


def _interpolated(p, boundaries: list[float], values: list[float]):
    """The isotonic function: linear between its points, constant beyond them."""
    if not boundaries:
        return p
    out = F.when(p <= boundaries[0], F.lit(float(values[0])))
    for a, b, u, v in zip(boundaries, boundaries[1:], values, values[1:], strict=False):
        out = out.when(p <= b, F.lit(float(u)) + (p - a) * ((v - u) / (b - a) if b > a else 0.0))
    return out.otherwise(F.lit(float(values[-1])))


def score(model: Model | None, df: DataFrame, calibrated: bool = True) -> DataFrame:
    """df with model_scores (class to probability, sums to 1) and model_class; nulls without a model."""
    if model is None:
        return df.withColumns({"model_scores": F.lit(None).cast("map<string,double>"), "model_class": F.lit(None).cast("string")})
    names = df.columns
    d = model.prepare.transform(_prepared(df, model.features))
    for i, (tree, points) in enumerate(zip(model.trees, model.calibrators, strict=True)):
        d = tree.transform(d)
        p = vector_to_array("probability")[1]
        d = d.withColumn(f"_p{i}", F.greatest(_interpolated(p, *points) if calibrated else p, F.lit(1e-6))).drop("rawPrediction", "probability", "prediction")
    ps = [F.col(f"_p{i}") for i in range(len(model.classes))]
    total = sum(ps[1:], ps[0])
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-i).alias("i")) for i, p in enumerate(ps)]))
    return d.select(*names, F.map_from_arrays(F.array(*map(F.lit, model.classes)), F.array(*[p / total for p in ps])).alias("model_scores"), F.get(F.array(*map(F.lit, model.classes)), -best["i"]).alias("model_class"))


def shapley(model: Model, rows: DataFrame, background: DataFrame, key: str, permutations: int = 16, seed: int = 0) -> DataFrame:
    """key, feature and effect on the probability of the row's class: mean change when a feature joins, over drawn
    orders and background rows. All states are scored in one pass of the model."""
    fs = model.features
    rows_of = background.select(F.array(*[F.col(f).cast("double") for f in fs]).alias("bg")).withColumn("_h", F.xxhash64("bg", F.lit(seed)))
    base = staging.persisted(ordering.ranked(rows_of, ["_h", "bg"], "bi").drop("_h"), "background")
    n_bg = max(base.count(), 1)
    own = score(model, rows).select(key, F.col("model_class").alias("_class"), F.array(*[F.col(f).cast("double") for f in fs]).alias("own"))
    p = own.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    p = p.withColumns({"bi": F.pmod(F.xxhash64(key, "perm", F.lit(seed)), F.lit(n_bg)), "order": F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(fs) - 1)), lambda i: F.struct(F.xxhash64(i, "perm", F.col(key), F.lit(seed)).alias("h"), i.alias("i")))), lambda x: x["i"])})
    p = p.join(base, "bi").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(fs)))))
    taken = F.slice("order", F.lit(1), F.col("step"))
    states = p.select(key, "_class", "perm", "step", F.get("order", F.col("step") - 1).alias("added"), *[F.when(F.array_contains(taken, i), F.col("own")[i]).otherwise(F.col("bg")[i]).alias(f) for i, f in enumerate(fs)])
    s = score(model, states).select(key, "perm", "step", "added", F.try_element_at("model_scores", F.col("_class")).alias("v"))
    change = F.col("v") - F.lag("v").over(W.partitionBy(key, "perm").orderBy("step"))
    names = F.array(*map(F.lit, fs))
    return s.withColumn("change", change).filter("step > 0").groupBy(key, F.get(names, F.col("added")).alias("feature")).agg(F.avg("change").alias("effect"))


def grouped_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """fold by a hash of the group, so that no group is on both sides."""
    return df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(k)).cast("int"))


def permutation_importance(model: Model, df: DataFrame, label: str, key: str, rounds: int = 5, seed: int = 0) -> DataFrame:
    """feature and drop: how much accuracy falls when the feature's values are dealt to other rows.

    Rows are ranked once by key and once by a seeded hash for each round, by ranges; a feature then takes the value of
    the row that has its rank in the other order. All features and rounds are scored in one pass of the model.
    """
    own = staging.persisted(ordering.ranked(df, [key], "_n"), "ranked")
    values = own.select("_n", *[F.col(f).alias(f"_v_{f}") for f in model.features])
    mixed = []
    for k in range(rounds):
        place = ordering.ranked(own.withColumn("_h", F.xxhash64(key, F.lit(seed + k))), ["_h", key], "_m")
        dealt = place.drop("_n", "_h").withColumnRenamed("_m", "_n").join(values, "_n")
        each = F.explode(F.array(*map(F.lit, model.features))).alias("_feature")
        taken = dealt.select("*", each).withColumns({f: F.when(F.col("_feature") == f, F.col(f"_v_{f}")).otherwise(F.col(f)) for f in model.features})
        mixed.append(taken.select(label, *model.features, "_feature", F.lit(k).alias("_round")))
    right = F.avg((F.col(label) == F.col("model_class")).cast("double")).alias("right")
    base = score(model, own).agg(right.alias("base"))
    per = score(model, reduce(DataFrame.unionByName, mixed)).groupBy("_feature").agg(right)
    return per.join(F.broadcast(base)).select(F.col("_feature").alias("feature"), (F.col("base") - F.col("right")).alias("drop"))
