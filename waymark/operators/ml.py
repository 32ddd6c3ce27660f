"""Model fits on Spark ML: fitted on training rows only, scored on the rows that every model has."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.ranks import counted, running
from waymark.plans.scratch import materialize


def class_means(train: DataFrame, rows: DataFrame, group: str, truth: str) -> DataFrame:
    """``constant`` and ``class_mean`` predictions: the training mean, and the group's, or the constant where unseen (M1)."""
    overall = train.agg(F.avg(truth).alias("constant"))
    means = train.groupBy(group).agg(F.avg(truth).alias("_m"))
    return rows.join(means, group, "left").crossJoin(overall).withColumn("class_mean", F.coalesce("_m", "constant")).drop("_m")  # one row


def encoder(categories: list[str], numbers: list[str]) -> list:
    """Stages that one-hot the training vocabulary, with a bucket for unseen values, beside numeric columns (M3)."""
    stages = []
    for c in categories:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v", handleInvalid="keep", dropLast=False)]
    return [*stages, VectorAssembler(inputCols=[*[f"{c}_v" for c in categories], *numbers], outputCol="features", handleInvalid="skip")]


def fit_trees(train: DataFrame, categories: list[str], numbers: list[str], truth: str, seed: int = 7) -> PipelineModel:
    """A gradient-boosted regressor over encoded features (M1)."""
    return Pipeline(stages=[*encoder(categories, numbers), GBTRegressor(featuresCol="features", labelCol=truth, maxIter=10, maxDepth=4, seed=seed)]).fit(train)


def fit_forest(train: DataFrame, categories: list[str], numbers: list[str], truth: str, binary: bool = False, trees: int = 20, depth: int = 5,
               seed: int = 7) -> PipelineModel:
    """A random forest over encoded features: a regressor, or a classifier of 0 and 1 (M1). A single tree sees all rows and all features. Rows without truth don't count.
    Spark merges two leaves of a classifier that predict the same class."""
    alone = trees == 1
    forest = (RandomForestClassifier if binary else RandomForestRegressor)(
        featuresCol="features", labelCol=truth, numTrees=trees, maxDepth=depth, maxBins=64, bootstrap=not alone, featureSubsetStrategy="all" if alone else "auto", seed=seed)
    return Pipeline(stages=[*encoder(categories, numbers), forest]).fit(train.where(F.col(truth).isNotNull()))


def predict(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the model's prediction as ``name``: the probability of 1 if it is a classifier. Rows that lack a number the model needs are left out."""
    out = model.transform(rows)
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], value.alias(name))


def model_errors(rows: DataFrame, truth: str, models: list[str]) -> DataFrame:
    """Per model n, mae and rmse over the rows where truth and every model's prediction are there, and whether its mae is the least (then the first name) (M1)."""
    there = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (truth, *models)]
    shared = rows.where(F.forall(F.array(*there), lambda x: x))
    error = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m) - F.col(truth)).alias("e")) for m in models]))
    each = shared.select(error.alias("m")).select("m.*").groupBy("model").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    return each.withColumn("best", F.row_number().over(Window.orderBy(F.round("mae", 9), "model")) == 1)  # a row per model


def calibrate(train: DataFrame, rows: DataFrame, truth: str, score: str) -> DataFrame:
    """``platt``, ``isotonic`` and ``calibrated``: the one with the lower Brier score on ``train`` (M2); constant if one class."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(score)))
    shaped = lambda df: VectorAssembler(inputCols=["_logit"], outputCol="_f").transform(df.withColumn("_logit", F.log(p / (1 - p))))
    classes = train.agg(F.min(truth).alias("a"), F.max(truth).alias("b")).first()
    if classes["a"] == classes["b"]:
        return rows.withColumn("calibrated", F.lit(float(classes["a"] or 0)))
    platt = LogisticRegression(featuresCol="_f", labelCol=truth, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(shaped(train))
    isotonic = IsotonicRegression(featuresCol=score, labelCol=truth, predictionCol="isotonic").fit(train)

    def both(df: DataFrame) -> DataFrame:
        return isotonic.transform(platt.transform(shaped(df)).withColumn("platt", vector_to_array("_p")[1])).drop("_f", "_logit", "_p", "_c", "_r")

    brier = lambda c: F.avg(F.pow(F.col(c) - F.col(truth), 2)).alias(c)
    loss = both(train).agg(brier("platt"), brier("isotonic")).first()
    return both(rows).withColumn("calibrated", F.col("platt" if loss["platt"] <= loss["isotonic"] else "isotonic"))


def support_gate(support: Column, tau: float) -> Column:
    """n / (n + tau) (M6)."""
    return support / (support + F.lit(tau))


def shrink(own: Column, pooled: Column, support: Column, tau: float) -> Column:
    """Own mean and pooled mean blended by the support gate; the pooled one without support (M6)."""
    gate = support_gate(F.coalesce(support, F.lit(0)), tau)
    return gate * F.coalesce(own, pooled) + (1 - gate) * pooled


def choose_tau(train: DataFrame, validation: DataFrame, key: str, value: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per candidate tau, a quantile of the positive training supports, the validation error of shrunk means, and which one is chosen (M6).

    Count, sum and sum of squares per key are all that squared error needs, so validation rows are read once for all candidates: every key is
    scored against the whole grid from its five numbers. Columns: candidate (the quantile), tau, rmse, chosen (the least error, then the first).
    """
    own = train.groupBy(key).agg(F.avg(value).alias("_m"), F.count(value).alias("_n")).where("_n > 0")
    pooled = train.agg(F.avg(value).alias("_g"))
    seen = validation.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("_v"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    own = materialize(own, "support")
    at = counted(own, [], "_n")
    place = lambda q: F.round(q * (F.col("total") - 1), 9)
    spot = lambda i: F.min(F.when(F.col("upto") > i, F.col("_n")))
    value_at = [(spot(F.floor(place(q))) + F.max(place(q) - F.floor(place(q))) * (spot(F.ceil(place(q))) - spot(F.floor(place(q))))).alias(f"q{i}") for i, q in enumerate(quantiles)]
    grid = at.agg(*value_at).select(F.explode(F.array(*[F.struct(F.lit(q).alias("candidate"), F.col(f"q{i}").cast("double").alias("tau")) for i, q in enumerate(quantiles)])).alias("t")).select("t.*")
    each = seen.join(own, key, "left").crossJoin(pooled).crossJoin(F.broadcast(grid))  # one row, and one per candidate
    gate = F.coalesce("_n", F.lit(0)) / (F.coalesce("_n", F.lit(0)) + F.col("tau"))
    p = gate * F.coalesce("_m", "_g") + (1 - gate) * F.col("_g")
    scored = each.groupBy("candidate", "tau").agg(F.sqrt(F.sum(F.col("_q") - 2 * p * F.col("_s") + F.col("_v") * p * p) / F.sum("_v")).alias("rmse"))
    first = F.row_number().over(Window.orderBy(F.round("rmse", 9), "candidate"))  # a row per candidate
    return scored.withColumn("chosen", first == 1)


def fit_structure(train: DataFrame, categories: list[str], numbers: list[str], date: str, path: str) -> DataFrame:
    """The frozen encoding of structure features, written to ``path`` as Parquet and read back (M3).

    A row per value of a category, numbered by frequency and then value, and one per numeric column with centre and scale; each
    with the first and last training date. Applying it needs nothing but this table.
    """
    dates = train.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    words = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in categories]))
    seen = materialize(train.select(words.alias("w")).select("w.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n")), "values")
    order = running(seen.withColumns({"_one": F.lit(1), "_o": F.struct((-F.col("n")).alias("n"), "value")}), ["field"], "_o", {"_i": "_one"})
    vocabulary = order.select("field", "value", (F.col("_i") - 1).alias("index"), F.lit(None).cast("double").alias("centre"), F.lit(None).cast("double").alias("scale"), "n")
    figures = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in numbers]))
    centres = train.select(figures.alias("w")).select("w.*").where("x is not null and not isnan(x)").groupBy("field").agg(
        F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("index"), F.avg("x").alias("centre"), F.stddev_pop("x").alias("scale"), F.count("*").alias("n"))
    vocabulary.unionByName(centres).crossJoin(dates).write.mode("overwrite").parquet(path)  # one row
    return train.sparkSession.read.parquet(path)


def apply_structure(artefact: DataFrame, rows: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """``rows`` with, per category, ``{c}_code`` (its number; unseen values share the one after the last; null without a value), ``{c}_width`` and ``{c}_known`` (1 if there is a
    value), and per number ``{c}_z`` (0 if missing) and ``{c}_known``. ``one_hot`` makes a vector of a code and a width."""
    out = rows
    for c in categories:
        mine = artefact.where(F.col("field") == c)
        width = mine.agg(F.count("*").alias(f"{c}_width"))
        codes = mine.select(F.col("value").alias(f"_v_{c}"), F.col("index").alias(f"_i_{c}"))
        out = out.join(codes, F.col(c).cast("string") == F.col(f"_v_{c}"), "left").crossJoin(width)  # one row
        out = out.withColumn(f"{c}_code", F.when(F.col(c).isNotNull(), F.coalesce(f"_i_{c}", f"{c}_width"))).withColumn(f"{c}_known", F.col(c).isNotNull().cast("int")).drop(f"_v_{c}", f"_i_{c}")
    for c in numbers:
        one = artefact.where(F.col("field") == c).agg(F.max("centre").alias("_c"), F.max("scale").alias("_s"))
        there = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        z = F.when(there & (F.col("_s") > 0), (F.col(c) - F.col("_c")) / F.col("_s")).otherwise(0.0)
        out = out.crossJoin(one).withColumn(f"{c}_z", z).withColumn(f"{c}_known", there.cast("int")).drop("_c", "_s")  # one row
    return out


def one_hot(code: Column, width: Column) -> Column:
    """An array of ``width`` + 1 places, the last for unseen values; all zeros without a value."""
    return F.transform(F.sequence(F.lit(0), width.cast("int")), lambda i: F.coalesce((i == code).cast("int"), F.lit(0)))
