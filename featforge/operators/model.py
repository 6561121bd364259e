"""Table models on MLlib: fit, refit, pseudo-label, blend, cascade, importance."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import portable_hash, unit_interval
from ..session import stored
from . import trees
from .align import rows_predicted, union_rows
from .ordered import dense_position
from .split import with_folds

# Letters counted as ratio features of a text.
RATIO_MARKS = {"junk": r"[!?*#%]", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "blank": r"\s",
               "accent": r"[À-ÿ]", "e": "[eE]", "th": "th", "sch": "sch", "que": "que", "cion": "ción"}


def text_ratios(text: Column, marks: dict[str, str] = RATIO_MARKS) -> list[Column]:
    """Share of the characters that match each mark: plain numeric features of a text."""
    n = F.greatest(F.length(text), F.lit(1))
    return [(F.regexp_count(text, F.lit(p)) / n).alias(f"r_{name}") for name, p in marks.items()]


def classifier(features: Sequence[str], label: str, kind: str = "forest", trees: int = 30,
               depth: int = 8, seed: int = 42) -> Pipeline:
    """Classifier over numeric columns; the decoded class goes to ``prediction``."""
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="error",
                          stringOrderType="alphabetAsc")
    # A gap in a feature takes the feature's mean.
    gaps = Imputer(inputCols=list(features), outputCols=[f"_f_{f}" for f in features])
    assemble = VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="_x", handleInvalid="keep")
    if kind == "logistic":
        model = LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p",
                                   probabilityCol="probability", maxIter=50, regParam=1e-3)
    else:
        # "entropy" and "gini" choose the impurity; "forest" is gini.
        model = RandomForestClassifier(
            featuresCol="_x", labelCol="_y", predictionCol="_p", probabilityCol="probability",
            numTrees=trees, maxDepth=depth, seed=seed,
            impurity="entropy" if kind == "entropy" else "gini")
    return Pipeline(stages=[index, gaps, assemble, model])


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Predicted class by name and its probability; needs no label column."""
    labels = model.stages[0].labels
    scored = df
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    decoded = IndexToString(inputCol="_p", outputCol=out, labels=labels).transform(scored)
    return decoded.withColumn("confidence", F.array_max(vector_to_array("probability"))).drop(
        "_x", "_p", "rawPrediction", "probability", *model.stages[1].getOutputCols())


def regressor(features: Sequence[str], label: str, kind: str = "boosted", trees: int = 20,
              depth: int = 5, seed: int = 42, out: str = "prediction") -> Pipeline:
    assemble = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    if kind == "forest":
        model = RandomForestRegressor(featuresCol="_x", labelCol=label, predictionCol=out,
                                      numTrees=trees, maxDepth=depth, seed=seed)
    else:
        model = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol=out, maxIter=trees,
                             maxDepth=depth, seed=seed, lossType="absolute")
    return Pipeline(stages=[assemble, model])


class Candidate(NamedTuple):
    """A named way to learn: ``fit`` takes labelled rows and gives a function that adds ``prediction`` to rows."""

    name: str
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def piped(name: str, pipe: Pipeline) -> Candidate:
    """A candidate from a pipeline of ``classifier``."""
    def fit(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        fitted = pipe.fit(rows)
        return lambda df: predict(fitted, df)
    return Candidate(name, fit)


def extra_trees(name: str, features: Sequence[str], label: str, **settings) -> Candidate:
    """A candidate of extremely randomised trees."""
    def fit(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        forest = trees.fit(rows, features, label, **settings)
        return lambda df: trees.predict(forest, df)
    return Candidate(name, fit)


def _right(predicted: DataFrame, label: str) -> Column:
    return F.coalesce((F.col("prediction") == F.col(label).cast("string")).cast("long"), F.lit(0).cast("long"))


def leaderboard(train: DataFrame, candidates: Sequence[Candidate], key: str, label: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """Out-of-fold hits of every candidate: (name, n, n_right, balanced), ``balanced`` being the mean share of right
    predictions over the classes (1 / classes for a constant one). Folds come from the key's hash."""
    rows = stored(with_folds(train, key, folds, seed, "_fold"), "folds")
    scored = []
    for c in candidates:
        for i in range(folds):
            learned = c.fit(rows.filter(F.col("_fold") != i).drop("_fold"))
            out = learned(rows.filter(F.col("_fold") == i).drop("_fold"))
            scored.append(out.select(F.lit(c.name).alias("name"), F.col(label).alias("_y"), _right(out, label).alias("_r")))
    per_class = union_rows(*scored).groupBy("name", "_y").agg(F.count("*").alias("n"), F.sum("_r").alias("n_right"))
    return per_class.groupBy("name").agg(F.sum("n").alias("n"), F.sum("n_right").alias("n_right"), F.avg(F.col("n_right") / F.col("n")).alias("balanced"))


def sample_share(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) for each key; the rows below a share are a sample, and larger shares hold smaller ones."""
    return unit_interval(portable_hash(key, seed))


def successive_halving(train: DataFrame, valid: DataFrame, candidates: Sequence[Candidate], key: str, label: str,
                       first_share: float = 0.25, factor: int = 2, seed: int = 42) -> tuple[DataFrame, Candidate]:
    """Scores (rung, share, name, n_train, n_valid, n_right) of all rungs, and the candidate chosen by them.

    The first rung fits all candidates on a share of the training rows chosen by hash; the best of them, one in
    ``factor``, go on to ``factor`` times the share, which holds the rows before, until one is left that has seen all
    rows. Every rung reads the same written table and scores all its candidates on the same validation rows. Of equal
    scores the name that sorts first wins. With the result ``refit`` learns from training and validation rows.
    """
    if len({c.name for c in candidates}) < len(candidates):
        raise ValueError("names of candidates repeat")
    train = stored(train.withColumn("_share", sample_share(F.col(key), seed)), "train")
    valid = stored(valid, "valid")
    left, share, rung, rungs = list(candidates), first_share, 1, []
    while True:
        share = min(1.0, share) if len(left) > 1 else 1.0
        sample = train.filter(F.col("_share") < share).drop("_share")
        n_train = sample.count()
        scored = []
        for c in left:
            out = c.fit(sample)(valid)
            scored.append(out.select(F.lit(c.name).alias("name"), _right(out, label).alias("_r")))
        hits = union_rows(*scored).groupBy("name").agg(F.count("*").alias("n_valid"), F.sum("_r").alias("n_right"))
        rungs.append(stored(hits.select(F.lit(rung).alias("rung"), F.lit(share).alias("share"), "name", F.lit(n_train).cast("long").alias("n_train"),
                                        "n_valid", "n_right"), "rung"))
        order = [r["name"] for r in rungs[-1].orderBy(F.desc("n_right"), "name").collect()]  # one row per candidate
        if len(left) == 1:
            return union_rows(*rungs), left[0]
        keep = set(order[:max(1, len(left) // factor)])
        left = [c for c in left if c.name in keep]
        share, rung = share * factor, rung + 1


def refit(candidate: Candidate, train: DataFrame, valid: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The chosen candidate, fitted again on all labelled rows."""
    return candidate.fit(union_rows(train, valid))


def refit_full(pipe: Pipeline, train: DataFrame, held_out: DataFrame) -> PipelineModel:
    """Fit again on all labelled rows."""
    return pipe.fit(union_rows(train, held_out))


def pseudo_label(pipe: Pipeline, model: PipelineModel, train: DataFrame, unlabelled: DataFrame,
                 label: str, min_confidence: float = 0.95) -> PipelineModel:
    """Refit with the unlabelled rows whose prediction is confident enough."""
    sure = predict(model, unlabelled).filter(F.col("confidence") >= min_confidence)
    extra = sure.withColumn(label, F.col("prediction").cast(train.schema[label].dataType)).select(
        *train.columns)
    return pipe.fit(union_rows(train, extra))


def blend(first: Column, second: Column, weight: float = 0.6) -> Column:
    return weight * first + (1 - weight) * second


def blended_regression(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                       weight: float = 0.6, trees: int = 20) -> DataFrame:
    """Two regressors fitted on the same rows, blended on the test rows."""
    a = regressor(features, label, "boosted", trees, out="_p1").fit(train)
    b = regressor(features, label, "forest", trees, out="_p2").fit(train)
    both = b.transform(a.transform(test).drop("_x")).drop("_x")
    return both.withColumn("prediction", blend(F.col("_p1"), F.col("_p2"), weight)).drop("_p1", "_p2")


def cross_validated(df: DataFrame, fold: str, k: int,
                    fit_predict: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Out-of-fold predictions of all rows: each fold is predicted by the others."""
    parts = [fit_predict(df.filter(F.col(fold) != i), df.filter(F.col(fold) == i)) for i in range(k)]
    return union_rows(*parts)


#: Rounds of the permutation of positions; steps after which every position has come back into the range.
ROUNDS, STEPS = 4, 16


def permuted(position: Column, n: int, key: str) -> Column:
    """A keyed bijection of the positions 0 to n - 1: the position whose row gives its value to this one.

    A Feistel network over pairs (position div b, position mod b), a and b being about the root of n (Black and
    Rogaway, 2002). Results beyond n - 1 are permuted again; there are fewer than ``a`` of them, so with up to 16 a few
    steps always do, and for larger n more are needed with a chance below n ** -7, which fails the job.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def number(i: int, x: Column) -> Column:
        text = F.concat(F.lit(f"{key}:{i}:"), x.cast("string"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

        def pair(i: int, s: Column) -> Column:
            left = F.pmod(s["l"] + number(2 * i, s["r"]), F.lit(a)).cast("long")
            return F.transform(F.array(left), lambda v: F.struct(v.alias("l"), F.pmod(s["r"] + number(2 * i + 1, v), F.lit(b)).cast("long").alias("r")))[0]

        def turn(i: int) -> Callable[[Column], Column]:
            return lambda s: pair(i, s)

        state = F.array(start)
        for i in range(ROUNDS):
            state = F.transform(state, turn(i))
        return F.transform(state, lambda s: s["l"] * b + s["r"])[0]

    first = once(position.cast("long"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("position outside the permutation")).cast("long"))


def donors(df: DataFrame, key: str, repeats: int, seed: int = 42) -> DataFrame:
    """Rows (``repeat``, ``_at``, ``_from``): for each position in the order of ``key`` the position it takes from.

    Every repeat is another bijection, so each row gives once and takes once.
    """
    n = df.count()
    rows = df.select("_at").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    chosen = F.coalesce(*[F.when(F.col("repeat") == r, permuted(F.col("_at"), n, f"{seed}:{r}")) for r in range(1, repeats + 1)])
    return rows.select("repeat", "_at", chosen.alias("_from"))


def permutation_importance(score: Callable[[DataFrame], DataFrame], df: DataFrame, key: str, features: Sequence[str],
                           label: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Loss of accuracy when the values of one feature are dealt anew among the rows: (feature, importance, error).

    ``score`` adds ``prediction`` to rows with the features, such as ``lambda d: predict(model, d)``. Rows are numbered
    by ``key`` once; in each repeat a keyed bijection of the numbers says which row a value comes from. ``importance``
    is the mean over the repeats, ``error`` its standard error. All features and repeats are scored in one pass.
    """
    rows = stored(dense_position(df.select(key, label, *features), [], [key], "_at"), "numbered")
    given = rows.select(F.col("_at").alias("_from"), *[F.col(f).alias(f"_d_{f}") for f in features])
    paired = rows.join(donors(rows, key, repeats, seed), "_at").join(given, "_from")
    # The plain rows and those with one feature changed as one stacked table.
    variants = [F.struct(F.lit("").alias("feature"), *[F.col(f).alias(f) for f in features])]
    for changed in features:
        variants.append(F.struct(F.lit(changed).alias("feature"), *[
            F.col(f"_d_{f}" if f == changed else f).alias(f) for f in features]))
    stacked = paired.select(label, "repeat", F.inline(F.array(*variants)))
    hits = score(stacked).groupBy("repeat", "feature").agg(
        F.avg((F.col("prediction") == F.col(label).cast("string")).cast("double")).alias("right"))
    whole = F.max(F.when(F.col("feature") == "", F.col("right"))).over(Window.partitionBy("repeat"))  # one row per feature and repeat
    lost = hits.withColumn("lost", whole - F.col("right")).filter("feature <> ''")
    return lost.groupBy("feature").agg(F.avg("lost").alias("importance"),
                                       (F.stddev_samp("lost") / F.sqrt(F.count("*"))).alias("error"))


def model_importance(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, model.stages[-1].featureImportances.toArray().tolist()))


def cascade(test: DataFrame, first: DataFrame, key: str, single: str, rest: str,
            second_stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Join the two stages: rows predicted ``single`` keep that, the rest get a second opinion.

    ``first`` has key and ``prediction``. ``second_stage`` maps the remaining rows to key
    and ``prediction``. A first prediction that is neither fails the job. Sort the result with ``writers.write_sorted`` when a file is wanted.
    """
    asked = F.coalesce(F.col("prediction").isin(single, rest), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("first stage predicted neither class: "), F.coalesce(F.col("prediction"), F.lit("NULL"))))
    first = first.withColumn("prediction", F.when(asked, F.col("prediction")).otherwise(wrong.cast("string")))
    remaining = rows_predicted(test, first, key, "prediction", rest)
    done = first.filter(F.col("prediction") == single).select(key, "prediction")
    return union_rows(done, second_stage(remaining).select(key, "prediction"))
