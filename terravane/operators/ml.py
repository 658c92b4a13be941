"""Clustering, classification and what goes with them, on MLlib."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.estimation import number_or_null
from terravane.operators import labels, relational
from terravane.session import share


def candidate_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Those of a list of predictors that a table has, in the list's order."""
    return [n for n in names if n in df.columns]


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with nulls, NaN and infinities of the columns replaced by the column's mean; a column without values by 0.

    One aggregate to one row, which is broadcast: no window over the whole table."""
    clean = df.withColumns({c: number_or_null(F.col(c).cast("double")) for c in columns})
    means = clean.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_m_{c}") for c in columns])
    return clean.join(F.broadcast(means)).select(*[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns less their mean in units of their population deviation; a constant column becomes 0."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.when(F.col(c).isNotNull(), 0.0))
    return df.join(F.broadcast(stats)).select(*[z(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """df with ``cluster``, on imputed and standardised columns. Labels are arbitrary."""
    ready = standardised(imputed(df, columns), columns)
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_v"), KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster")]).fit(ready)
    return model.transform(ready).drop("_v")


def kmeans_strata(df: DataFrame, value: str, k: int, total: int, seed: int = 42) -> DataFrame:
    """Strata of one variable by k-means, numbered by rising mean, with their allocations."""
    one = VectorAssembler(inputCols=[value], outputCol="_v", handleInvalid="skip").transform(df)
    found = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(one).transform(one)
    return relational.stratum_allocation(found, "_c", value, total)


@dataclass
class IsolationForest:
    """Isolation trees over at most ``sample`` rows each; scores near 1 are isolated."""

    trees: list[list[tuple]]
    norm: float

    @staticmethod
    def path_norm(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, sample: int = 100, seed: int = 42) -> IsolationForest:
        rng = np.random.default_rng(seed)
        size = min(sample, len(x))
        depth = int(np.ceil(np.log2(max(2, size))))
        grown = []
        for _ in range(trees):
            nodes: list[tuple] = []

            def grow(rows: np.ndarray, level: int) -> int:
                k = len(nodes)
                nodes.append(())
                spread = np.nonzero(rows.max(0) > rows.min(0))[0] if len(rows) > 1 else []
                if level >= depth or len(rows) <= 1 or not len(spread):
                    nodes[k] = (-1, 0.0, 0, 0, level + cls.path_norm(len(rows)))
                    return k
                f = int(rng.choice(spread))
                cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
                below = rows[:, f] < cut
                nodes[k] = (f, cut, grow(rows[below], level + 1), grow(rows[~below], level + 1), 0.0)
                return k

            grow(x[rng.choice(len(x), size, replace=False)], 0)
            grown.append(nodes)
        return cls(grown, cls.path_norm(size) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for nodes in self.trees:
            f, cut, left, right, length = (np.array(c) for c in zip(*nodes))
            at = np.zeros(len(x), int)
            while (inner := np.nonzero(f[at] >= 0)[0]).size:
                k = at[inner]
                at[inner] = np.where(x[inner, f[k]] < cut[k], left[k], right[k])
            total += length[at]
        return 2 ** (-total / len(self.trees) / self.norm)


def without_outliers(df: DataFrame, columns: list[str], contamination: float = 0.1, sample_rows: int = 10_000, seed: int = 42) -> DataFrame:
    """df without the ``contamination`` share of rows that an isolation forest finds most isolated.

    The trees see at most ``sample_rows`` rows (those of least hash); every row is scored; the cut is the scores'
    quantile over all rows."""
    fitted = imputed(df, columns)
    rows = fitted.orderBy(F.xxhash64(*columns)).limit(sample_rows).select(*columns).toPandas().to_numpy(float)
    if len(rows) < 2:
        return df
    forest = share(df.sparkSession, IsolationForest.fit(rows, seed=seed))

    def score(*c: pd.Series) -> pd.Series:
        return pd.Series(forest().score(np.stack([x.to_numpy(float) for x in c], 1)))

    scored = fitted.withColumn("_score", F.pandas_udf(score, "double")(*columns))
    cut = scored.agg(F.percentile_approx("_score", 1 - contamination, 10_000).alias("_cut"))
    return scored.join(F.broadcast(cut)).where("_score <= _cut").drop("_score", "_cut")


def hash_split(df: DataFrame, id_: str, share: float = 0.7, seed: int = 0) -> DataFrame:
    """df with ``part``: 'train' for about a share of the ids, else 'test'; the same for an id wherever it stands."""
    h = relational.arithmetic_hash(F.col(id_), seed)
    return df.withColumn("part", F.when(h < int(share * 2**32), "train").otherwise("test"))


def split_labelled(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a label, rows without one); NaN is none."""
    there = F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))
    return df.where(there), df.where(~F.coalesce(there, F.lit(False)))


def require_two_classes(df: DataFrame, target: str) -> None:
    """Raises unless the target holds two different values, nulls aside."""
    n = df.where(F.col(target).isNotNull()).select(target).distinct().limit(3).count()
    if n != 2:
        raise ValueError(f"the target must have two classes, it has {'more' if n > 2 else n}")


def training_rows(df: DataFrame, predictors: list[str], target: str, outlier_share: float = 0.0, seed: int = 42) -> DataFrame:
    """The labelled rows that a forest is fitted on: missing predictors take the mean of all rows, labelled or not; then the
    share of isolated rows is left out."""
    columns = candidate_columns(df, predictors)
    training = imputed(df, columns).where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("double"))
    return without_outliers(training, columns, outlier_share, seed=seed) if outlier_share else training


#: Trees that are grown at once: a fit keeps a count for each of its trees with each row, and the driver their open nodes.
TREES_AT_ONCE = 250


class ForestParts:
    """Forests with trees of their own as one: probabilities are means by trees, predictions follow from them."""

    def __init__(self, models: list, trees: list[int]):
        self.models, self.trees = models, trees

    def transform(self, df: DataFrame) -> DataFrame:
        total, out = sum(self.trees), df
        share = F.lit(0.0)
        for k, (m, n) in enumerate(zip(self.models, self.trees)):
            out = m.transform(out).withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")
            share = share + F.col(f"_p{k}") * n / total
        out = out.withColumn("chg_probability", share).drop(*[f"_p{k}" for k in range(len(self.models))])
        return out.withColumn("prediction", (F.col("chg_probability") > 0.5).cast("double"))


def change_probability(df: DataFrame, predictors: list[str], target: str, trees: int = 100, seed: int = 42, outlier_share: float = 0.0, search: int = 0, neural: bool = False) -> tuple[DataFrame, object]:
    """(df with ``chg_probability``, model): a random forest with balanced class weights on the labelled rows.

    Missing predictors take the mean of all rows. ``outlier_share`` removes isolated training rows first; ``search`` tries
    so many random draws of the forest's parameters by 5-fold cross-validation; ``neural`` takes a perceptron instead."""
    columns = candidate_columns(df, predictors)
    ready = imputed(df, columns)
    training = training_rows(df, predictors, target, outlier_share, seed)
    require_two_classes(training, target)
    weights = labels.class_weights(training, target).select(target, "weight")
    training = relational.cut_lineage(training.join(F.broadcast(weights), target))  # two rows
    assembler = VectorAssembler(inputCols=columns, outputCol="_v")
    if neural:
        learner = MultilayerPerceptronClassifier(featuresCol="_v", labelCol=target, layers=[len(columns), 16, 2], seed=seed, maxIter=50)
        model = Pipeline(stages=[assembler, learner]).fit(training)
    else:
        forest = RandomForestClassifier(featuresCol="_v", labelCol=target, weightCol="weight", numTrees=trees, seed=seed)
        if not search:
            parts = [min(TREES_AT_ONCE, trees - k) for k in range(0, trees, TREES_AT_ONCE)]
            grow = lambda k, n: Pipeline(stages=[assembler, forest.copy({forest.numTrees: n, forest.seed: seed + k})]).fit(training)
            model = ForestParts([grow(k, n) for k, n in enumerate(parts)], parts)
            return model.transform(ready).drop("prediction"), model
        else:
            rng = np.random.default_rng(seed)
            draws = [{forest.numTrees: int(rng.choice([50, 100, 200])), forest.maxDepth: int(rng.integers(3, 11)), forest.minInstancesPerNode: int(rng.integers(1, 6))} for _ in range(search)]
            cv = CrossValidator(estimator=Pipeline(stages=[assembler, forest]), estimatorParamMaps=draws, evaluator=BinaryClassificationEvaluator(labelCol=target), numFolds=5, seed=seed)
            model = cv.fit(training).bestModel
    out = model.transform(ready).withColumn("chg_probability", vector_to_array("probability")[1])
    return out.drop("_v", "rawPrediction", "probability", "prediction"), model


def permutation_importance(model, df: DataFrame, columns: list[str], target: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """``feature, importance, sd``: the mean loss of accuracy over ``repeats`` shuffles of each column.

    A shuffle pairs each row with the value of the row before it in a seeded hash order; all shuffles of all columns are
    numbered, joined and scored in one plan."""
    d = imputed(df.where(F.col(target).isNotNull()), columns).withColumn("_id", F.monotonically_increasing_id())
    d = relational.cut_lineage(d)
    spark = df.sparkSession
    hit = F.avg((F.col("prediction") == F.col(target)).cast("double")).alias("hit")
    base = model.transform(d).agg(hit).first()[0] or 0.0
    n = d.count()
    tries = d.select("_id", target, F.struct(*columns).alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r"))
    order = relational.numbered(tries, ["_r", F.xxhash64("_id", F.lit(seed * 1000) + F.col("_r")), "_id"], "_k").withColumn("_k", F.col("_k") - F.col("_r") * n)
    moved = order.select("_r", ((F.col("_k") + 1) % n).alias("_k"), F.col("_own").alias("_other"))
    # scoring is heavy: spread over the cores, whatever the size
    given = order.join(moved, ["_r", "_k"]).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_r", "_k")
    one = lambda c: F.struct(F.lit(c).alias("feature"), *[F.col(f"{'_other' if x == c else '_own'}.{x}").alias(x) for x in columns])
    shuffled = given.select(target, "_r", F.explode(F.array(*[one(c) for c in columns])).alias("_s")).select(target, "_r", "_s.*")
    hits = {(x["feature"], x["_r"]): x["hit"] for x in model.transform(shuffled).groupBy("feature", "_r").agg(hit).collect()}
    drops = {c: [base - (hits.get((c, k)) or 0.0) for k in range(repeats)] for c in columns}
    rows = [(c, float(np.mean(x)), float(np.std(x))) for c, x in drops.items()]
    return spark.createDataFrame(rows, "feature string, importance double, sd double").orderBy(F.desc("importance"), "feature")
