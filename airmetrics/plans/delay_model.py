"""Arrival-delay regression (M1-M7) as Spark ML jobs.

The reference trains a boosted-tree model on one machine. Here: the training
frame is a filtered projection (M1); the split is a hash of the flight id, so it
is stable under any partitioning and re-computation (M2); categorical columns
become out-of-fold means of the label (M3); boosting runs in written stages and stops by patience on
the validation error (M4, ``boosting``); metrics, residuals and scores are single
aggregations or projections (M5-M7).
"""

from __future__ import annotations

import datetime as dt
import uuid

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.operators.histogram import histogram
from airmetrics.operators.joins import bounded_broadcast
from airmetrics.plans import boosting
from airmetrics.session import cut_lineage, scratch_path

CATEGORICAL = ["op_carrier_airline_id", "tail_num", "origin_airport_id", "dest_airport_id"]
NUMERIC = ["distance", "flights"]
LABEL = "arr_delay"
FEATURES = CATEGORICAL + NUMERIC
TEST_SHARE = 0.2
FOLDS = 8
# md5 hex digests below this bound are the test split (share 0.2 of the hash space)
_TEST_BOUND = "33333333333333333333333333333333"


def training_frame(flights: DataFrame, days: int = 365) -> DataFrame:
    """M1: flights of the last ``days`` days before the last date, label present,
    the six features; rows with any null dropped."""
    hi = flights.agg(F.max("fl_date")).first()[0]
    if hi is None:
        return flights.select("flight_id", *FEATURES, LABEL).limit(0)
    start = hi - dt.timedelta(days=days)
    return (flights.where((F.col("fl_date") >= F.lit(start)) & F.col(LABEL).isNotNull())
            .select("flight_id", *FEATURES, LABEL).dropna())


def split_flag(seed: int = 42) -> F.Column:
    """M2: true for the test share; a pure function of flight_id and seed."""
    return F.md5(F.concat(F.col("flight_id").cast("string"), F.lit(f":{seed}"))) < F.lit(_TEST_BOUND)


def split(df: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M2: (train, test)."""
    flag = split_flag(seed)
    return df.where(~flag), df.where(flag)


def fold_of(folds: int = FOLDS, seed: int = 42) -> F.Column:
    """The fold of a train row, 0 .. folds - 1 (at most 16); a pure function of flight_id and seed."""
    digit = F.substring(F.md5(F.concat(F.col("flight_id").cast("string"), F.lit(f":fold{seed}"))), 1, 1)
    return ((F.instr(F.lit("0123456789abcdef"), digit) - 1) % folds).cast("int")


@dataclass
class TargetEncoding:
    """M3: label sums per (column, value, fold) of the train rows.

    A row outside of train, and ``encode(..., out_of_fold=False)``, gets the smoothed mean of its value over
    all train rows: (sum + smoothing * mean) / (n + smoothing). A train row gets the same from the rows of the
    other folds alone (their value sums and their overall mean), so no train row sees its own label. A value that those
    rows do not hold gets their overall mean. ``table``: (column, value, fold, encoded), fold -1 for
    all train rows; ``default``: fold -> overall mean.
    """

    table: DataFrame
    default: dict[int, float]
    folds: int
    seed: int

    def encode(self, df: DataFrame, out_of_fold: bool = False) -> DataFrame:
        """``df`` with a column <name>_te for each categorical column. The tables hold one row per value
        and fold; they are broadcast when their count allows, else Spark joins by shuffle."""
        fold = fold_of(self.folds, self.seed) if out_of_fold else F.lit(-1)
        out = df.withColumn("_fold", fold)
        default = F.element_at(F.create_map(*[F.lit(x) for kv in self.default.items() for x in kv]), F.col("_fold"))
        for c in CATEGORICAL:
            known = self.table.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("fold").alias("_f"), F.col("encoded").alias("_e"))
            out = (out.join(bounded_broadcast(known), (F.col(c).cast("string") == F.col("_v")) & (F.col("_fold") == F.col("_f")), "left")
                   .withColumn(f"{c}_te", F.coalesce("_e", default)).drop("_v", "_f", "_e"))
        return out.drop("_fold")


def fit_encoding(train: DataFrame, folds: int = FOLDS, smoothing: float = 10.0, seed: int = 42) -> TargetEncoding:
    """One map-side aggregation of the train rows gives all four columns; what follows works on its result."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in CATEGORICAL]))
    own = cut_lineage(train.select(fold_of(folds, seed).alias("fold"), F.col(LABEL).alias("y"), cells.alias("cell"))
                      .groupBy("cell.column", "cell.value", "fold").agg(F.sum("y").alias("s"), F.count("y").alias("n")))
    per_fold = own.where(F.col("column") == CATEGORICAL[0]).groupBy("fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    s, n = sum(r["s"] for r in per_fold), sum(r["n"] for r in per_fold)
    rest = {r["fold"]: (s - r["s"], n - r["n"]) for r in per_fold}
    default = {-1: s / n if n else 0.0} | {f: (rest[f][0] / rest[f][1] if f in rest and rest[f][1] else s / n if n else 0.0) for f in range(folds)}
    whole = own.groupBy("column", "value").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    others = own.select("column", "value", "fold", F.col("s").alias("own_s"), F.col("n").alias("own_n")).join(whole, ["column", "value"]).select(
        "column", "value", "fold", (F.col("s") - F.col("own_s")).alias("s"), (F.col("n") - F.col("own_n")).alias("n"))
    mean = F.element_at(F.create_map(*[F.lit(x) for kv in default.items() for x in kv]), F.col("fold"))
    table = (whole.withColumn("fold", F.lit(-1)).select("column", "value", "fold", "s", "n").unionByName(others)
             .select("column", "value", "fold", ((F.col("s") + smoothing * mean) / (F.col("n") + smoothing)).alias("encoded")))
    return TargetEncoding(cut_lineage(table), default, folds, seed)


@dataclass
class DelayModel:
    """The encoding, the trees of the best round (on top of the train mean) and the validation error after
    0, 1, ... rounds (None without validation rows)."""

    encoding: TargetEncoding
    trees: PipelineModel
    history: list[float] = field(default_factory=list)

    @property
    def best_round(self) -> int:
        return boosting.best_round(self.history)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.trees.transform(self.encoding.encode(df)).withColumn("prediction", F.col("prediction") + self.encoding.default[-1])


def fit_delay_model(train: DataFrame, validation: DataFrame | None = None, max_iter: int = 1000, max_depth: int = 6, step: float = 0.1,
                    seed: int = 42, patience: int = 50, stage: int = 10, path: str | None = None) -> DelayModel:
    """M3+M4: encode and fit. The encoding sees ``train`` only and gives its rows out-of-fold means, so
    no row's features hold its own label. With ``validation`` rows, boosting ends after ``patience`` rounds
    without a better mean absolute error on them (the reference stops on its eval set); pass a hash split of the train
    rows, never the rows that the metrics are taken from. With ``path`` a run that died is taken up again
    by the same call; without it the run's folder is removed at the end."""
    spark = train.sparkSession
    place = path or scratch_path(spark, f"boost-{uuid.uuid4().hex}")
    if path and boosting.exists(spark, f"{place}/means/_SUCCESS"):
        encoding = load_encoding(spark, place)
    else:
        encoding = fit_encoding(train, seed=seed)
        if path:
            save_encoding(encoding, place)
    data = encoding.encode(train, out_of_fold=True).withColumn("is_validation", F.lit(False))
    if validation is not None:
        data = data.unionByName(encoding.encode(validation).withColumn("is_validation", F.lit(True)))
    features = VectorAssembler(inputCols=[f"{c}_te" for c in CATEGORICAL] + NUMERIC, outputCol="features", handleInvalid="keep")
    data = features.transform(data.withColumn(boosting.RESIDUAL, F.col(LABEL) - encoding.default[-1]))
    trees, history = boosting.boost(data, f"{place}/rounds", max_iter, max_depth, step, patience, stage, seed)
    if not path:
        boosting.remove(spark, place)
    return DelayModel(encoding, PipelineModel(stages=[features, trees]), history)


def score(model: DelayModel, df: DataFrame) -> DataFrame:
    """M7: (flight_id, real, estimate, residual)."""
    s = model.transform(df)
    return s.select("flight_id", F.col(LABEL).alias("real"), F.col("prediction").alias("estimate"),
                    (F.col(LABEL) - F.col("prediction")).alias("residual"))


def regression_metrics(scored: DataFrame, real: str = "real", estimate: str = "estimate",
                       digits: int | None = 9) -> DataFrame:
    """M5: MAE, RMSE, R2 in one aggregation -> (n, mae, rmse, r2)."""
    err = F.col(real) - F.col(estimate)
    m = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"),
                   F.sqrt(F.avg(err * err)).alias("rmse"),
                   (F.lit(1.0) - F.sum(err * err) / (F.count(F.lit(1)) * F.var_pop(F.col(real)))).alias("r2"))
    if digits is None:
        return m
    return m.select("n", *[F.round(c, digits).alias(c) for c in ["mae", "rmse", "r2"]])


def residuals(scored: DataFrame) -> DataFrame:
    """M6: (real, estimate, residual)."""
    return scored.select("real", "estimate", (F.col("real") - F.col("estimate")).alias("residual"))


def residual_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    """M6: 30-bin histogram of the residuals."""
    return histogram(residuals(scored), "residual", bins)


def route_mean_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """A reference predictor: the train mean of the route (else the global mean).
    Deterministic, so metrics of it can be checked against SQL."""
    means = train.groupBy("origin_airport_id", "dest_airport_id").agg(F.avg(LABEL).alias("_route_mean"))
    overall = train.agg(F.avg(LABEL)).first()[0]  # one scalar to the driver
    s = test.join(bounded_broadcast(means), ["origin_airport_id", "dest_airport_id"], "left")
    return s.select("flight_id", F.col(LABEL).alias("real"),
                    F.coalesce(F.col("_route_mean"), F.lit(overall).cast("double")).alias("estimate"))


def save_encoding(encoding: TargetEncoding, path: str) -> None:
    spark = encoding.table.sparkSession
    encoding.table.write.mode("overwrite").parquet(f"{path}/encoding")
    spark.createDataFrame([(f, m, encoding.folds, encoding.seed) for f, m in encoding.default.items()],
                          "fold int, mean double, folds int, seed int").write.mode("overwrite").parquet(f"{path}/means")


def load_encoding(spark: SparkSession, path: str) -> TargetEncoding:
    means = spark.read.parquet(f"{path}/means").collect()
    return TargetEncoding(spark.read.parquet(f"{path}/encoding"), {r["fold"]: r["mean"] for r in means}, means[0]["folds"], means[0]["seed"])


def save(model: DelayModel, path: str) -> None:
    """M7: save (overwrite): the trees, the encoding's table, its overall means and the errors by round."""
    spark = model.encoding.table.sparkSession
    model.trees.write().overwrite().save(f"{path}/trees")
    save_encoding(model.encoding, path)
    spark.createDataFrame(list(enumerate(model.history)), "round int, error double").write.mode("overwrite").parquet(f"{path}/history")


def load(spark: SparkSession, path: str) -> DelayModel:
    history = [r["error"] for r in spark.read.parquet(f"{path}/history").orderBy("round").collect()]
    return DelayModel(load_encoding(spark, path), PipelineModel.load(f"{path}/trees"), history)
