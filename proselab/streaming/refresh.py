"""N-02, ST-09 live: a linear discriminator that is refitted from the last outputs of a stream.

Every batch of a stream puts its outputs into a buffer of the last ones; every so many batches the discriminator
takes some gradient steps that tell them from human samples, and goes on from there at the next refit. A step's
gradient is a sum over rows that Spark adds up; only the weights, one for each feature, come to the driver. Buffer
and weights are tables named by the batch, made from those of the batch before, so that a batch that is handed
over again after a crash gives the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselab.sources.readers import there

MODEL = "batch long, steps long, weights array<double>"
BUFFER = "place long, features array<double>"


def score(features: Column, weights: list[float]) -> Column:
    """The chance that a row is an output; the last weight is the bias. Null where features are missing."""
    products = F.zip_with(features, F.array(*map(F.lit, weights[:-1])), lambda x, w: x * w)
    return 1 / (1 + F.exp(-(F.aggregate(products, F.lit(0.0), lambda a, x: a + x) + weights[-1])))


def fitted(outputs: DataFrame, humans: DataFrame, weights: list[float], steps: int, rate: float) -> list[float]:
    """The weights after ``steps`` steps down the mean logistic loss of outputs (1) and humans (0), both of the same say.

    Without rows of either kind the weights stay.
    """
    size = len(weights) - 1
    labelled = outputs.select("features", F.lit(1.0).alias("y")).unionAll(humans.select("features", F.lit(0.0).alias("y")))
    # rows whose features are not whole teach nothing
    rows = labelled.where((F.size("features") == size) & F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x))).persist()
    try:
        count = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(count) < 2:
            return weights
        say = F.when(F.col("y") == 1, 0.5 / count[1.0]).otherwise(0.5 / count[0.0])
        for _ in range(steps):
            off = (score(F.col("features"), weights) - F.col("y")) * say
            sums = rows.agg(*(F.sum(off * F.col("features")[k]) for k in range(size)), F.sum(off)).first()
            weights = [w - rate * g for w, g in zip(weights, sums)]
        return weights
    finally:
        rows.unpersist()


def latest(spark: SparkSession, path: str, batch: int, size: int) -> tuple[int, list[float]]:
    """Steps so far and weights behind ``batch``; zeros before the first."""
    if batch < 0 or not there(spark, f"{path}/model/{batch}/_SUCCESS"):
        return 0, [0.0] * (size + 1)
    r = spark.read.schema(MODEL).json(f"{path}/model/{batch}").first()
    return r.steps, r.weights


def refresher(path: str, humans: DataFrame, size: int, every: int = 50, most: int = 200, steps: int = 10, rate: float = 0.5) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls with rows (place, features): keeps the ``most`` with the highest place, refits at every ``every``-th batch."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if there(spark, f"{path}/model/{number}/_SUCCESS"):
            return
        before = f"{path}/buffer/{number - 1}"
        held = batch.select(F.col("place").cast("long").alias("place"), F.col("features").cast("array<double>").alias("features"))
        if there(spark, f"{before}/_SUCCESS"):
            held = held.unionAll(spark.read.schema(BUFFER).parquet(before))
        held.orderBy(F.col("place").desc(), "features").limit(most).write.mode("overwrite").parquet(f"{path}/buffer/{number}")
        done, weights = latest(spark, path, number - 1, size)
        if (number + 1) % every == 0:
            weights, done = fitted(spark.read.schema(BUFFER).parquet(f"{path}/buffer/{number}"), humans, weights, steps, rate), done + steps
        spark.createDataFrame([(number, done, weights)], MODEL).coalesce(1).write.mode("overwrite").json(f"{path}/model/{number}")

    return run
