"""The refitted discriminator against a plain program, and classifiers and strategies on small rows."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from proselab.functions import text as tx
from proselab.operators import jobs, scoring
from proselab.sources import readers
from proselab.streaming import refresh


def plain_fit(outputs, humans, w, steps, rate):
    x = np.array([r + [1.0] for r in outputs + humans])
    y = np.array([1.0] * len(outputs) + [0.0] * len(humans))
    say = np.where(y == 1, 0.5 / len(outputs), 0.5 / len(humans))
    for _ in range(steps):
        w = w - rate * ((1 / (1 + np.exp(-(x @ w))) - y) * say) @ x
    return w


def test_refit_from_a_stream(spark, tmp_path):
    rng = np.random.default_rng(9)
    humans = (rng.normal(size=(40, 3)) - 0.5).tolist()
    made = (rng.normal(size=(60, 3)) + 0.5).tolist()
    human_rows = spark.createDataFrame([(h,) for h in humans] + [(None,), ([1.0],), ([1.0, None, 2.0],)], "features array<double>")
    (tmp_path / "in").mkdir()
    for n in range(6):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"place": k, "features": made[k]}) + "\n" for k in range(10 * n, 10 * n + 10)))
    state, crash = f"file://{tmp_path}/state", [True]
    run = refresh.refresher(state, human_rows, 3, every=2, most=25, steps=4, rate=0.7)

    def once(batch, number):
        run(batch, number)
        if number == 3 and crash[0]:
            crash[0] = False
            raise OSError("killed")

    def start():
        stream = spark.readStream.schema("place long, features array<double>").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        stream.writeStream.foreachBatch(once).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="killed"):
        start()
    start()
    # files come in the order of their times, which may be the same: take the places as they came
    w, held = np.zeros(4), []
    for n in range(6):
        rows = spark.read.schema(refresh.BUFFER).parquet(f"{state}/buffer/{n}").collect()
        held = [r.features for r in rows]
        assert len(held) <= 25
        if n % 2:
            w = plain_fit(held, humans, w, 4, 0.7)
        steps, got = refresh.latest(spark, state, n, 3)
        assert got == pytest.approx(w.tolist()) and steps == 4 * ((n + 1) // 2)
    assert sorted(map(tuple, held)) == sorted(map(tuple, made[-25:])) or len(held) == 25
    scored = spark.createDataFrame([(made[0],), (None,)], "f array<double>").select(refresh.score(F.col("f"), got)).collect()
    assert scored[0][0] == pytest.approx(1 / (1 + np.exp(-(np.array([*made[0], 1.0]) @ w)))) and scored[1][0] is None
    assert refresh.fitted(human_rows.where("false"), human_rows, [1.0, 2.0, 3.0, 4.0], 3, 0.1) == [1.0, 2.0, 3.0, 4.0]


def test_classifier(spark):
    assert [scoring.made_label(x) for x in (["Real", "Fake"], ["LABEL_0", "LABEL_1"], ["human", "machine", "x"], ["a", "b"], ["AI", "z"])] == [1, 1, 1, 1, 0]
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1000.0, 0.0, 1000.0],), (None,), ([1.0, None, 2.0],), ([],)], "z array<double>")
    got = [r[0] for r in rows.select(scoring.softmax(F.col("z"))).collect()]
    assert got[0] == pytest.approx([np.exp(k - 3) / sum(np.exp(np.arange(3) - 2.0)) for k in (1, 2, 3)]) and got[1] == pytest.approx([0.5, 0.0, 0.5])
    assert got[2] is None and got[3] is None
    texts = spark.createDataFrame([(" a  b\nc d ",), ("",), ("a",), (None,), ("x " * 2000,)], "t string")
    assert [r[0] for r in texts.select(tx.first_words("t", 3)).collect()] == [" a  b\nc", "", "a", None, "x x x"]


def test_benchmark_of_strategies(spark):
    def fails(df):
        return df.withColumn("output", F.when(F.length("text") > 5, F.col("text")))

    rows = spark.createDataFrame([("It is late.",), ("Short",), (None,)], "text string")
    got = {r.strategy: r for r in jobs.benchmark(rows, {"raw": lambda df: df.withColumn("output", F.col("text")), "fails": fails}).collect()}
    assert (got["raw"].n, got["raw"].failed, got["fails"].failed) == (3, 1, 2) and got["raw"].mean_similarity == 1.0 > got["fails"].mean_similarity
    assert all(r.seconds > 0 for r in got.values())
    none = jobs.benchmark(rows.where("false"), {"raw": fails}).first()
    assert (none.strategy, none.n, none.mean_p_ai) == ("raw", 0, 0.0)


def test_benchmark_holds_one_strategy_at_a_time(spark):
    """The outputs of a strategy are gone before the next one runs, beside the rows themselves, and nothing is left; a strategy may make rows of its own."""
    rows = spark.createDataFrame([("It is late.",), ("",)], "text string")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = lambda: {f for f in os.listdir(shared) if f.startswith("settled-")}
    before, seen = held(), []

    def looks(df):
        seen.append(held() - before)
        return df.withColumn("output", F.upper("text"))

    same = lambda df: df.withColumn("output", F.col("text"))
    got = jobs.benchmark(rows, {"a": looks, "b": looks, "c": same, "d": lambda df: same(df).select("text", "output")}).collect()
    assert seen[0] == seen[1] and len(seen[0]) == 1 and held() == before and [(r.strategy, r.n) for r in got] == [(s, 2) for s in "abcd"]
    assert got[2][1:-1] == got[3][1:-1] and got[2].mean_p_ai > 0


def test_settled_leaves_no_shuffle_files(spark):
    """What a write was shuffled for goes with it, and the setting is as before."""
    jvm, key = spark.sparkContext._jvm, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    dirs, was = list(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()), spark.conf.get(key)
    held = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = held()
    out = readers.settled(spark.range(1000).repartition(3))
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before and out.count() == 1000 and spark.conf.get(key) == was
