"""Rounds made on demand, sinks that hold each row once, polling, and timers."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from proselab.operators import frontier, jobs, logs
from proselab.sources import readers
from proselab.streaming import guards, sinks

# by document and round: similarity, overlap and score of each candidate, in order
CAND = {
    1: [[(0.9, 1, 0.5), (0.8, 1, 0.1)], [(0.9, 1, 0.0)]],
    2: [[(0.9, 1, 0.6)], [], [(0.7, 1, 0.0), (0.9, 1, 0.15)]],
    3: [[(0.9, 1, 1.0)], [(0.5, 1, 0.1)], [], [(0.9, 1, 1.0)]],
    4: [[(0.9, 1, 0.4), (0.9, 0.2, 0.0), (0.9, 1, 0.4)], [(0.9, 1, 0.3)], [(0.9, 1, 0.35)], [(0.8, 1, 0.31)]],
    5: [],
    6: [[(0.9, 1, 0.25), (0.9, 1, 0.24), (0.9, 1, 0.0)], [(0.9, 1, 0.01), (0.9, 1, 0.0)]],
}
GIVEN = [(d, r, k, *map(float, x)) for d, by_round in CAND.items() for r, group in enumerate(by_round) for k, x in enumerate(group)]


def plain(doc, threshold, early, rounds, concurrent):
    best, attempts, calls = None, 0, 0
    for r, group in enumerate(CAND[doc][:rounds] + [[]] * (rounds - len(CAND[doc]))):
        attempts += len(group)
        choice = None
        for k, (sim, overlap, p) in enumerate(group):
            if sim < 0.78 or overlap < 0.5:
                continue
            calls += 1
            if choice is None or p < choice[0]:
                choice = (p, r, k)
            if p < early and not concurrent:
                choice = (p, r, k)
                break
        if choice and choice[0] < threshold:
            return True, r + 1, attempts, calls, choice
        if choice and choice[0] < 1.0 and (best is None or choice[0] < best[0]):
            best = choice
    return False, rounds, attempts, calls + (best is None), best


@pytest.mark.parametrize("how", [(0.2, 0.05, False, False), (0.2, 0.3, False, True), (0.05, 0.26, False, True), (0.2, 0.3, True, True)])
def test_rejection_on_demand(spark, tmp_path, how):
    threshold, early, concurrent, with_judge = how
    given = spark.createDataFrame([(*g, f"{g[0]}:{g[1]}:{g[2]}:{g[5]}") for g in GIVEN], "doc_id long, r int, cand_idx int, sim double, overlap double, p_ai double, output string")
    docs = spark.createDataFrame([(d, "x") for d in CAND], "doc_id long, output string")
    asked, log = [], tmp_path / "calls"
    log.mkdir()

    def propose(rows, r):
        asked.append({x.doc_id for x in rows.select("doc_id").collect()})
        found = given.where(F.col("r") == r).drop("r").join(rows.select("doc_id"), "doc_id", "left_semi")
        return found.drop("p_ai") if with_judge else found

    def judge(text):
        (log / f"{text.replace(':', '_')}-{time.monotonic_ns()}").touch()
        return float(text.split(":")[3])

    made = frontier.rounds_of(docs, propose, f"file://{tmp_path}/rounds", threshold, early, facts=0.5, concurrent=concurrent, judge=judge if with_judge else None)
    got = {r.doc_id: (r.passed, r.rounds_used, r.attempts, r.judge_calls, None if r.p_ai is None else (r.p_ai, r["round"], r.cand_idx)) for r in frontier.outcome(docs, made).collect()}
    want = {d: plain(d, threshold, early, 4, concurrent) for d in CAND}
    assert got == want
    # a document that passed in a round is in no later one
    for r, docs_of in enumerate(asked):
        assert docs_of == {d for d, w in want.items() if not w[0] or w[1] > r}
    if with_judge:
        assert len(list(log.iterdir())) == sum(w[3] - (w[4] is None) for w in want.values())
    cost = {x["round"]: (x.open, x.attempts) for x in frontier.costs(made).collect()}
    assert cost == {r: (len(a), sum(len(CAND[d][r]) for d in a if r < len(CAND[d]))) for r, a in enumerate(asked)}


def test_rounds_go_on_where_they_ended(spark, tmp_path):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    asked, broken = [], [True]

    def propose(rows, r):
        if r == 2 and broken[0]:
            raise OSError("the provider is gone")
        asked.append(r)
        return rows.select("doc_id", F.lit(0).alias("cand_idx"), F.lit("t").alias("output"), F.lit(0.9).alias("sim"), F.lit(1.0).alias("overlap"), F.when(F.col("doc_id") + r >= 4, 0.0).otherwise(0.5).alias("p_ai"))

    where = f"file://{tmp_path}/rounds"
    with pytest.raises(OSError):
        frontier.rounds_of(docs, propose, where)
    broken[0] = False
    made = frontier.rounds_of(docs, propose, where)
    assert asked == [0, 1, 2, 3] and frontier.outcome(docs, made).where("passed").count() == 2
    assert frontier.rounds_of(docs, propose, where).count() == made.count() and asked == [0, 1, 2, 3]
    assert frontier.outcome(docs.where("false"), frontier.rounds_of(docs.where("false"), propose, where + "-none")).count() == 0


def test_candidates_of_a_request_are_made_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(text, k):
        (calls / f"{time.monotonic_ns()}-{k}").touch()
        return f"{text} {k}"

    requests = spark.createDataFrame([(i, "text", 2, 2, 0.2) for i in range(5)], "doc_id long, text string, candidates int, max_rounds int, threshold double")
    answers = readers.provided(requests.select("doc_id", "text"), call, n=2).select("doc_id", F.lit(0).alias("round"), "cand_idx", F.lit(0.9).alias("sim"), F.lit(1.0).alias("overlap"), F.lit(0.1).alias("p_ai"))
    assert jobs.responses(requests, answers).where("passed").count() == 5
    assert len(list(calls.iterdir())) == 10


@pytest.fixture
def files(tmp_path):
    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f".{name}").write_text("".join(f'{{"k":{k},"v":"{v}"}}\n' for k, v in rows))
        (tmp_path / f".{name}").rename(tmp_path / "in" / f"{name}.json")

    return put


def stream_of(spark, tmp_path):
    return spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")


def test_each_row_once_after_a_crash(spark, tmp_path, files):
    for n in range(3):
        files(f"f{n}", [(10 * n + i, "é") for i in range(4)])
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/c"
    write, crash = sinks.batch_writer(out), [True]

    def once(batch, number):
        write(batch, number)
        if number == 1 and crash[0]:
            crash[0] = False
            raise OSError("killed between the write and its commit")

    def run():
        q = stream_of(spark, tmp_path).writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="killed between"):
        run()
    files("f3", [(30, "b")])
    run()
    got = sorted(r.k for r in sinks.written(spark, out, "k long, v string").collect())
    assert got == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23, 30]
    line = spark.read.text(out).where("value LIKE '%b%'").first()["value"]
    assert line == '{"k":30,"v":"b"}'
    assert sinks.written(spark, f"{out}-none", "k long").count() == 0


def test_half_a_batch_is_written_anew(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    (tmp_path / "out" / "batch=0").mkdir(parents=True)
    (tmp_path / "out" / "batch=0" / "part-0.txt").write_text('{"k":1}\n')  # left without a success mark
    rows = spark.createDataFrame([(1,), (2,)], "k long")
    for _ in range(2):
        sinks.batch_writer(out)(rows, 0)
        assert sorted(r.k for r in sinks.written(spark, out, "k long").collect()) == [1, 2]


def test_refused_rows_go_to_the_dead_letters(spark, tmp_path, files):
    files("a", [(1, "ok"), (2, "bad"), (3, "ok")])

    def send(line):
        if "bad" in line:
            raise ValueError("refused")

    out, dead = f"file://{tmp_path}/out", f"file://{tmp_path}/dead"
    sinks.write_stream(stream_of(spark, tmp_path), out, f"file://{tmp_path}/c", dead, send).awaitTermination()
    assert sorted(r.k for r in sinks.written(spark, out, "k long, v string").collect()) == [1, 3]
    assert [r.error for r in spark.read.json(dead).collect()] == ["ValueError: refused"]
    with pytest.raises(RuntimeError, match="refused"):
        sinks.batch_writer(f"{out}2", send=send)(spark.createDataFrame([(2, "bad")], "k long, v string"), 0)
    # a folder that cannot be written: the batch is among the dead letters, and nothing is raised
    (tmp_path / "file").write_text("")
    sinks.batch_writer(f"file://{tmp_path}/file/below", f"{dead}2")(spark.createDataFrame([(7, "x")], "k long, v string"), 0)
    assert spark.read.json(f"{dead}2").count() == 1


def test_polling_ends_with_the_artefact(spark, tmp_path, files):
    files("f0", [(0, "a")])
    out, made = f"file://{tmp_path}/out", []

    def later():
        time.sleep(2)
        files("f1", [(1, "b")])
        time.sleep(1)
        files("f2", [(2, "c")])
        (tmp_path / "done").write_text("")

    def start():
        made.append(1)
        return sinks.write_stream(stream_of(spark, tmp_path), out, f"file://{tmp_path}/c")

    thread = threading.Thread(target=later)
    thread.start()
    assert sinks.until_artefact(start, spark, f"file://{tmp_path}/done", 0.2, 120)
    thread.join()
    assert sorted(r.k for r in sinks.written(spark, out, "k long, v string").collect()) == [0, 1, 2] and len(made) >= 2
    assert not sinks.until_artefact(start, spark, f"file://{tmp_path}/never", 0.1, 0.5)


STEPS = [("stalls", m) for m in (0, 5, 9, 12)] + [("graced", 1)] + [("long", m) for m in range(0, 300, 7)] + [("lives", m) for m in range(200, 300, 5)] + [("clock", m) for m in range(0, 300, 3)]
BASE = 1_000_000  # no step is older than the watermark that a stream begins with


def test_runs_end_by_a_timer(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = sorted(STEPS, key=lambda s: s[1])
        cuts = [rows[i : i + 25] for i in range(0, len(rows), 25)]
        for n, part in enumerate(cuts):
            spark.createDataFrame(part, "run string, m int").select("run", F.timestamp_seconds((F.col("m") + BASE) * 60).alias("ts")).coalesce(1).write.parquet(f"file://{tmp_path}/s{n}")
        (tmp_path / "in").mkdir()
        for n in range(len(cuts)):
            next((tmp_path / f"s{n}").glob("part-*.parquet")).rename(tmp_path / "in" / f"{n:03d}.parquet")
            time.sleep(0.02)
        stream = spark.readStream.schema("run string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        q = guards.guarded(stream, "run", "ts", 20, 15, 4).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r.run, r.steps, r.ended, r.at / 60 - BASE) for r in spark.table("ended").collect()}
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    ends = {run: (ended, at, steps) for run, steps, ended, at in got}
    assert {r: e[:2] for r, e in ends.items()} == {"stalls": ("stall", 35.0), "graced": ("stall", 36.0), "long": ("cap", 240.0), "clock": ("cap", 240.0)}
    log = spark.createDataFrame(STEPS, "run string, m int").withColumn("ts", F.timestamp_seconds((F.col("m") + BASE) * 60))
    for run, (why, at, steps) in ends.items():
        # the batch form says the same at that moment, and nothing a minute before it
        for now, said in ((at, why), (at - 1, None)):
            own = logs.guarded(log.where((F.col("run") == run) & (F.col("m") <= now)), "run", "ts", 20, 15, 4, F.timestamp_seconds(F.lit(int((now + BASE) * 60)))).first()
            assert own.ended == said
        if run in ("stalls", "graced"):
            assert steps == own.steps
