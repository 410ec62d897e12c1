"""Selection, facts, logs, sources and streams on small rows."""

import json
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.functions import text as tx
from proselab.operators import fingerprint as fp
from proselab.operators import corpus, facts, jobs, logs, registry, rewrite, scoring, selection, spans
from proselab.sources import readers


def imperative(rows, threshold, early, floor, need, rounds):
    """The rejection loop for one document, as a program."""
    best, attempts, calls = (1.0, None), 0, 0
    for r in range(rounds):
        group = sorted((x for x in rows if x[0] == r), key=lambda x: x[1])
        attempts += len(group)
        kept = [x for x in group if x[2] >= floor and (need <= 0 or x[3] >= need)]
        choice = None
        for x in kept:
            calls += 1
            if choice is None or x[4] < choice[4]:
                choice = x
            if x[4] < early:
                choice = x
                break
        if choice is None:
            continue
        if choice[4] < best[0]:
            best = (choice[4], choice)
        if choice[4] < threshold:
            return True, r + 1, attempts, calls, choice[0], choice[1]
    if best[1] is None:
        return False, rounds, attempts, calls + 1, None, None
    return False, rounds, attempts, calls, best[1][0], best[1][1]


@pytest.mark.parametrize(("threshold", "early", "need"), [(0.2, 0.05, 0.0), (0.1, 0.3, 0.5), (0.05, 0.0, 0.0)])
def test_rejection(spark, threshold, early, need):
    rows = []
    for d in range(60):
        for r in range(4):
            for c in range(0 if (d + r) % 7 == 0 else 4):
                k = d * 31 + r * 17 + c * 23
                rows.append((d, r, c, 0.6 + k * 7 % 40 / 100, k * 3 % 11 / 10, 1.0 if d % 11 == 0 else k % 101 / 100))
    cand = spark.createDataFrame(rows, "doc_id long, round int, cand_idx int, sim double, overlap double, p_ai double")
    docs = spark.range(61).withColumnRenamed("id", "doc_id")
    by = defaultdict(list)
    for d, *x in rows:
        by[d].append(tuple(x))
    for r in selection.rejection(cand, docs, threshold, early, facts=need).collect():
        assert (r.passed, r.rounds_used, r.attempts, r.judge_calls, r["round"], r.cand_idx) == imperative(by[r.doc_id], threshold, early, 0.78, need, 4), r


def test_fact_overlap(spark):
    rows = [("She paid $5,000 in 2019.", "She paid 5000 dollars in 2019.", 1.0), ("no facts here", "none", 1.0), ("He ran 12 laps and 40 more.", "He ran 12 laps.", 0.5), ("It cost 15% of 99.", "nothing", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    both = facts.extract(facts.extract(df, "a", "fa"), "b", "fb")
    for r in both.select("want", "fa", facts.overlap("fa", "fb", F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(r.want), r


def test_priority_of_kinds(spark):
    df = spark.createDataFrame([("On January 5, 2024 OpenAI paid USD 1,200.50, or 12% of 300.",)], "text string")
    f = facts.extract(df).first().facts
    assert f.date == ["january 5 2024"] and f.currency == ["usd 1200.50"] and f.pct == ["12%"] and f.number == ["300"] and f.year == [] and "OpenAI" in f.proper_noun


def test_rate_limiter(spark):
    seen, got = deque(), []
    for t in (0.0, 0.1, 0.2, 0.3, 1.05, 1.15):
        got.append(logs.allow(seen, t, 3, 1.0))
    assert [g[0] for g in got] == [200, 200, 200, 429, 200, 200]
    assert got[0][1] == 2 and got[3][2] == 1


@pytest.mark.parametrize("run", [7, 30, 50_000])
def test_windows_over_runs(spark, run):
    """Windows dealt by runs of a key's rows give what one window a key gives; ties in time and null keys among them."""
    import random

    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.randrange(0, 9) * 1800 + rnd.randrange(3), rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k string, t int, v double").withColumn("ts", F.timestamp_seconds("t"))
    by = defaultdict(list)
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        by[k].append((i, t, v))
    means, waits = {}, {}
    for held in by.values():
        for n, (i, t, _) in enumerate(held):
            last = [v for *_, v in held[max(0, n - 4) : n + 1]]
            means[i], waits[i] = (len(last), sum(last) / len(last)), t - held[n - 1][1] if n else None
    got = logs.trailing_mean(df, "v", "k", "ts", ["ts", "i"], 5, run).collect()
    assert len(got) == 400 and all((r.n, pytest.approx(r["mean"])) == means[r.i] for r in got)
    got = logs.gaps(df, "k", "ts", ["ts", "i"], 100, run).collect()
    assert {r.i: r.gap_s for r in got} == waits and all(r.stalled == ((waits[r.i] or 0) > 100) for r in got)


def test_rates(spark):
    df = spark.createDataFrame([("3/second",), ("10 / minute",)], "s string")
    assert [tuple(r.r) for r in df.select(tx.rate("s").alias("r")).collect()] == [(3, 1), (10, 60)]
    with pytest.raises(Exception, match="not a rate"):
        spark.createDataFrame([("3/fortnight",)], "s string").select(tx.rate("s")["seconds"].alias("x")).collect()


def test_chunks():
    text = " ".join(f"Sentence number {i} has six words." for i in range(30))
    found = corpus.chunks(text, 20, 30)
    assert " ".join(found).split() == text.split() and all(20 <= len(c.split()) <= 30 for c in found)
    assert corpus.chunks("Too short.", 20, 30) == []


def test_ensemble_weights(spark):
    rows = [(1, "a", 1.0, 0.0), (1, "b", 3.0, 1.0), (2, "a", 0.0, 0.3)]
    e = scoring.ensemble(spark.createDataFrame(rows, "doc_id int, detector string, weight double, p_ai double"), "doc_id")
    assert {r.doc_id: r["aggregate"] for r in e.collect()} == {1: 0.75, 2: 1.0}


def test_sources(spark, tmp_path):
    good = {"ai": "x", "human": "y", "source": "s", "prompt_idx": 1, "human_idx": 2}
    (tmp_path / "p.jsonl").write_text(json.dumps(good) + "\n\nnot json\n")
    assert readers.pairs(spark, str(tmp_path / "p.jsonl")).count() == 1
    with pytest.raises(Exception):  # noqa: B017, PT011
        readers.pairs(spark, str(tmp_path / "p.jsonl"), strict=True).collect()
    part = {"outputs": ["a", "b"], "p_ai_ensemble": [0.1, 0.2], "similarity": [0.9, 0.8], "pattern": [0.3, 0.4]}
    (tmp_path / "e.json").write_text(json.dumps({"base": part, "trained": part}, indent=1))
    assert readers.eval_json(spark, str(tmp_path / "e.json")).count() == 4
    assert readers.variant_scores(spark, [str(tmp_path / "none.json")]).count() == 0


def test_provider(spark):
    def call(text, k):
        if text == "bad":
            raise ValueError
        return f"{text}{k}" if text == "ok" else [text + "!", text + "?"][: 2 - k]

    df = spark.createDataFrame([("ok",), ("bad",), ("list",)], "text string")
    out = readers.provided(df, call, n=3, failed=readers.lx.FAILED)
    rows = {(r.text, r.cand_idx): r.output for r in out.collect()}
    assert [rows["ok", k] for k in range(3)] == ["ok0", "ok1", "ok2"]
    assert [rows["list", k] for k in range(3)] == ["list!", "list?", "__ERROR__"]
    assert {rows["bad", k] for k in range(3)} == {"__ERROR__"}
    assert {(r.text, r.cand_idx) for r in readers.succeeded(out).collect()} == {("ok", 0), ("ok", 1), ("ok", 2), ("list", 0), ("list", 1)}


def test_provider_of_scores(spark):
    """Numbers, a neutral score for failures, and one set-up a task."""

    def call(text, k, lengths):
        lengths.append(len(text))
        return 1.0 / lengths[-1]

    df = spark.createDataFrame([("abcd",), ("",), ("ab",)], "text string").coalesce(1)
    rows = {r.text: r.p for r in readers.provided(df, call, out="p", kind="double", failed=0.5, prepare=list).collect()}
    assert rows == {"abcd": 0.25, "": 0.5, "ab": 0.5}


def test_refine(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.3)], "doc_id int, p double")
    out = selection.refine(df, lambda d: d.withColumn("p", F.col("p") - 0.25), F.col("p") <= 0.2, 3)
    assert {r.doc_id: round(r.p, 2) for r in out.collect()} == {1: 0.15, 2: 0.05}


def test_refine_calls_once_a_row_and_pass(spark):
    calls = spark.sparkContext.accumulator(0)

    def step(d):
        def call(text, k):
            calls.add(1)
            return text + "x"

        return readers.provided(d.drop("cand_idx", "next"), call, out="next").withColumn("text", F.col("next"))

    df = spark.createDataFrame([(1, "a", 0, ""), (2, "ab", 0, "")], "doc_id int, text string, cand_idx int, next string")
    out = selection.refine(df, step, F.length("text") >= 3, 3)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "axx", 2: "abx"} and out.count() == 2
    assert calls.value == 3


def test_stream_equals_batch(spark, tmp_path):
    from proselab.streaming import jobs

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.rate_limited(jobs.read(spark, str(tmp_path / "in"), events.schema), 3, 3600.0)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    names = ["key", "ident", "status", "remaining", "retry_after"]
    batch = logs.rate_limited(events, "user_id", "ts", "event_id", 3, 3600.0)
    assert sorted(map(tuple, spark.table("limited").select(names).collect())) == sorted(map(tuple, batch.select(names).collect()))


def test_judges_of_a_configuration():
    judges = [registry.Judge(n, f"{n.upper()}_KEY", 1.0) for n in ("first", "second", "third")]
    keys = {"SECOND_KEY": "k", "THIRD_KEY": "", "FIRST_KEY": "x"}
    assert registry.judge(judges, keys)[0] == "ensemble(first+second)"
    assert registry.judge(judges, keys, prefer=["second", "third"])[0] == "second"
    assert registry.judge(judges, {}) == ("local", [])
    assert [j.name for j in registry.configured(judges, keys)] == ["first", "second"]
    with pytest.raises(LookupError):
        registry.judge(judges, {}, local=False)
    assert registry.ensemble(lite=True) == registry.ensemble()[:1]


def test_ratios_without_a_divisor(spark):
    v = lambda *x: [list(map(float, x))]
    rows = spark.createDataFrame([(*v(0, 0), *v(1, 2)), (*v(1, 2), *v(2, 4)), (*v(1, 0), *v(0, 1)), (*v(0, 0), *v(1)), (*v(1, 2), *v(1)), (None, *v(1)), ([], [])], "a array<double>, b array<double>")
    found = [r[0] for r in rows.select(scoring.cosine(F.col("a"), F.col("b"))).collect()]
    assert found[0] == 0.0 and found[1] == pytest.approx(1.0) and found[2] == 0.0 and found[3:6] == [None, None, None] and found[6] == 0.0
    pairs = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (None, 1.0)], "x double, y double")
    assert [r[0] is None for r in pairs.select(scoring.ratio_score(F.col("x"), F.col("y"))).collect()] == [True, False, True]
    assert [r[0] for r in pairs.select(scoring.reduction(F.col("y"), F.col("x"))).collect()] == [None, 1.0, None]


def test_pace_of_a_single_step(spark):
    rows = spark.createDataFrame([("one", 0), ("two", 0), ("two", 60)], "run string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.run: (r.steps, r.step_s, r.eta, r.cost) for r in logs.pace(rows, "run", "ts").withColumns({"eta": logs.remaining(F.lit(10)), "cost": logs.rental(F.col("lasted_s"), 0.6)}).collect()}
    assert got == {"one": (1, None, None, 0.0), "two": (2, 60.0, 600.0, pytest.approx(0.01))}
    assert logs.pace(rows.where("false"), "run", "ts").count() == 0


def test_no_member_of_an_ensemble(spark):
    scores = spark.createDataFrame([(1, "a", 0.5)], "doc_id int, detector string, p_ai double")
    with pytest.raises(LookupError, match="no detector"):
        registry.available(scores, spark.createDataFrame([("a", False)], "detector string, loaded boolean"))
    assert registry.available(scores, spark.createDataFrame([("a", True), ("b", False)], "detector string, loaded boolean")).count() == 1


def test_budget_guard(spark):
    df = spark.createDataFrame([(100,), (10_000_000,)], "n long").withColumn("p", jobs.token_plan(F.col("n"), 2, 1.0))
    assert [r.allowed for r in df.orderBy("n").select("p.allowed").collect()] == [True, False]
    assert df.where("n = 100").select(jobs.within_budget(F.col("p")).alias("c")).first().c == 200
    with pytest.raises(Exception, match="over the limit"):
        df.select(jobs.within_budget(F.col("p"))).collect()


def test_pair_job_goes_on_where_it_ended(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    path, seen = str(tmp_path / "pairs"), spark.sparkContext.accumulator(0)

    def answered(fails):
        def call(text, k):
            seen.add(1)
            return "__ERROR__ late" if text in fails else text.upper()

        return lambda grid: readers.provided(grid.withColumn("source", F.lit("s")), call, text="human", out="ai").drop("cand_idx")

    jobs.generate_pairs(docs, 2, answered({"text 1", "text 4"}), path)
    assert spark.read.json(path).count() == 8 and seen.value == 12
    jobs.generate_pairs(docs, 2, answered({"text 4"}), path)
    assert spark.read.json(path).count() == 10 and seen.value == 16
    assert {(r.human_idx, r.prompt_idx) for r in spark.read.json(path).collect()} == {(i, k) for i in (0, 1, 2, 3, 5) for k in (0, 1)}


def test_report_and_names(spark, tmp_path):
    assert readers.artefact("a/run.1.json", "holdout") == "a/run.1.holdout.json" and readers.artefact("x", "scrub-eval") == "x.scrub-eval.json"
    readers.write_report(spark.createDataFrame([(1, 0.5)], "n int, p double"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 1, "p": 0.5}
    readers.write_jsonl(spark.createDataFrame([("b", 1), (None, 2), ("a", 3)], "source string, tmp int"), str(tmp_path / "s"), drop=("tmp",))
    assert readers.jsonl_sources(spark, str(tmp_path / "s")).count() == 2
    assert readers.jsonl_sources(spark, str(tmp_path / "s"), 1).collect() == readers.jsonl_sources(spark, str(tmp_path / "s"), 1).collect()
    assert "tmp" not in spark.read.json(str(tmp_path / "s")).columns


def test_worker_messages(spark):
    lines = ['{"type":"detect","id":1}', '{"type":"dance","id":2}', "{bad", '{"id":3}']
    got = [(r.id, r.ok, r.error) for r in readers.routed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [(1, True, None), (2, False, "unknown type"), (None, False, "bad json"), (3, False, "unknown type")]


def test_stems_natively(spark):
    import re

    texts = ["the planning planner planned a plan", "Running runners run RUNNING on", "walk walked walking talk", "no stem here", "état étatique était"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [re.sub(r"\b((\w{4,})\w*)\s+\2\w*\b", r"\1", t, flags=re.I) for t in texts]
    assert [r.t for r in df.select(rewrite.stems_native(F.col("t")).alias("t")).collect()] == want


def test_fold_counts_edits(spark):
    df = spark.createDataFrame([("it is so and It is not",)], "t string")
    r = df.select(rewrite.native_fold(F.col("t"), [(r"\bit is\b", "it's"), ("so", "thus $1")]).alias("r")).first().r
    assert (r.text, r.edits) == ("it's thus $1 and it's not", 3)


def test_labelled_and_capitals(spark):
    df = spark.createDataFrame([(1, 1, "abc"), (2, None, "été"), (3, 0, "")], "i int, l int, t string")
    assert [r.i for r in readers.labelled(df, "l", 0).orderBy("i").collect()] == [2, 3]
    assert [r.t for r in df.orderBy("i").select(tx.capitalised("t").alias("t")).collect()] == ["Abc", "Été", ""]


def test_summary_of_no_rows(spark):
    s = jobs.summary(jobs.evaluated(spark.createDataFrame([], "doc_id long, text string"), lambda t: t)).withColumn("s", jobs.summary_text()).first()
    assert s.n == 0 and s.mean_p_ai == 0 and s.s.startswith("n=0\nmean_p_ai=0.000\nasr_ensemble=0.00%")


def test_event_time_streams(spark, tmp_path):
    """Windows, sessions and the bounded buffer over a folder of files equal their batch counts."""
    from proselab.streaming import jobs as streams

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: streams.read(spark, str(tmp_path / "in"), events.schema)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sum(r.n for r in run(streams.windowed(source()), "w", "complete")) == events.count()
    assert sum(r.n for r in run(streams.sessions(source()), "s", "complete")) == events.count()
    last = {r.event_type: r.n for r in run(streams.last_outputs(source(), 50), "l", "update")}
    assert last == {r.event_type: min(50, r["count"]) for r in events.groupBy("event_type").count().collect()}
    q = streams.to_jsonl(source().select("event_id"), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == events.count()


def test_counts_are_those_of_unicode_patterns(spark):
    """The plain form of a text gives what patterns with Unicode's classes and cases find in the text itself, and tokens cost no fold in Spark."""
    texts = ["", "Must not; \u00e9must must\u0301 mu\u017ft SHOULD\u00a0need to it \u0131s It\u2003is I am \u0130t is we \u00adare", "don't \u00e9don't don't\u00e9 IT'S it\u2019s That's, they're\u24b6 I\u0131'm", "From \u00e0 la carte\u2003to tea \u4e16\u754c, it's not\u3000just about x. Both caf\u00e9 a\u0308b but\u00a0also z", "a b c d a b c d a b c d. \U0001d54f must\u200d have to\u203f"]
    f = fp.with_features(spark.createDataFrame([(t,) for t in texts], "text string"))
    shapes = sum((tx.matches("body", p, True) for p in lx.ENUMERATIONS), F.lit(0))
    want = {"contracted": tx.matches("body", lx.CONTRACTED, True), "expanded": tx.matches("body", lx.EXPANDED, True), "modals": tx.matches("body", lx.MODALS, True), "shapes": shapes, "tokens": F.size("tok"), "types": F.size(F.array_distinct("tok")), "hedges": tx.count_all("low", lx.HEDGES)}
    for row in f.select(*(c.alias(k) for k, c in want.items()), F.col("_counts").alias("got")).collect():
        assert {k: row[k] for k in want} == {k: row.got[k] for k in want}
    assert [r[0] for r in f.select("_counts.repeats").collect()] == [0, 0, 0, 0, 9]
    plan = f.withColumns(fp.signals())._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan and "ArrowEvalPython" in plan


def test_sentences_are_counted_beside_tokens(spark):
    """Sentences, their words and beginnings, dashes and lists come from the Arrow function as Spark's expressions find them, which the scores do without."""
    texts = [
        "", " \n", "One. Two words! \u00c9t\u00e9 (no. Yes) \"So\u2003it\u0085is.\" A\x1cb c.", "The system is. the rise  of. THE RISE OF x. The\nsystem.  The rise of.\u00a0The roles of y",
        "a, b, and c, d, or e. x, and, and y \u00e9, \u00e9 , or z; \u00e0,\u2003\u00e8, or \u00ea, and -- \u2014--- o, p, And q, r, and s", "It's a dog. It's  a cat. It's\ta cow. Its a", "'a -b x'-y it is not we are had not have had",
    ]
    f = fp.with_features(spark.createDataFrame([(t,) for t in texts], "text string"))
    total = F.aggregate("sent_words", F.lit(0), lambda a, x: a + x)
    abstract = F.size(F.filter("sents", lambda s: F.lower(s).rlike("^(?:" + "|".join(lx.ABSTRACT_SUBJECTS) + ")")))
    starts = F.transform("sents", lambda s: F.regexp_replace(F.regexp_extract(s, r"(?U)^\S+(?:\s+\S+)?", 0), r"(?U)\s+", " "))
    most = F.coalesce(F.array_max(F.transform(starts, lambda s: F.size(F.filter(starts, lambda x: x == s)))), F.lit(0))
    want = {
        "sentences": F.size("sents"), "words": total, "squares": F.aggregate("sent_words", F.lit(0), lambda a, x: a + x * x), "starts": most, "abstract": abstract,
        "dashes": tx.count_all("body", ["\u2014", "--"]), "tricolons": tx.matches("body", lx.TRICOLON), "tokens": F.size("tok"), "expanded": tx.matches("body", lx.EXPANDED, True),
    }
    for row in f.select(*(c.alias(k) for k, c in want.items()), F.col("_counts").alias("got"), fp.spread(F.col("sent_words")).alias("cv"), fp.sentence_spread().alias("cv_got")).collect():
        assert {k: row[k] for k in want} == {k: row.got[k] for k in want} and row.cv == row.cv_got
    plan = f.withColumns(fp.signals()).select(*fp.signals())._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "split" not in plan


def test_places_move_without_what_was_found(spark):
    """A text's pieces are no part of the shuffle when only their places are asked for."""
    rows = spark.createDataFrame([(1, "a b\n\nc"), (2, None)], "doc_id long, text string")
    places = spans.matched(rows, [r"[^\n]+"]).select("doc_id", "start", "stop")
    assert sorted(map(tuple, places.collect())) == [(1, 0, 3), (1, 5, 6)]
    lines = places._jdf.queryExecution().optimizedPlan().toString().splitlines()
    moved = lines[next(i for i, x in enumerate(lines) if "RepartitionByExpression" in x) + 1]
    assert "size" in moved and "AS found" not in moved
