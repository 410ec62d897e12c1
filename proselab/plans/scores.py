"""Queries over scores, candidates and evaluations, with their DuckDB SQL.

Scores and candidates stand for what scoring providers return; they are whole-number arithmetic over doc_id, so
that both engines make the same rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proselab.operators import scoring as sc
from proselab.operators import selection as sel

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def r9(c):
    return F.round(c, 9)


def mean_of_hundredths(c):
    """The mean of hundredths from a whole-number sum, one division; nine digits leave no tie to round."""
    return F.sum(F.round(c * 100).cast("long")) / (F.count(c) * 100)


def mean_sql(c):
    return f"CAST(sum(CAST(round(({c}) * 100) AS BIGINT)) AS DOUBLE) / (count({c}) * 100)"


DETECTORS = (("alpha", 1.0, 37, 101), ("beta", 2.0, 53, 97), ("gamma", 0.5, 71, 89))


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")


def scores(spark, sf_dir):
    """doc_id, source, detector, weight, p_ai."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("detector"), F.lit(w).alias("weight"), (F.pmod(F.col("doc_id") * a, F.lit(m)) / (m - 1.0)).alias("p_ai")) for n, w, a, m in DETECTORS)))
    return docs(spark, sf_dir).select("doc_id", "source", each.alias("s")).select("doc_id", "source", "s.*")


def candidates(spark, sf_dir):
    """doc_id, round, cand_idx, sim, overlap, p_ai: four rounds of four."""
    grid = docs(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("round")).select("doc_id", "round", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cand_idx"))
    k = F.col("doc_id") * 31 + F.col("round") * 17 + F.col("cand_idx") * 23
    return grid.select("doc_id", "round", "cand_idx", (F.lit(0.6) + F.pmod(k * 7, F.lit(40)) / 100.0).alias("sim"), (F.pmod(k * 3, F.lit(11)) / 10.0).alias("overlap"), (F.pmod(k, F.lit(101)) / 100.0).alias("p_ai"))


SCORES = "scores AS (SELECT doc_id, source, d.n AS detector, d.w AS weight, ((doc_id * d.a) % d.m) / (d.m - 1.0) AS p_ai FROM documents, (VALUES ('alpha', 1.0, 37, 101), ('beta', 2.0, 53, 97), ('gamma', 0.5, 71, 89)) AS d(n, w, a, m))"
SCORES = SCORES.replace("1.0, 37", "1.0::DOUBLE, 37").replace("(d.m - 1.0)", "CAST(d.m - 1 AS DOUBLE)")
CAND = """cand AS (SELECT doc_id, CAST(r AS INTEGER) AS round, CAST(c AS INTEGER) AS cand_idx, CAST(0.6 AS DOUBLE) + ((k * 7) % 40) / CAST(100 AS DOUBLE) AS sim, ((k * 3) % 11) / CAST(10 AS DOUBLE) AS overlap, (k % 101) / CAST(100 AS DOUBLE) AS p_ai
  FROM (SELECT doc_id, r, c, doc_id * 31 + r * 17 + c * 23 AS k FROM documents, range(4) AS x(r), range(4) AS y(c)))"""


@query("ensemble_mean", f"WITH {SCORES} SELECT doc_id, round(sum(weight * p_ai) / sum(weight), 6) AS aggregate, count(*) AS members FROM scores GROUP BY doc_id")
def ensemble_mean(spark, sf_dir):
    """A-01, A-04, M-03, V-02."""
    e = sc.ensemble(scores(spark, sf_dir), "doc_id")
    return e.select("doc_id", r6("aggregate").alias("aggregate"), F.size("by_name").cast("long").alias("members"))


@query("detector_success_rate", f"WITH {SCORES} SELECT detector, count(*) AS n, round(avg(CASE WHEN p_ai < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(p_ai), 6) AS mean_p FROM scores GROUP BY detector")
def detector_success_rate(spark, sf_dir):
    """A-02."""
    return scores(spark, sf_dir).groupBy("detector").agg(F.count("*").alias("n"), r6(sc.success_rate("p_ai")).alias("rate"), r6(F.avg("p_ai")).alias("mean_p"))


@query(
    "eval_summary",
    f"""WITH {SCORES}, e AS (SELECT doc_id, sum(weight * p_ai) / sum(weight) AS p FROM scores GROUP BY doc_id)
SELECT count(*) AS n, round(coalesce(avg(CASE WHEN round(p, 9) < 0.5 THEN 1.0 ELSE 0.0 END), 0), 6) AS asr_ensemble, round(coalesce(avg(p), 0), 6) AS mean_p_ai FROM e""",
)
def eval_summary(spark, sf_dir):
    """A-03, A-05, E-01."""
    e = sc.ensemble(scores(spark, sf_dir), "doc_id")
    return e.agg(F.count("*").alias("n"), r6(F.coalesce(sc.success_rate(F.round("aggregate", 9)), F.lit(0.0))).alias("asr_ensemble"), r6(F.coalesce(F.avg("aggregate"), F.lit(0.0))).alias("mean_p_ai"))


@query(
    "strategy_comparison",
    f"WITH {CAND} SELECT round, count(*) AS n, round({mean_sql('sim')}, 9) AS mean_sim, round({mean_sql('p_ai')}, 9) AS mean_p, round(avg(CASE WHEN p_ai < 0.5 THEN 1.0 ELSE 0.0 END), 9) AS rate FROM cand GROUP BY round",
)
def strategy_comparison(spark, sf_dir):
    """A-06, E-02."""
    return candidates(spark, sf_dir).groupBy("round").agg(F.count("*").alias("n"), r9(mean_of_hundredths(F.col("sim"))).alias("mean_sim"), r9(mean_of_hundredths(F.col("p_ai"))).alias("mean_p"), r9(sc.success_rate("p_ai")).alias("rate"))


@query(
    "run_reduction",
    f"WITH {CAND}, r AS (SELECT round, {mean_sql('CASE WHEN cand_idx = 0 THEN p_ai END')} AS before, {mean_sql('CASE WHEN cand_idx > 0 THEN p_ai END')} AS after FROM cand GROUP BY round) SELECT round, round(before, 9) AS before, round(after, 9) AS after, round((before - after) / nullif(before, 0), 9) AS reduction, round(after - min(after) OVER (), 9) AS over_best FROM r",
)
def run_reduction(spark, sf_dir):
    """A-07, A-15, J-11, E-03: means before and after by run, relative reduction, distance from the best run."""
    r = candidates(spark, sf_dir).groupBy("round").agg(mean_of_hundredths(F.when(F.col("cand_idx") == 0, F.col("p_ai"))).alias("before"), mean_of_hundredths(F.when(F.col("cand_idx") > 0, F.col("p_ai"))).alias("after"))
    best = Window.partitionBy(F.lit(0))
    return r.select("round", r9("before").alias("before"), r9("after").alias("after"), r9(sc.reduction(F.col("before"), F.col("after"))).alias("reduction"), r9(F.col("after") - F.min("after").over(best)).alias("over_best"))


@query(
    "best_of_n_projection",
    f"WITH {SCORES}, r AS (SELECT detector, avg(CASE WHEN p_ai < 0.1 THEN 1.0 ELSE 0.0 END) AS rate FROM scores GROUP BY detector) SELECT detector, CAST(n AS INTEGER) AS n, round(1 - pow(1 - rate, n), 6) AS reliability FROM r, (VALUES (8), (16), (32)) AS k(n)",
)
def best_of_n_projection(spark, sf_dir):
    """A-11, A-12, M-07."""
    r = scores(spark, sf_dir).groupBy("detector").agg(sc.success_rate("p_ai", 0.1).alias("rate"))
    r = r.withColumn("n", F.explode(F.array(*map(F.lit, (8, 16, 32)))))
    return r.select("detector", "n", r6(sc.best_of_n(F.col("rate"), F.col("n"))).alias("reliability"))


@query(
    "easy_hard_detector",
    f"WITH {SCORES}, r AS (SELECT source, detector, avg(CASE WHEN p_ai < 0.5 THEN 1.0 ELSE 0.0 END) AS rate FROM scores GROUP BY ALL) SELECT source, arg_max(detector, (round(rate, 9), detector)) AS easiest, arg_min(detector, (round(rate, 9), detector)) AS hardest, round(min(rate), 6) AS worst, round(1 - pow(1 - min(rate), 8), 6) AS worst_of_8 FROM r GROUP BY source",
)
def easy_hard_detector(spark, sf_dir):
    """A-13, A-14."""
    r = scores(spark, sf_dir).groupBy("source", "detector").agg(sc.success_rate("p_ai").alias("rate")).withColumn("key", F.struct(F.round("rate", 9).alias("r"), "detector"))
    return r.groupBy("source").agg(F.max("key").alias("hi"), F.min("key").alias("lo"), F.min("rate").alias("m")).select("source", F.col("hi.detector").alias("easiest"), F.col("lo.detector").alias("hardest"), r6("m").alias("worst"), r6(sc.best_of_n(F.col("m"), F.lit(8))).alias("worst_of_8"))


@query(
    "variant_delta",
    f"WITH {SCORES}, v AS (SELECT detector, CASE doc_id % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'base_scrub' WHEN 2 THEN 'trained' ELSE 'trained_scrub' END AS variant, p_ai FROM scores) SELECT detector, round(avg(p_ai) FILTER (WHERE variant = 'base'), 6) AS base, round(avg(p_ai) FILTER (WHERE variant = 'base_scrub') - avg(p_ai) FILTER (WHERE variant = 'base'), 6) AS base_delta, round(avg(p_ai) FILTER (WHERE variant = 'trained_scrub') - avg(p_ai) FILTER (WHERE variant = 'trained'), 6) AS trained_delta FROM v GROUP BY detector",
)
def variant_delta(spark, sf_dir):
    """A-10, A-15, A-16, J-10, M-12: the four variants side by side."""
    names = ("base", "base_scrub", "trained", "trained_scrub")
    v = scores(spark, sf_dir).withColumn("variant", F.element_at(F.array(*map(F.lit, names)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")))
    p = v.groupBy("detector").pivot("variant", names).agg(F.avg("p_ai"))
    return p.select("detector", r6("base").alias("base"), r6(F.col("base_scrub") - F.col("base")).alias("base_delta"), r6(F.col("trained_scrub") - F.col("trained")).alias("trained_delta"))


@query(
    "reward_composite",
    f"WITH {CAND} SELECT doc_id, round, cand_idx, round(CASE WHEN sim < 0.65 THEN -1.0 ELSE 1.5 * (1 - p_ai) + 0.3 * sim + 0.3 * (1 - overlap) + 0.5 / (1 + least(10000 * p_ai, 10000) / 50) + CASE WHEN overlap * 2 < 0.55 THEN -0.5 * (0.55 - overlap * 2) / 0.55 WHEN overlap * 2 > 1.65 THEN -0.3 * (overlap * 2 - 1.65) / 1.65 ELSE 0 END END, 6) AS reward FROM cand",
)
def reward_composite(spark, sf_dir):
    """D-14 to D-17, P-07."""
    c = candidates(spark, sf_dir)
    reward = sc.reward(F.col("p_ai"), F.col("sim"), F.col("overlap"), sc.length_penalty(F.col("overlap") * 2), F.col("p_ai") * 10000)
    return c.select("doc_id", "round", "cand_idx", r6(reward).alias("reward"))


@query(
    "pairwise_select",
    f"WITH {CAND}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, round ORDER BY CASE WHEN sim >= 0.7 THEN 0 ELSE 1 END, round(-(0.6 * (1 - p_ai) + 0.3 * (1 - overlap) + 0.1 * sim), 9), cand_idx) AS place FROM cand) SELECT doc_id, round, cand_idx FROM s WHERE place = 1",
)
def pairwise_select(spark, sf_dir):
    """D-18, L-02, Q-06, P-05."""
    score = F.round(-sc.pairwise(F.col("p_ai"), F.col("overlap"), F.col("sim")), 9)
    return sel.best_of_n(candidates(spark, sf_dir), 0.70, ("doc_id", "round"), score).select("doc_id", "round", "cand_idx")


@query(
    "best_of_n_select",
    f"WITH {CAND}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, round ORDER BY CASE WHEN sim >= 0.78 THEN 0 ELSE 1 END, p_ai, cand_idx) AS place FROM cand) SELECT doc_id, round, cand_idx, round(p_ai, 6) AS p_ai FROM s WHERE place = 1",
)
def best_of_n_select(spark, sf_dir):
    """Q-03, Q-12, Q-13, L-01, P-04, P-05."""
    return sel.best_of_n(candidates(spark, sf_dir), by=("doc_id", "round")).select("doc_id", "round", "cand_idx", r6("p_ai").alias("p_ai"))


def _rejection_sql(threshold, early, facts, concurrent):
    hit = "CAST(NULL AS INTEGER)" if concurrent else f"min(CASE WHEN p_ai < {early} THEN cand_idx END) OVER (PARTITION BY doc_id, round)"
    return f"""WITH {CAND},
kept AS (SELECT *, {hit} AS fh FROM cand WHERE sim >= 0.78 AND ({facts} <= 0 OR overlap >= {facts})),
scored AS (SELECT *, row_number() OVER (PARTITION BY doc_id, round ORDER BY CASE WHEN cand_idx = fh THEN 0 ELSE 1 END, p_ai, cand_idx) AS place FROM kept WHERE cand_idx <= coalesce(fh, 1000000)),
stop AS (SELECT doc_id, min(round) AS sr FROM scored WHERE place = 1 AND p_ai < {threshold} GROUP BY doc_id),
best AS (SELECT s.*, sr, row_number() OVER (PARTITION BY s.doc_id ORDER BY CASE WHEN round = sr THEN 0 ELSE 1 END, p_ai, round) AS k FROM scored s LEFT JOIN stop USING (doc_id) WHERE place = 1 AND round <= coalesce(sr, 1000000) AND (p_ai < 1.0 OR round = sr)),
tried AS (SELECT doc_id, count(*) AS n FROM cand LEFT JOIN stop USING (doc_id) WHERE round <= coalesce(sr, 1000000) GROUP BY doc_id),
calls AS (SELECT doc_id, count(*) AS n FROM scored LEFT JOIN stop USING (doc_id) WHERE round <= coalesce(sr, 1000000) GROUP BY doc_id)
SELECT d.doc_id, stop.sr IS NOT NULL AS passed, CAST(coalesce(stop.sr + 1, 4) AS INTEGER) AS rounds_used, coalesce(tried.n, 0) AS attempts, coalesce(calls.n, 0) + CASE WHEN b.doc_id IS NULL THEN 1 ELSE 0 END AS judge_calls, b.round, b.cand_idx, round(b.p_ai, 6) AS p_ai
FROM documents d LEFT JOIN stop USING (doc_id) LEFT JOIN tried USING (doc_id) LEFT JOIN calls USING (doc_id) LEFT JOIN best b ON b.doc_id = d.doc_id AND b.k = 1"""


def _rejection_query(name, threshold, early, facts, concurrent):
    def run(spark, sf_dir):
        out = sel.rejection(candidates(spark, sf_dir), docs(spark, sf_dir), threshold, early, facts=facts, concurrent=concurrent)
        return out.withColumn("p_ai", r6("p_ai"))

    run.__doc__ = "Q-04, P-06, W-03 to W-05, V-01."
    query(name, _rejection_sql(threshold, early, facts, concurrent))(run)


for _name, _how in {"rejection_select": (0.2, 0.05, 0.0, False), "rejection_facts": (0.1, 0.3, 0.5, False), "rejection_concurrent": (0.05, 0.05, 0.0, True)}.items():
    _rejection_query(_name, *_how)


@query(
    "strategy_lookup",
    f"WITH {CAND}, s(r, name, temperature) AS (VALUES (0, 'plain', 0.7), (1, 'warm', 0.9), (2, 'wild', 1.1)) SELECT name, temperature, count(*) AS n FROM cand JOIN s ON least(round, 2) = r GROUP BY ALL".replace("0.7)", "0.7::DOUBLE)"),
)
def strategy_lookup(spark, sf_dir):
    """J-08, Q-05."""
    s = spark.createDataFrame([(0, "plain", 0.7), (1, "warm", 0.9), (2, "wild", 1.1)], "round int, name string, temperature double")
    return sel.with_strategy(candidates(spark, sf_dir), s).groupBy("name", "temperature").agg(F.count("*").alias("n"))


@query(
    "qa_gate",
    f"WITH {CAND}, s AS (SELECT doc_id, cand_idx, sim, max(CASE WHEN sim >= 0.70 THEN cand_idx END) OVER (PARTITION BY doc_id) AS ok FROM cand WHERE round = 0) SELECT doc_id, coalesce(ok, 3) AS stage, round(sim, 6) AS sim FROM s WHERE cand_idx = coalesce(ok, 3)",
)
def qa_gate(spark, sf_dir):
    """Q-09, Q-11: a document's first round as its stages."""
    s = candidates(spark, sf_dir).where("round = 0").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("cand_idx", "sim"))).alias("stages"))
    return s.withColumn("g", sel.qa_gate(F.col("stages"))).select("doc_id", F.col("g.cand_idx").alias("stage"), r6("g.sim").alias("sim"))


@query(
    "advantage_window",
    f"WITH {CAND} SELECT doc_id, round, cand_idx, round((p_ai - avg(p_ai) OVER w) / (stddev_samp(p_ai) OVER w + 1e-6), 6) AS advantage FROM cand WINDOW w AS (PARTITION BY doc_id, round)",
)
def advantage_window(spark, sf_dir):
    """A-17."""
    return candidates(spark, sf_dir).select("doc_id", "round", "cand_idx", r6(sc.advantage(F.col("p_ai"), Window.partitionBy("doc_id", "round"))).alias("advantage"))


_P = "format_string('%.2f', (doc_id % 101) / 100)"
_PAYLOAD = f"""CASE doc_id % 8
 WHEN 0 THEN concat('{{"documents":[{{"class_probabilities":{{"ai":', {_P}, ',"mixed":0.1}}}}]}}') WHEN 1 THEN concat('{{"documents":[{{"completely_generated_prob":', {_P}, '}}]}}')
 WHEN 2 THEN concat('{{"success":true,"score":{{"ai":', {_P}, '}}}}') WHEN 3 THEN concat('{{"success":false,"score":{{"ai":', {_P}, '}}}}') WHEN 4 THEN concat('{{"ai_score":', {_P}, '}}')
 WHEN 5 THEN concat('{{"fraction_ai":', {_P}, ',"fraction_ai_assisted":0.3}}') WHEN 6 THEN concat('{{"predicted_class":"human","confidence":', {_P}, '}}') ELSE '{{"predicted_class":"mixed"}}' END"""


@query(
    "payload_parse",
    """WITH d AS (SELECT doc_id, doc_id % 8 AS k, (doc_id % 101) / CAST(100 AS DOUBLE) AS p FROM documents)
SELECT doc_id, round(CASE k WHEN 0 THEN least(1, p + 0.05) WHEN 1 THEN p END, 6) AS a, round(CASE k WHEN 2 THEN p WHEN 4 THEN p END, 6) AS b, round(CASE k WHEN 5 THEN least(1, p + 0.15) WHEN 6 THEN 1 - p WHEN 7 THEN 0.5 END, 6) AS c FROM d""",
)
def payload_parse(spark, sf_dir):
    """D-04 to D-06: payloads of seven shapes with a score of each document's own."""
    d = docs(spark, sf_dir).select("doc_id", F.expr(_PAYLOAD).alias("raw"))
    return d.select("doc_id", *(r6(f(F.col("raw"))).alias(n) for n, f in (("a", sc.payload_a), ("b", sc.payload_b), ("c", sc.payload_c))))


@query(
    "cosine_centroid",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS i FROM v), c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL) GROUP BY label)
SELECT vec_id, round(list_inner_product(e, m) / sqrt(list_inner_product(e, e) * list_inner_product(m, m)), 6) AS cosine FROM v JOIN c USING (label)""",
)
def cosine_centroid(spark, sf_dir):
    """D-11: similarity of each vector with the mean of its label."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    means = v.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    return v.join(centre, "label").select("vec_id", r6(sc.cosine(F.col("e"), F.col("m"))).alias("cosine"))


@query(
    "label_eval",
    f"WITH {SCORES}, e AS (SELECT doc_id, sum(weight * p_ai) / sum(weight) AS p FROM scores GROUP BY doc_id) SELECT quality, toxic, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CASE WHEN round(p, 9) < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM e LEFT JOIN labels USING (doc_id) GROUP BY ALL",
)
def label_eval(spark, sf_dir):
    """A-26, J-01: ensemble scores against reference labels."""
    e = sc.ensemble(scores(spark, sf_dir), "doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return e.groupBy("quality", "toxic").agg(F.count("*").alias("n"), r6(F.avg("aggregate")).alias("mean_p"), r6(sc.success_rate(F.round("aggregate", 9))).alias("rate"))
