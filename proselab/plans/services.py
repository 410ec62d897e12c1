"""Queries over requests, whole jobs, registries and small text operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.functions import text as tx
from proselab.operators import corpus as co
from proselab.operators import facts as fa
from proselab.operators import fingerprint as fp
from proselab.operators import jobs, logs, registry, selection
from proselab.operators import perplexity as px
from proselab.operators import rewrite as rw
from proselab.operators import scoring as sc
from proselab.plans import corpora, scores
from proselab.plans import fingerprints as fps
from proselab.plans.seeded import CORPUS_SQL, SENTENCES, corpus, perplexity_sql, quoted
from proselab.sources import readers

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- rewrites scored as a whole

_PHRASES = [(chr(92) + "Q" + a + chr(92) + "E", b) for a, b in lx.PHRASES]
_TRAINED = corpora._chain_sql("text", _PHRASES)
_FORMS = {"base": "text", "base_scrub": corpora._chain_sql("text", lx.PLAIN_CONTRACTIONS), "trained": _TRAINED, "trained_scrub": corpora._chain_sql(_TRAINED, lx.PLAIN_CONTRACTIONS)}
_PATTERN = f"({' + '.join(f'({fps.SIGNAL_SQL[n]}) * {w}' for n, w in lx.WEIGHTS)}) / {sum(w for _, w in lx.WEIGHTS)}"
_SCORED = f", sc AS (SELECT doc_id, source, body, tok, sw, {_PATTERN} AS p_pattern, {fps.REDUCED_PRINT} AS p_reduced, {fps.SIGNAL_SQL['burstiness']} AS p_evenness FROM feat), en AS (SELECT *, (p_pattern * 1.0 + p_reduced * 1.0 + p_evenness * 0.5) / 2.5 AS p_ai FROM sc)"
_VARIANTS = fps.features_of(f"{CORPUS_SQL}, var AS (SELECT doc_id, lang, unnest([{', '.join(map(quoted, _FORMS))}]) AS source, unnest([{', '.join(_FORMS.values())}]) AS text FROM corpus)", "var") + _SCORED
_REWRITTEN = (
    fps.features_of(f"{CORPUS_SQL}, var AS (SELECT doc_id, lang, source, {_FORMS['trained_scrub']} AS text FROM corpus)", "var")
    + _SCORED
    + f""", ev AS (SELECT e.*, {fps._CV} AS cv, list_distinct(e.tok) AS x, list_distinct(regexp_extract_all(lower(c.text), '[a-z][a-z''-]*')) AS y FROM en e JOIN corpus c USING (doc_id)),
done AS (SELECT *, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END AS similarity FROM ev)"""
)


def rewrite(text):
    return rw.contractions(rw.phrases(text))


def rewritten(spark, sf_dir):
    return jobs.evaluated(corpus(spark, sf_dir), rewrite)


def variant_rows(spark, sf_dir):
    return jobs.variant_scores(corpus(spark, sf_dir).select("doc_id", "text"), rw.phrases_native, rw.contractions_native)


@query("final_scores", f"WITH {_REWRITTEN} SELECT doc_id, round(p_ai, 6) AS p_ai, round(p_pattern, 6) AS pattern, round(similarity, 6) AS similarity FROM done")
def final_scores(spark, sf_dir):
    """Q-10, D-01, D-07: the scores of each document's rewrite."""
    return rewritten(spark, sf_dir).select("doc_id", r6("p_ai").alias("p_ai"), r6("p_pattern").alias("pattern"), r6("similarity").alias("similarity"))


_RATE = "avg(CASE WHEN {} < 0.5 THEN 1.0 ELSE 0.0 END)"
_SUMMARY = f"SELECT count(*) AS n, avg(p_ai) AS mean_p_ai, {_RATE.format('p_ai')} AS asr, {_RATE.format('p_pattern')} AS a, {_RATE.format('p_reduced')} AS b, {_RATE.format('p_evenness')} AS c, avg(similarity) AS sim, avg(cv) AS cv, avg(CASE WHEN isnan(perplexity) THEN NULL ELSE perplexity END) AS ppl FROM done JOIN pp USING (doc_id)"


@query(
    "evaluate_job",
    f"""WITH {_REWRITTEN}, made AS (SELECT doc_id, body AS text FROM done), {perplexity_sql('corpus', 'made', 'pp', window=1024, stride=512)}, s AS ({_SUMMARY})
SELECT n, round(mean_p_ai, 6) AS mean_p_ai, round(ppl, 4) AS mean_perplexity, round(sim, 6) AS mean_similarity, 'n=' || n || chr(10) || printf('mean_p_ai=%.3f', mean_p_ai) || chr(10) || printf('asr_ensemble=%.2f', asr * 100) || '%' || chr(10) || 'asr_per_detector:'
  || chr(10) || '  ' || rpad('pattern', 50, ' ') || printf(' %.2f', a * 100) || '%' || chr(10) || '  ' || rpad('reduced', 50, ' ') || printf(' %.2f', b * 100) || '%' || chr(10) || '  ' || rpad('evenness', 50, ' ') || printf(' %.2f', c * 100) || '%'
  || chr(10) || printf('mean_similarity=%.3f', sim) || chr(10) || printf('mean_perplexity=%.1f', ppl) || chr(10) || printf('mean_burstiness_cv=%.2f', cv) AS summary FROM s""",
)
def evaluate_job(spark, sf_dir):
    """E-01, A-05, M-05, D-13: rewrite, score, also by a language model of the other documents, summarise."""
    # the texts themselves are not read again
    rows = readers.settled(rewritten(spark, sf_dir).drop("perplexity", "lang", "source", "text"), "zstd")
    found = px.perplexity(rows.select("doc_id", F.col("rewrite").alias("text")), corpus(spark, sf_dir))
    s = jobs.summary(rows.join(found.select("doc_id", "perplexity"), "doc_id")).withColumn("summary", jobs.summary_text())
    return s.select("n", r6("mean_p_ai").alias("mean_p_ai"), r6("mean_similarity").alias("mean_similarity"), F.round("mean_perplexity", 4).alias("mean_perplexity"), "summary")


@query(
    "variant_cross",
    f"WITH {_VARIANTS}, u AS (SELECT source AS variant, unnest(['pattern', 'reduced', 'evenness']) AS detector, unnest([p_pattern, p_reduced, p_evenness]) AS p FROM en) SELECT variant, detector, count(*) AS n, round(avg(p), 6) AS mean_p, round({_RATE.format('p')}, 6) AS rate FROM u GROUP BY ALL",
)
def variant_cross(spark, sf_dir):
    """J-10, M-12, E-02: four variants of each text by every detector."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("detector"), F.col(f"p_{n}").alias("p")) for n, _ in registry.DETECTORS)))
    rows = variant_rows(spark, sf_dir).select("variant", each.alias("s")).select("variant", "s.*")
    return rows.groupBy("variant", "detector").agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean_p"), r6(sc.success_rate("p")).alias("rate"))


@query(
    "held_out_summary",
    f"""WITH {_VARIANTS}, b AS (SELECT avg(p_ai) AS p, {_RATE.format('p_ai')} AS a, count(*) AS n FROM en WHERE source = 'base'), t AS (SELECT avg(p_ai) AS p, {_RATE.format('p_ai')} AS a FROM en WHERE source = 'trained')
SELECT n, round(b.p, 6) AS base_p_ai, round(b.a, 6) AS base_asr, round(t.p, 6) AS trained_p_ai, round(t.a, 6) AS trained_asr, round(t.p - b.p, 6) AS delta_p_ai, round(t.a - b.a, 6) AS delta_asr FROM b, t""",
)
def held_out_summary(spark, sf_dir):
    """A-16."""
    s = jobs.held_out_summary(variant_rows(spark, sf_dir))
    return s.select("n", *(r6(c).alias(c) for c in s.columns if c != "n"))


@query(
    "head_to_head",
    f"""WITH {_VARIANTS}, w AS (SELECT doc_id, min(p_ai) FILTER (WHERE source = 'base') AS b, min(p_ai) FILTER (WHERE source = 'trained') AS t FROM en GROUP BY doc_id ORDER BY doc_id LIMIT 20)
SELECT count(*) AS n, round(avg(b), 6) AS base_mean, count(*) FILTER (WHERE b < 0.5) AS base_hits, round(avg(t), 6) AS trained_mean, count(*) FILTER (WHERE t < 0.5) AS trained_hits, round(avg(t) - avg(b), 6) AS delta FROM w""",
)
def head_to_head(spark, sf_dir):
    """A-26: the first twenty documents, as the report has."""
    s = jobs.head_to_head(variant_rows(spark, sf_dir), 20)
    return s.select(*(r6(c).alias(c) if c.endswith(("mean", "delta")) else F.col(c) for c in s.columns))


@query(
    "stage_trace",
    f"""WITH {CORPUS_SQL}, s AS (SELECT doc_id, text AS a, {_FORMS['trained']} AS b, {_FORMS['trained_scrub']} AS c FROM corpus)
SELECT doc_id, 'phrases:' || len(regexp_extract_all(b, '\\S+')) || ':' || (b <> a) || ',contractions:' || len(regexp_extract_all(c, '\\S+')) || ':' || (c <> b) AS trace FROM s""",
)
def stage_trace(spark, sf_dir):
    """Q-11."""
    trace = jobs.stages(F.col("text"), {"phrases": rw.phrases_native, "contractions": rw.contractions_native})
    line = F.array_join(F.transform(trace, lambda s: F.concat_ws(":", s["stage"], s["words"].cast("string"), s["changed"].cast("string"))), ",")
    return corpus(spark, sf_dir).select("doc_id", line.alias("trace"))


@query(
    "refine_prompts",
    f"""WITH {fps.PRINT_SQL} SELECT doc_id, md5(CASE WHEN len(flagged) = 0 THEN body ELSE 'This draft still reads as AI on these axes — fix THESE specifically:' || chr(10) || array_to_string(list_transform(flagged, lambda f: '- ' || CASE f {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in lx.ADVICE.items())} END), chr(10)) || chr(10) || chr(10) || 'Draft:' || chr(10) || body END) AS prompt FROM prints""",
)
def refine_prompts(spark, sf_dir):
    """Q-08."""
    f = fp.fingerprint(corpus(spark, sf_dir))
    return f.select("doc_id", F.md5(selection.refine_input(F.col("flagged"), F.col("text"), lx.ADVICE).cast("binary")).alias("prompt"))


@query(
    "unigram_perplexity",
    f"""WITH {CORPUS_SQL}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS token FROM corpus), c AS (SELECT token, count(*) AS c FROM t GROUP BY token),
p AS (SELECT doc_id, exp((SELECT ln(count(*)) FROM t) - sum(ln(c)) / count(*)) AS perplexity FROM t JOIN c USING (token) GROUP BY doc_id)
SELECT doc_id, round(perplexity, 4) AS perplexity FROM corpus LEFT JOIN p USING (doc_id)""",
)
def unigram_perplexity(spark, sf_dir):
    """D-13."""
    return jobs.unigram_perplexity(corpus(spark, sf_dir)).select("doc_id", F.round("perplexity", 4).alias("perplexity"))


# --- requests and jobs


def requests(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 18).alias("candidates"),
        F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 10).alias("max_rounds"), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 13) / 10.0).alias("threshold"),
    )


_CHECKED = """req AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 5 = 0 THEN doc_id % 18 END AS candidates, CASE WHEN doc_id % 7 = 0 THEN doc_id % 10 END AS rounds, CASE WHEN doc_id % 3 = 0 THEN doc_id % 13 END AS tenths FROM documents),
wrong AS (SELECT *, CASE WHEN length(text) < 1 THEN 'text' WHEN NOT rounds BETWEEN 1 AND 8 THEN 'max_rounds' WHEN NOT candidates BETWEEN 1 AND 16 THEN 'candidates' WHEN NOT tenths BETWEEN 0 AND 10 THEN 'threshold' END AS w FROM req),
checked AS (SELECT doc_id, CASE WHEN w IS NOT NULL THEN 422 WHEN length(text) > 2000 THEN 413 ELSE 200 END AS status,
  CASE WHEN w IS NOT NULL THEN 'out of range: ' || w WHEN length(text) > 2000 THEN 'text exceeds max_chars=2000 (got ' || length(text) || ')' END AS detail FROM wrong)"""


@query("request_validation", f"WITH {_CHECKED} SELECT doc_id, status, detail FROM checked")
def request_validation(spark, sf_dir):
    """P-09."""
    return jobs.validated(requests(spark, sf_dir), 2000).select("doc_id", "status", "detail")


@query(
    "request_job",
    f"""WITH {_CHECKED}, r AS ({scores._rejection_sql(0.2, 0.05, 0.0, False)})
SELECT doc_id, status, detail, CASE WHEN status = 200 THEN passed END AS passed, CASE WHEN status = 200 THEN p_ai END AS score, CASE WHEN status = 200 THEN CAST(round(attempts * 0.001 + judge_calls * 0.003, 6) AS DOUBLE) END AS cost FROM checked JOIN r USING (doc_id)""",
)
def request_job(spark, sf_dir):
    """V-01: validation, rejection, response."""
    out = jobs.responses(requests(spark, sf_dir), scores.candidates(spark, sf_dir), max_chars=2000)
    return out.select("doc_id", "status", "detail", "passed", r6("score").alias("score"), r6("cost").alias("cost"))


@query(
    "sample_job",
    f"WITH {scores.CAND}, s(r, name, temperature) AS (VALUES (0, 'plain', 0.7::DOUBLE), (1, 'warm', 0.9), (2, 'wild', 1.1)) SELECT doc_id, cand_idx, name, temperature, round(p_ai, 6) AS p_ai FROM cand JOIN s ON least(round, 2) = r WHERE round = 0 AND cand_idx < 3",
)
def sample_job(spark, sf_dir):
    """V-03, Q-02."""
    s = spark.createDataFrame([(0, "plain", 0.7), (1, "warm", 0.9), (2, "wild", 1.1)], "round int, name string, temperature double")
    return jobs.samples(scores.candidates(spark, sf_dir), 3, s).select("doc_id", "cand_idx", "name", "temperature", r6("p_ai").alias("p_ai"))


@query(
    "estimate_requests",
    f"WITH {corpora._FACTS_SQL} SELECT doc_id, CAST({' + '.join(f'len({k})' for k in fa.KINDS)} AS BIGINT) AS facts, CAST(round((1 + doc_id % 16) * 0.004, 6) AS DOUBLE) AS expected, CAST(round((1 + doc_id % 16) * (1 + doc_id % 8) * 0.004, 6) AS DOUBLE) AS worst FROM f",
)
def estimate_requests(spark, sf_dir):
    """V-04, X-09, A-22."""
    f = fa.extract(corpus(spark, sf_dir))
    e = logs.estimate(1 + F.col("doc_id") % 16, 1 + F.col("doc_id") % 8)
    return f.select("doc_id", fa.counts().cast("long").alias("facts"), r6(e["expected"]).alias("expected"), r6(e["worst"]).alias("worst"))


@query(
    "pair_generation",
    "SELECT md5(text || CAST(k AS VARCHAR)) AS ai, doc_id AS human_idx, CAST(k AS INTEGER) AS prompt_idx FROM documents, range(3) AS r(k) WHERE (doc_id * 3 + k) % 7 <> 0 AND (doc_id * 3 + k) % 4 <> 1 AND text IS NOT NULL",
)
def pair_generation(spark, sf_dir):
    """C-02, P-10, J-03: a fourth of the jobs is done already, a seventh of the answers failed."""
    docs, job = read(spark, sf_dir, "documents").select("doc_id", "text"), F.col("human_idx") * 3 + F.col("prompt_idx")

    def answered(grid):
        good = F.md5(F.concat("human", F.col("prompt_idx").cast("string")).cast("binary"))
        return grid.withColumn("ai", F.when(job % 7 == 0, F.lit(lx.FAILED + " timeout")).otherwise(good))

    done = co.pair_grid(docs.select(F.col("doc_id").alias("human_idx")), 3).where(job % 4 == 1)
    return jobs.pair_rows(docs, 3, answered, done).select("ai", "human_idx", "prompt_idx")


@query("token_plans", "SELECT source, count(*) AS humans, count(*) * 8 AS calls, count(*) * 8 * 350 AS tokens, CAST(round(count(*) * 8 * 350 * 0.00000045, 9) AS DOUBLE) AS cost, count(*) * 8 * 350 * 0.00000045 <= 0.05 AS allowed FROM documents GROUP BY source")
def token_plans(spark, sf_dir):
    """A-23."""
    n = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("humans")).withColumn("p", jobs.token_plan(F.col("humans"), 8, 0.05))
    return n.select("source", "humans", "p.calls", "p.tokens", F.round("p.cost", 9).alias("cost"), "p.allowed")


@query(
    "best_of_n_gain",
    f"WITH {scores.CAND}, b AS (SELECT doc_id, round, min(p_ai) FILTER (WHERE cand_idx = 0) AS first, coalesce(min(p_ai) FILTER (WHERE sim >= 0.75), min(p_ai)) AS best FROM cand GROUP BY ALL) SELECT count(*) AS n, round(avg(first), 9) AS mean_first, round(avg(best), 9) AS mean_best, round(avg(best - first), 9) AS gain FROM b",
)
def best_of_n_gain(spark, sf_dir):
    """Q-13."""
    g = jobs.best_of_n_gain(scores.candidates(spark, sf_dir), 0.75)
    return g.select("n", *(F.round(c, 9).alias(c) for c in ("mean_first", "mean_best", "gain")))


@query(
    "fact_coverage",
    f"WITH {corpora._OVERLAP_SQL} SELECT count(*) AS n, round(avg(share), 6) AS mean, " + ", ".join(f"count(*) FILTER (WHERE share >= {t}) AS ge{k}, count(*) FILTER (WHERE share >= {t}) * 100 // count(*) AS pct{k}" for k, t in ((5, 0.5), (7, 0.7), (8, 0.8))) + " FROM o",
)
def fact_coverage(spark, sf_dir):
    """X-07: shares at three thresholds with whole percents, rounded down; null percents without documents."""
    part = [(k, F.count_if(F.col("share") >= t)) for k, t in ((5, 0.5), (7, 0.7), (8, 0.8))]
    out = [x for k, n in part for x in (n.alias(f"ge{k}"), F.floor(n * 100 / F.nullif(F.count("*"), F.lit(0))).cast("long").alias(f"pct{k}"))]
    return corpora.overlaps(spark, sf_dir).agg(F.count("*").alias("n"), r6(F.avg("share")).alias("mean"), *out)


# --- registries

_JUDGES = tuple(registry.Judge(n, f"{n.upper()}_KEY", 1.0) for n in ("first", "second", "third"))
_NAMES = [j.name for j in _JUDGES]
_BITS = [f"CASE WHEN doc_id & {1 << k} <> 0 THEN {quoted(n)} END" for k, n in enumerate(_NAMES)]


@query(
    "judge_resolution",
    f"WITH j AS (SELECT doc_id AS id, list_filter([{', '.join(_BITS)}], lambda x: x IS NOT NULL) AS names FROM documents) SELECT id, CASE len(names) WHEN 0 THEN 'local' WHEN 1 THEN names[1] ELSE 'ensemble(' || array_to_string(names, '+') || ')' END AS judge, CAST(len(names) AS INTEGER) AS members FROM j",
)
def judge_resolution(spark, sf_dir):
    """D-10, J-09, M-09: the bits of doc_id are the keys that a configuration sets."""
    judges = spark.createDataFrame([(k, *j) for k, j in enumerate(_JUDGES)], "place int, name string, key string, weight double")
    keys = F.array(F.lit(None).cast("string"), *(F.when(F.col("doc_id").bitwiseAND(1 << k) != 0, j.key) for k, j in enumerate(_JUDGES)), F.lit("OTHER_KEY"))
    return registry.resolved(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(keys).alias("key")), judges)


@query("holdout_members", f"WITH {scores.SCORES} SELECT doc_id, round(sum(weight * p_ai) / sum(weight), 6) AS aggregate, count(*) AS members FROM scores WHERE detector <> 'beta' GROUP BY doc_id")
def holdout_members(spark, sf_dir):
    """D-08: an ensemble of which one member did not load."""
    members = spark.createDataFrame([("alpha", True), ("beta", False), ("gamma", True)], "detector string, loaded boolean")
    e = sc.ensemble(registry.available(scores.scores(spark, sf_dir), members), "doc_id")
    return e.select("doc_id", r6("aggregate").alias("aggregate"), F.size("by_name").cast("long").alias("members"))


@query(
    "ensemble_breakdown",
    f"WITH {scores.SCORES} SELECT doc_id, round(sum(weight * p_ai) / sum(weight), 6) AS aggregate, round(1 - sum(weight * p_ai) / sum(weight), 6) AS reward, string_agg(detector || '=' || printf('%.6f', p_ai), ';' ORDER BY detector) AS by_name FROM scores GROUP BY doc_id",
)
def ensemble_breakdown(spark, sf_dir):
    """A-04, D-09, V-02: the aggregate, the reward and the scores behind it."""
    e = sc.ensemble(scores.scores(spark, sf_dir), "doc_id")
    names = F.transform(F.array_sort(F.map_entries("by_name")), lambda x: F.concat(x["key"], F.lit("="), F.format_string("%.6f", x["value"])))
    return e.select("doc_id", r6("aggregate").alias("aggregate"), r6(1 - F.col("aggregate")).alias("reward"), F.array_join(names, ";").alias("by_name"))


@query(
    "small_rewards",
    f"WITH {scores.CAND} SELECT doc_id, round, cand_idx, round((1 - p_ai) + 0.5 * (1 - overlap), 6) AS first_reward, round(1 / (1 + exp(-25 * (0.9015 - (0.5 + p_ai) / sim))), 6) AS ratio_score FROM cand",
)
def small_rewards(spark, sf_dir):
    """D-17, D-03."""
    c = scores.candidates(spark, sf_dir)
    return c.select("doc_id", "round", "cand_idx", r6(sc.first_reward(F.col("p_ai"), F.col("overlap"))).alias("first_reward"), r6(sc.ratio_score(0.5 + F.col("p_ai"), F.col("sim"))).alias("ratio_score"))


# --- small text operators

_S = f"([{', '.join(map(quoted, SENTENCES))}])[doc_id % {len(SENTENCES)} + 1]"


def sentences(spark, sf_dir):
    """doc_id, source, s: the sentences that the seeded corpus adds to each document."""
    s = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.pmod("doc_id", F.lit(len(SENTENCES))) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), s.alias("s"))


_WIKI = f"'  = ' || coalesce(source, '') || ' =  ' || chr(10) || {_S} || ' [ 12 ] two @-@ fold  3 @,@ 000 <b>and</b> 1 @.@ 5[3]' || chr(10) || ' == Sub == ' || chr(10) || 'end '"


def _wiki_sql(text):
    out = f"regexp_replace({text}, '(?m)^\\s*=+.*=+\\s*$', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '\\[ ?\\d+ ?\\]', '', 'g'), '\\s*<[^>]+>', '', 'g')"
    for mark in "-,.":
        out = f"replace({out}, ' @{mark}@ ', '{mark}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("wiki_clean", f"SELECT doc_id, {_wiki_sql(_WIKI)} AS text FROM documents")
def wiki_clean(spark, sf_dir):
    """T-14."""
    raw = F.concat(F.lit("  = "), F.col("source"), F.lit(" =  \n"), F.col("s"), F.lit(" [ 12 ] two @-@ fold  3 @,@ 000 <b>and</b> 1 @.@ 5[3]\n == Sub == \nend "))
    return sentences(spark, sf_dir).select("doc_id", tx.unmarked_wiki(raw).alias("text"))


_NEWS = f"CASE doc_id % 3 WHEN 0 THEN '(CNN) -- ' WHEN 1 THEN 'LONDON, England (CNN) -- ' ELSE '' END || {_S} || '  (CNN) --  more'"


@query("news_text", f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({_NEWS}, '^\\s*\\(CNN\\)\\s*--\\s*', ''), '^\\s*[A-Z][A-Za-z .,]{{0,40}}\\([A-Za-z ]+\\)\\s*--?\\s*', ''), '\\s+', ' ', 'g')) AS clean, trim(regexp_replace({_NEWS}, '\\s+', ' ', 'g')) AS short FROM documents")
def news_text(spark, sf_dir):
    """S-10, S-11: leading agency mark and dateline go; white space alone."""
    lead = F.when(F.col("doc_id") % 3 == 0, "(CNN) -- ").when(F.col("doc_id") % 3 == 1, "LONDON, England (CNN) -- ").otherwise("")
    raw = F.concat(lead, F.col("s"), F.lit("  (CNN) --  more"))
    return sentences(spark, sf_dir).select("doc_id", co.news_clean(raw).alias("clean"), co.short_news(raw).alias("short"))


@query("completion_contents", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'said ' || doc_id WHEN 1 THEN 'told ' || doc_id WHEN 2 THEN 'plain ' || doc_id ELSE '[not json ' || doc_id END AS content FROM documents")
def completion_contents(spark, sf_dir):
    """T-27."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit('[{"role":"assistant","content":"said '), n, F.lit('"}]')))
        .when(k == 1, F.concat(F.lit('[[{"content":"told '), n, F.lit('"}]]'))).when(k == 2, F.concat(F.lit("plain "), n)).otherwise(F.concat(F.lit("[not json "), n))
    )
    return read(spark, sf_dir, "documents").select("doc_id", tx.completion_text(raw).alias("content"))


_USER, _ANSWER = "<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10)", "'<|im_start|>assistant' || chr(10)"


@query(
    "chat_lengths",
    f"""WITH {CORPUS_SQL}, p AS (SELECT doc_id, len(regexp_extract_all('{_USER} || {_ANSWER}, '\\S+')) AS prompt, len(regexp_extract_all('{_USER} || {_ANSWER} || {_S} || '<|im_end|>' || chr(10), '\\S+')) AS whole FROM corpus)
SELECT doc_id, least(whole, 300) AS input, least(prompt, whole, 300) AS masked, least(whole, 300) - least(prompt, whole, 300) AS learned FROM p""",
)
def chat_lengths(spark, sf_dir):
    """T-18: rendered turns, the prompt's mask and truncation, by words as the tokens."""
    c = corpus(spark, sf_dir).join(sentences(spark, sf_dir).select("doc_id", "s"), "doc_id")
    turns = tx.chat("Be brief.", "text", "s")
    m = tx.masked_lengths(tx.word_count(tx.rendered(turns)), tx.word_count(tx.rendered(turns, True)), 300)
    return c.select("doc_id", *(m[n].cast("long").alias(n) for n in ("input", "masked", "learned")))


@query("worker_contractions", f"WITH {CORPUS_SQL} SELECT doc_id, md5({corpora._chain_sql('text', lx.WORKER_CONTRACTIONS)}) AS rewrite FROM corpus")
def worker_contractions(spark, sf_dir):
    """B-06."""
    return corpus(spark, sf_dir).select("doc_id", F.md5(rw.worker_contractions(F.col("text")).cast("binary")).alias("rewrite"))


# --- logs

_FORWARD = "CASE event_id % 4 WHEN 0 THEN ' 10.0.0.' || user_id || ' , 9.9.9.9' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE ' ,8.8.8.8' END"


@query("client_keys", f"SELECT coalesce(nullif(trim(string_split({_FORWARD}, ',')[1]), ''), CASE WHEN event_id % 3 > 0 THEN 'peer' || event_id % 5 END, 'unknown') AS client, count(*) AS n FROM events GROUP BY 1")
def client_keys(spark, sf_dir):
    """ST-02."""
    k = F.col("event_id") % 4
    forwarded = F.when(k == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , 9.9.9.9"))).when(k == 1, "").when(k == 3, " ,8.8.8.8")
    peer = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("peer"), (F.col("event_id") % 5).cast("string")))
    return read(spark, sf_dir, "events").groupBy(logs.client(forwarded, peer).alias("client")).agg(F.count("*").alias("n"))


@query(
    "step_lines",
    """WITH l AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'step ' || event_id || '/9000  R̄=-' || event_id % 7 || '.25 R_max=1.5 p_ai=0.' || event_id % 10 || ' KL=+0.01 loss=-0.5 t=' || event_id % 60 || '.5s extra' WHEN 1 THEN 'saved step 5/9000' ELSE 'step x/9000' END AS value FROM events)
SELECT event_id, event_id AS step, CAST(9000 AS BIGINT) AS total, CAST(-(event_id % 7) - 0.25 AS DOUBLE) AS mean_reward, CAST('0.' || event_id % 10 AS DOUBLE) AS p_ai, CAST(event_id % 60 + 0.5 AS DOUBLE) AS seconds FROM l WHERE regexp_matches(value, '^step\\s+\\d+/\\d+\\s')""",
)
def step_lines(spark, sf_dir):
    """ST-05."""
    n = F.col("event_id")
    s = lambda c: c.cast("string")
    good = F.concat(F.lit("step "), s(n), F.lit("/9000  R̄=-"), s(n % 7), F.lit(".25 R_max=1.5 p_ai=0."), s(n % 10), F.lit(" KL=+0.01 loss=-0.5 t="), s(n % 60), F.lit(".5s extra"))
    lines = read(spark, sf_dir, "events").select("event_id", F.when(n % 3 == 0, good).when(n % 3 == 1, "saved step 5/9000").otherwise("step x/9000").alias("value"))
    return logs.step_lines(lines).select("event_id", "step", "total", "mean_reward", "p_ai", "seconds")


@query(
    "run_guard",
    """WITH r AS (SELECT user_id, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z, count(*) AS steps FROM events GROUP BY user_id), n AS (SELECT epoch_us(max(ts)) AS now FROM events),
g AS (SELECT *, now / 1e6 - greatest(z / 1e6, a / 1e6 + 1800) AS idle, (now / 1e6 - a / 1e6) / 3600 AS hours FROM r, n)
SELECT user_id, steps, CAST(floor(greatest(idle / 60, 0)) AS BIGINT) AS idle_min, CASE WHEN hours >= 500 THEN 'cap' WHEN idle / 60 >= 600 THEN 'stall' END AS ended FROM g""",
)
def run_guard(spark, sf_dir):
    """ST-06, ST-07: by user as a run, seen at the log's last moment."""
    e = read(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).scalar()
    return logs.guarded(e, "user_id", "ts", 600, 30, 500, now).select("user_id", "steps", "idle_min", "ended")


@query(
    "telemetry_errors",
    """SELECT CASE WHEN event_id % 7 = 0 THEN 'http_500' WHEN event_id % 3 = 2 THEN 'non-json-response' END AS error, count(*) AS n, round(sum(CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN event_id % 10 / 10.0 WHEN event_id % 3 = 1 THEN event_id % 9 / 10.0 END), 6)::DOUBLE AS score FROM events GROUP BY 1""",
)
def telemetry_errors(spark, sf_dir):
    """ST-04: failures, bodies that are no JSON, and scores under either name."""
    n = F.col("event_id")
    body = F.when(n % 3 == 0, F.concat(F.lit('{"score":0.'), (n % 10).cast("string"), F.lit("}"))).when(n % 3 == 1, F.concat(F.lit('{"p_ai":0.'), (n % 9).cast("string"), F.lit("}"))).otherwise("<html>")
    rows = read(spark, sf_dir, "events").select(F.lit("/detect").alias("path"), F.when(n % 7 == 0, 500).otherwise(200).alias("status"), body.alias("body"))
    return logs.telemetry(rows).groupBy("error").agg(F.count("*").alias("n"), r6(F.sum("score")).alias("score"))


@query("minibatch", "SELECT doc_id, md5('5:' || doc_id) AS place FROM documents ORDER BY place, doc_id LIMIT 64")
def minibatch(spark, sf_dir):
    """L-04, L-06, L-08: the first 64 documents in a seeded order; the number is the batch's."""
    return co.minibatch(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64, 5)
