"""Queries over facts, rewrites, corpus preparation and logs, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.operators import corpus as co
from proselab.operators import facts as fa
from proselab.operators import logs
from proselab.operators import rewrite as rw
from proselab.plans.seeded import CORPUS_SQL, corpus, quoted

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- facts

_LETTERS = "[ªµºÀ-ÖØ-öø-ɏ]"


def _fact_ctes(source: str, out: str) -> str:
    """CTEs from ``source`` (doc_id, t) to ``out`` (doc_id, low, and an array for each kind)."""
    steps, held, last = [], [], f"{out}_in"
    steps.append(f"{last} AS (SELECT doc_id, lower(t) AS low, regexp_replace(t, '{_LETTERS}', '_', 'g') AS rest FROM {source})")
    for kind, pattern in lx.FACTS:
        p = quoted(("(?i)" if kind != "proper_noun" else "") + pattern)
        found = f"regexp_extract_all(rest, {p})"
        if kind != "proper_noun":
            found = f"list_transform({found}, lambda x: replace(lower(regexp_replace(trim(x, ' \n\t'), '\\s+', ' ', 'g')), ',', ''))"
        step = f"{out}_{kind}"
        steps.append(f"{step} AS (SELECT doc_id, low, {''.join(h + ', ' for h in held)}list_sort(list_distinct({found})) AS {kind}, regexp_replace(rest, {p}, '_', 'g') AS rest FROM {last})")
        held.append(kind)
        last = step
    return ",\n".join(steps) + f",\n{out} AS (SELECT * FROM {last})"


_FACTS_SQL = CORPUS_SQL + ", whole AS (SELECT doc_id, text AS t FROM corpus), " + _fact_ctes("whole", "f")
_CUT_SQL = _FACTS_SQL + ", part AS (SELECT doc_id, substr(text, CAST(length(text) * 3 // 10 AS BIGINT) + 1, length(text)) AS t FROM corpus), " + _fact_ctes("part", "g")


def _kept_sql(kind):
    ok = f"list_contains(g.{kind}, x)"
    if kind in ("currency", "number", "year", "pct"):
        ok += " OR (regexp_replace(x, '[^0-9.]+', '', 'g') <> '' AND contains(regexp_replace(g.low, '(\\d),(\\d)', '\\1\\2', 'g'), regexp_replace(x, '[^0-9.]+', '', 'g')))"
    if kind == "proper_noun":
        ok += " OR contains(g.low, lower(x))"
    return f"len(list_filter(f.{kind}, lambda x: {ok}))"


_ALL = " || ".join(f"f.{k}" for k in fa.KINDS)
_SHARE = f"CASE WHEN len({_ALL}) = 0 THEN 1.0 ELSE ({' + '.join(map(_kept_sql, fa.KINDS))}) / CAST(len(list_distinct({_ALL})) AS DOUBLE) END"
_OVERLAP_SQL = _CUT_SQL + f", o AS (SELECT f.doc_id, {_SHARE} AS share FROM f JOIN g USING (doc_id))"


def overlaps(spark, sf_dir):
    """doc_id, source, share: each document's facts against its text without the first three tenths."""
    c = corpus(spark, sf_dir).withColumn("part", F.expr("substr(text, int(length(text) * 3 div 10) + 1)"))
    both = fa.extract(fa.extract(c, "text", "f"), "part", "g")
    return both.select("doc_id", "source", fa.overlap("f", "g", F.col("part")).alias("share"))


@query("fact_counts", f"WITH {_FACTS_SQL} SELECT doc_id, {', '.join(f'len({k}) AS {k}' for k in fa.KINDS)}, array_to_string({' || '.join(fa.KINDS)}, '|') AS facts FROM f")
def fact_counts(spark, sf_dir):
    """X-01 to X-03, X-09."""
    f = fa.extract(corpus(spark, sf_dir))
    every = F.array_join(F.concat(*(F.col(f"facts.{k}") for k in fa.KINDS)), "|")
    return f.select("doc_id", *(F.size(f"facts.{k}").cast("long").alias(k) for k in fa.KINDS), every.alias("facts"))


@query("fact_overlap", f"WITH {_OVERLAP_SQL} SELECT doc_id, round(share, 6) AS share FROM o")
def fact_overlap(spark, sf_dir):
    """X-04, J-04, L-11."""
    return overlaps(spark, sf_dir).select("doc_id", r6("share").alias("share"))


_BIN = "CASE " + " ".join(f"WHEN share >= {e} THEN {e}" for e in reversed(fa.EDGES)) + " END"


@query("overlap_histogram", f"WITH {_OVERLAP_SQL} SELECT CAST({_BIN} AS DOUBLE) AS low, count(*) AS n, count(*) FILTER (WHERE share >= 0.7) AS kept FROM o GROUP BY 1")
def overlap_histogram(spark, sf_dir):
    """X-05 to X-07."""
    return overlaps(spark, sf_dir).groupBy(fa.histogram_bin(F.col("share")).alias("low")).agg(F.count("*").alias("n"), F.count_if(F.col("share") >= 0.7).alias("kept"))


@query("source_keep_rate", f"WITH {_OVERLAP_SQL} SELECT coalesce(d.source, '?') AS source, count(*) AS n, count(*) FILTER (WHERE share >= 0.7) AS kept FROM o JOIN documents d USING (doc_id) GROUP BY 1 ORDER BY 1")
def source_keep_rate(spark, sf_dir):
    """X-08, L-14."""
    return overlaps(spark, sf_dir).groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("share") >= 0.7).alias("kept")).orderBy("source")


# --- rewrites


def _chain_sql(text, rules):
    for p, r in rules:
        text = f"regexp_replace({text}, {quoted(p)}, {quoted(r)}, 'gi')"
    return text


@query("phrase_swap_native", f"WITH {CORPUS_SQL} SELECT doc_id, md5({_chain_sql('text', [(chr(92) + 'Q' + a + chr(92) + 'E', b) for a, b in lx.PHRASES])}) AS rewrite FROM corpus")
def phrase_swap_native(spark, sf_dir):
    """R-04, T-11."""
    return corpus(spark, sf_dir).select("doc_id", F.md5(rw.phrases_native(F.col("text")).cast("binary")).alias("rewrite"))


@query("contraction_native", f"WITH {CORPUS_SQL} SELECT doc_id, md5({_chain_sql('text', lx.PLAIN_CONTRACTIONS)}) AS rewrite FROM corpus")
def contraction_native(spark, sf_dir):
    """B-04, B-06."""
    return corpus(spark, sf_dir).select("doc_id", F.md5(rw.contractions_native(F.col("text")).cast("binary")).alias("rewrite"))


# --- corpus preparation


@query("html_clean", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text FROM pages")
def html_clean(spark, sf_dir):
    """T-14's tag removal on raw pages."""
    out = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " ")
    return read(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(out).cast("binary")).alias("text"))


@query(
    "article_assembly",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
a AS (SELECT *, sum(CASE WHEN len(regexp_extract_all(line, '\\S+')) <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS article FROM l)
SELECT doc_id, CAST(article AS BIGINT) AS article, md5(string_agg(line, ' ' ORDER BY line_no)) AS body FROM a WHERE article > 0 GROUP BY ALL""",
)
def article_assembly(spark, sf_dir):
    """S-09, W-06: lines of three words or fewer are headers."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return co.articles(lines, F.regexp_count("text", F.lit(r"\S+")) <= 3).select("doc_id", "article", F.md5(F.col("body").cast("binary")).alias("body"))


@query("pair_grid", "SELECT source, k % 5 AS prompt_idx, count(*) AS n FROM documents, range(5) AS r(k) GROUP BY ALL")
def pair_grid(spark, sf_dir):
    """J-02."""
    return co.pair_grid(read(spark, sf_dir, "documents").select("doc_id", "source"), 5).groupBy("source", F.col("prompt_idx").cast("long").alias("prompt_idx")).agg(F.count("*").alias("n"))


@query("resume_antijoin", "SELECT doc_id, CAST(k AS INTEGER) AS prompt_idx FROM documents, range(5) AS r(k) WHERE (doc_id * 5 + k) % 3 <> 0")
def resume_antijoin(spark, sf_dir):
    """J-03, L-10: the jobs that are left."""
    jobs = co.pair_grid(read(spark, sf_dir, "documents").select("doc_id"), 5)
    return co.pending(jobs, jobs.where("(doc_id * 5 + prompt_idx) % 3 = 0"), "doc_id", "prompt_idx")


@query("holdout_split", "SELECT doc_id, CAST('0x' || md5('0:' || doc_id)[1:8] AS BIGINT) < CAST(floor(0.1 * 4294967296) AS BIGINT) AS held_out FROM documents")
def holdout_split(spark, sf_dir):
    """L-06 to L-08."""
    return co.holdout(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1)


@query(
    "first_turn_pairs",
    """WITH t AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS human, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id)
SELECT conv_id, human, answer FROM t WHERE len(regexp_extract_all(human, '\\S+')) BETWEEN 5 AND 300 AND len(regexp_extract_all(answer, '\\S+')) BETWEEN 5 AND 300""",
)
def first_turn_pairs(spark, sf_dir):
    """S-07, P-01, P-03."""
    return co.first_turns(read(spark, sf_dir, "conversations"), 5, 300)


@query("labelled_scan", "SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 0) = 1 AND len(regexp_extract_all(text, '\\S+')) BETWEEN 50 AND 400")
def labelled_scan(spark, sf_dir):
    """S-08, P-02."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where((F.coalesce("quality", F.lit(0)) == 1) & co.in_range("text", 50, 400)).select("doc_id", "lang")


@query("corpora_union", "SELECT source_name, count(*) AS n FROM (SELECT 'documents' AS source_name FROM documents UNION ALL SELECT 'benchmark' FROM benchmark UNION ALL SELECT 'conversations' FROM conversations) GROUP BY 1")
def corpora_union(spark, sf_dir):
    """S-12, L-12; unknown names are skipped."""
    loaders = {n: lambda s, n=n: read(s, sf_dir, n).select("text") for n in ("documents", "benchmark", "conversations")}
    return co.registry(spark, loaders, ["documents", "none", "benchmark", "conversations"]).groupBy(F.col("source").alias("source_name")).agg(F.count("*").alias("n"))


_CHUNK_SENTS = "list_filter(list_transform(string_split(regexp_replace(trim(text, ' \n\t\r'), '([.!?])\\s+([A-Z\"])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, ' \n\t\r')), lambda s: s <> '')"


@query(
    "chunker",
    f"""WITH {CORPUS_SQL}, s AS (SELECT doc_id, list_transform({_CHUNK_SENTS}, lambda s: {{'done': CAST([] AS VARCHAR[]), 'held': s, 'n': len(regexp_extract_all(s, '\\S+'))}}) AS parts FROM corpus),
r AS (SELECT doc_id, list_reduce(parts, lambda a, x: CASE WHEN a.n + x.n > 160 AND a.n >= 80 THEN {{'done': list_append(a.done, a.held), 'held': x.held, 'n': x.n}} ELSE {{'done': a.done, 'held': a.held || ' ' || x.held, 'n': a.n + x.n}} END) AS a FROM s WHERE len(parts) > 0),
c AS (SELECT doc_id, CASE WHEN a.n >= 80 THEN list_append(a.done, a.held) ELSE a.done END AS chunks FROM r)
SELECT doc_id, CAST(unnest(range(len(chunks))) AS INTEGER) AS chunk_no, unnest(chunks) AS chunk FROM c""",
)
def chunker(spark, sf_dir):
    """C-01, W-07."""
    return co.chunked(corpus(spark, sf_dir))


# --- logs

_EVENTS = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"


@query("trailing30", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 29 PRECEDING), 6) AS mean FROM events")
def trailing30(spark, sf_dir):
    """W-01."""
    return logs.trailing_mean(read(spark, sf_dir, "events"), "value", "event_type", "ts", ["ts", "event_id"]).select("event_id", r6("mean").alias("mean"))


@query(
    "eta_cost",
    f"WITH {_EVENTS} SELECT event_type, count(*) AS steps, round((max(us) - min(us)) / 1e6 / nullif(count(*) - 1, 0) * 100, 3) AS eta_s, round((max(us) - min(us)) / 1e6 / 3600 * 0.4, 6) AS cost FROM e GROUP BY event_type",
)
def eta_cost(spark, sf_dir):
    """W-02, A-25: time for a hundred more steps at the mean pace, and cost at a rate an hour."""
    p = logs.pace(read(spark, sf_dir, "events"), "event_type", "ts")
    return p.select("event_type", "steps", F.round(logs.remaining(F.lit(100)), 3).alias("eta_s"), r6(logs.rental(F.col("lasted_s"), 0.4)).alias("cost"))


@query("stall_gaps", f"WITH {_EVENTS}, g AS (SELECT *, us / 1e6 - lag(us) OVER (PARTITION BY event_type ORDER BY ts, event_id) / 1e6 AS gap FROM e) SELECT event_type, count(*) FILTER (WHERE gap > 600) AS stalls, round(max(gap), 3) AS longest FROM g GROUP BY event_type")
def stall_gaps(spark, sf_dir):
    """W-08, ST-06."""
    g = logs.gaps(read(spark, sf_dir, "events"), "event_type", "ts", ["ts", "event_id"], 600)
    return g.groupBy("event_type").agg(F.count_if("stalled").alias("stalls"), F.round(F.max("gap_s"), 3).alias("longest"))


_PATH = "CASE event_type WHEN 'view' THEN '/detect' WHEN 'click' THEN '/humanize' WHEN 'purchase' THEN '/sample' ELSE '/health' END"
_K = "coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0)"


@query("cost_by_path", f"SELECT {_PATH} AS path, count(*) AS n, round(sum(CAST(CASE event_type WHEN 'click' THEN {_K} * 0.001 + {_K} * 2 * 0.003 WHEN 'view' THEN 0.003 WHEN 'purchase' THEN {_K} * 0.001 ELSE 0 END AS DOUBLE)), 6) AS cost FROM events GROUP BY 1")
def cost_by_path(spark, sf_dir):
    """A-22."""
    e = read(spark, sf_dir, "events").select(F.expr(_PATH).alias("path"), F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"))
    return e.groupBy("path").agg(F.count("*").alias("n"), r6(F.sum(logs.path_cost(F.col("path"), F.col("k"), F.col("k") * 2))).alias("cost"))


@query(
    "estimates",
    "WITH p AS (SELECT source, least(1 + coalesce(n_chars, 0) // 1000, 16) AS c, least(1 + coalesce(n_chars, 0) // 4000, 8) AS r FROM documents) "
    "SELECT source, count(*) AS n, CAST(sum(c) AS BIGINT) AS candidates, round(CAST(sum(c) * 0.004 AS DOUBLE), 6) AS expected, round(CAST(sum(c * r) * 0.004 AS DOUBLE), 6) AS worst FROM p GROUP BY source",
)
def estimates(spark, sf_dir):
    """A-22, A-23, V-04, P-09: what rewriting every document may cost, with more candidates and rounds for longer ones."""
    size = lambda per, most: F.least(1 + F.floor(F.coalesce("n_chars", F.lit(0)) / per), F.lit(most))
    p = read(spark, sf_dir, "documents").select("source", size(1000, 16).alias("candidates"), size(4000, 8).alias("rounds"))
    e = logs.estimate(F.col("candidates"), F.col("rounds"))
    return p.withColumn("e", e).groupBy("source").agg(F.count("*").alias("n"), F.sum("candidates").cast("long").alias("candidates"), r6(F.sum("e.expected")).alias("expected"), r6(F.sum("e.worst")).alias("worst"))


@query(
    "first_last_steps",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS down FROM events) SELECT event_type, round(avg(value) FILTER (WHERE up <= 5), 6) AS first, round(avg(value) FILTER (WHERE down <= 5), 6) AS last FROM r GROUP BY event_type",
)
def first_last_steps(spark, sf_dir):
    """A-19."""
    return logs.ends(read(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"]).select("event_type", r6("first").alias("first"), r6("last").alias("last"))


@query("step_log", "SELECT date_trunc('day', ts) AS step, round(avg(value), 6) AS mean, round(max(value), 6) AS highest, count(*) FILTER (WHERE event_type = 'error') AS gated, arg_max(event_id, (value, event_id)) AS best FROM events GROUP BY 1")
def step_log(spark, sf_dir):
    """A-18."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").alias("step")).agg(r6(F.avg("value")).alias("mean"), r6(F.max("value")).alias("highest"), F.count_if(F.col("event_type") == "error").alias("gated"), F.max_by("event_id", F.struct("value", "event_id")).alias("best"))


@query("rolling_200", "SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 9) AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 199 PRECEDING)")
def rolling_200(spark, sf_dir):
    """W-09, ST-09."""
    return logs.trailing_mean(read(spark, sf_dir, "events"), "value", "event_type", "ts", ["ts", "event_id"], 200).select("event_id", "n", F.round("mean", 9).alias("mean"))


@query("telemetry_records", f"SELECT {_PATH} AS path, CASE WHEN event_id % 10 = 0 THEN 413 ELSE 200 END AS status, CASE WHEN event_id % 10 = 0 THEN 'http_413' END AS error, count(*) AS n, sum(CASE WHEN event_id % 10 = 0 THEN NULL ELSE {_K} END) AS attempts FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL")
def telemetry_records(spark, sf_dir):
    """ST-03, ST-04."""
    e = read(spark, sf_dir, "events")
    body = F.concat(F.lit('{"attempts":'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")), F.lit("}"))
    t = logs.telemetry(e.select(F.expr(_PATH).alias("path"), F.when(F.col("event_id") % 10 == 0, 413).otherwise(200).alias("status"), body.alias("body")))
    return t.groupBy("path", "status", "error").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query(
    "rate_limiter",
    f"""WITH {_EVENTS}, c AS (SELECT user_id, list({{'seen': [us / 1e6], 'calls': [{{'id': event_id, 'status': 200, 'remaining': 2, 'wait': 0}}]}} ORDER BY us, event_id) AS calls FROM e GROUP BY user_id),
r AS (SELECT user_id, list_reduce(calls, lambda a, x: CASE WHEN len(list_filter(a.seen, lambda t: t >= x.seen[1] - 3600.0)) >= 3
  THEN {{'seen': list_filter(a.seen, lambda t: t >= x.seen[1] - 3600.0), 'calls': list_append(a.calls, {{'id': x.calls[1].id, 'status': 429, 'remaining': 0, 'wait': CAST(greatest(1, trunc(3600.0 - (x.seen[1] - list_filter(a.seen, lambda t: t >= x.seen[1] - 3600.0)[1]))) AS INTEGER)}})}}
  ELSE {{'seen': list_append(list_filter(a.seen, lambda t: t >= x.seen[1] - 3600.0), x.seen[1]), 'calls': list_append(a.calls, {{'id': x.calls[1].id, 'status': 200, 'remaining': CAST(2 - len(list_filter(a.seen, lambda t: t >= x.seen[1] - 3600.0)) AS INTEGER), 'wait': 0}})}} END) AS a FROM c),
u AS (SELECT user_id, unnest(a.calls) AS k FROM r)
SELECT user_id AS key, k.id AS ident, k.status AS status, k.remaining AS remaining, k.wait AS retry_after FROM u""",
)
def rate_limiter(spark, sf_dir):
    """ST-01: three calls an hour by user."""
    return logs.rate_limited(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 3600.0)
