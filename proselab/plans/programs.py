"""Queries over operators that go in rounds, over spans or over fitted counts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.functions import text as tx
from proselab.operators import fingerprint as fp
from proselab.operators import alignment, batches, frontier, jobs, spans
from proselab.operators import perplexity as px
from proselab.operators import rewrite as rw
from proselab.operators import scoring as sc
from proselab.plans import fingerprints as fps
from proselab.plans import services
from proselab.plans.fingerprints import r6
from proselab.plans.seeded import CORPUS_SQL, corpus, perplexity_sql, quoted
from proselab.sources import readers

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# --- Q-04 on demand: rounds that leave out ever fewer sentences

_ROUNDS, _EACH, _THRESHOLD, _EARLY, _FACTS = 4, 4, 0.3, 0.25, 0.4


def evenness(counts):
    """The signal of even sentence lengths, by a list of the sentences' words."""
    return F.round(F.when(F.size(counts) < 3, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - fp.spread(counts) / 0.7))), 9)


def _shared(left):
    """Dice of the distinct tokens of the sentences that stay and of the whole text, which has them all."""
    x = F.size(F.array_distinct(F.flatten(left("tok")))).cast("double")
    return F.coalesce(2 * x / F.nullif(x + F.col("types"), F.lit(0.0)), F.lit(1.0))


def _rounds(spark, sf_dir, docs):
    propose = lambda rows, r: frontier.thinned(rows, r + 2, _EACH, _shared, lambda left: evenness(left("counts")))
    return frontier.rounds_of(docs, propose, readers.folder(spark, "rounds"), _THRESHOLD, _EARLY, facts=_FACTS, rounds=_ROUNDS)


def _sentenced(spark, sf_dir):
    # written: every round reads them again. A sentence's tokens are the same in any text, as sentences are cut at white space
    docs = corpus(spark, sf_dir).select("doc_id", tx.sentences("text").alias("sents"))
    tok = F.transform("sents", lambda s: F.array_distinct(F.transform(tx.tokens(s), lambda w: F.xxhash64(w))))
    docs = docs.withColumns({"tok": tok, "counts": F.transform("sents", tx.word_count)})
    return readers.settled(docs.withColumn("types", F.size(F.array_distinct(F.flatten("tok")))))


_LEFT = "list_filter(sents, lambda s, i: (i - 1 + c) % (r + 2) <> 0)"
_DICE = "CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END"
_ROUNDS_SQL = f"""WITH {fps.FEATURES_SQL},
l AS (SELECT doc_id, CAST(r AS INTEGER) AS round, CAST(c AS INTEGER) AS cand_idx, sents AS every, {_LEFT} AS sents, list_distinct(tok) AS y FROM feat, range({_ROUNDS}) AS a(r), range({_EACH}) AS b(c)),
m AS (SELECT *, list_transform(sents, lambda s: len(regexp_extract_all(s, '\\S+'))) AS sw, list_distinct(regexp_extract_all(lower(array_to_string(sents, ' ')), '[a-z][a-z''-]*')) AS x FROM l),
cand AS (SELECT doc_id, round, cand_idx, array_to_string(sents, ' ') AS output, {_DICE} AS sim, len(sents) / nullif(len(every), 0) AS overlap, round({fps.SIGNAL_SQL['burstiness']}, 9) AS p_ai FROM m),
kept AS (SELECT *, coalesce(min(CASE WHEN p_ai < {_EARLY} THEN cand_idx END) OVER (PARTITION BY doc_id, round), 1000) AS hit FROM cand WHERE sim >= 0.78 AND overlap >= {_FACTS}),
scored AS (SELECT *, row_number() OVER (PARTITION BY doc_id, round ORDER BY CASE WHEN cand_idx = hit THEN 0 ELSE 1 END, p_ai, cand_idx) AS place FROM kept WHERE cand_idx <= hit),
stop AS (SELECT doc_id, min(round) AS sr FROM scored WHERE place = 1 AND p_ai < {_THRESHOLD} GROUP BY doc_id),
tried AS (SELECT c.doc_id, c.round, count(*) AS n FROM cand c LEFT JOIN stop USING (doc_id) WHERE c.round <= coalesce(sr, 1000) GROUP BY ALL),
called AS (SELECT s.doc_id, s.round, count(*) AS n FROM scored s LEFT JOIN stop USING (doc_id) WHERE s.round <= coalesce(sr, 1000) GROUP BY ALL),
best AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY CASE WHEN s.round = sr THEN 0 ELSE 1 END, p_ai, s.round) AS k FROM scored s LEFT JOIN stop USING (doc_id) WHERE place = 1 AND s.round <= coalesce(sr, 1000) AND (p_ai < 1.0 OR s.round = sr))"""


@query(
    "rejection_on_demand",
    f"""{_ROUNDS_SQL} SELECT d.doc_id, stop.sr IS NOT NULL AS passed, CAST(coalesce(stop.sr + 1, {_ROUNDS}) AS INTEGER) AS rounds_used,
  CAST(coalesce((SELECT sum(n) FROM tried t WHERE t.doc_id = d.doc_id), 0) AS BIGINT) AS attempts, CAST(coalesce((SELECT sum(n) FROM called t WHERE t.doc_id = d.doc_id), 0) + CASE WHEN b.doc_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS judge_calls,
  b.round, b.cand_idx, round(b.p_ai, 6) AS p_ai, md5(b.output) AS output FROM documents d LEFT JOIN stop USING (doc_id) LEFT JOIN best b ON b.doc_id = d.doc_id AND b.k = 1""",
)
def rejection_on_demand(spark, sf_dir):
    """Q-04, V-01: every document's rewrite by rejection; a round asks only for documents that have not passed."""
    docs = _sentenced(spark, sf_dir)
    out = frontier.outcome(docs, _rounds(spark, sf_dir, docs), _ROUNDS)
    return out.withColumn("p_ai", r6("p_ai")).withColumn("output", F.md5(F.col("output").cast("binary")))


@query(
    "rejection_rounds",
    f"""{_ROUNDS_SQL}, o AS (SELECT doc_id, CAST(r AS INTEGER) AS round, coalesce(r = sr, false) AS passed FROM documents LEFT JOIN stop USING (doc_id), range({_ROUNDS}) AS a(r) WHERE r <= coalesce(sr, 1000))
SELECT o.round, count(*) AS open, CAST(sum(coalesce(t.n, 0)) AS BIGINT) AS attempts, CAST(sum(coalesce(k.n, 0)) AS BIGINT) AS calls, count(*) FILTER (WHERE passed) AS passed
FROM o LEFT JOIN tried t USING (doc_id, round) LEFT JOIN called k USING (doc_id, round) GROUP BY o.round""",
)
def rejection_rounds(spark, sf_dir):
    """Q-04, A-22: what each round of the same selection asks for."""
    return frontier.costs(_rounds(spark, sf_dir, _sentenced(spark, sf_dir)))


# --- facts as spans

_LETTERS = "[ªµºÀ-ÖØ-öø-ɏ]"


def _matches_sql(rank: int, pattern: str, plain: str = "az") -> str:
    """doc_id, rank, start, stop of every match; gaps and matches alternate."""
    p = quoted(pattern)
    starts = "list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda g: length(g))), 0) AS BIGINT))"
    return f"SELECT doc_id, {rank} AS rank, unnest({starts}) AS start, unnest(list_transform(m, lambda g: length(g))) AS len FROM (SELECT doc_id, string_split_regex({plain}, {p}) AS gaps, regexp_extract_all({plain}, {p}) AS m FROM t WHERE regexp_matches({plain}, {p}))"


_SPANS = " UNION ALL ".join(_matches_sql(k, ("(?i)" if kind != "proper_noun" else "") + p) for k, (kind, p) in enumerate(lx.FACTS))
_CLAIMS = ", ".join(
    ["k0 AS (SELECT * FROM every WHERE rank = 0)"]
    + [f"k{k} AS (SELECT * FROM k{k - 1} UNION ALL SELECT * FROM every e WHERE rank = {k} AND NOT EXISTS (SELECT 1 FROM k{k - 1} c WHERE c.doc_id = e.doc_id AND c.start < e.stop AND e.start < c.stop))" for k in range(1, len(lx.FACTS))]
)
_FACT_SPANS = f"""{CORPUS_SQL}, t AS (SELECT doc_id, text, regexp_replace(text, '{_LETTERS}', '_', 'g') AS az FROM corpus),
every AS MATERIALIZED (SELECT doc_id, rank, start, start + len AS stop FROM ({_SPANS})), {_CLAIMS},
facts AS (SELECT k.doc_id, ([{', '.join(quoted(k) for k, _ in lx.FACTS)}])[rank + 1] AS kind, start, stop, substr(text, start + 1, stop - start) AS found FROM k{len(lx.FACTS) - 1} k JOIN corpus USING (doc_id))"""


@query(
    "fact_spans",
    f"WITH {_FACT_SPANS} SELECT doc_id, kind, start, stop, CASE WHEN kind = 'proper_noun' THEN found ELSE replace(lower(regexp_replace(trim(found, ' \n\t'), '\\s+', ' ', 'g')), ',', '') END AS value FROM facts",
)
def fact_spans(spark, sf_dir):
    """X-01, X-02, J-05: every fact with its place; a match that overlaps a higher kind's is skipped."""
    return spans.facts(corpus(spark, sf_dir).select("doc_id", "text")).drop("row")


@query(
    "plain_paragraphs",
    f"""WITH {_FACT_SPANS}, w AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM corpus),
p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM w),
s AS (SELECT doc_id, CAST(coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start, length(l[i]) AS n FROM p WHERE l[i] <> '')
SELECT doc_id, start, start + n AS stop FROM s WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.doc_id = s.doc_id AND f.start < s.start + s.n AND s.start < f.stop)""",
)
def plain_paragraphs(spark, sf_dir):
    """J-05, X-02: the lines of each text that hold no fact, by an interval anti-join."""
    docs = corpus(spark, sf_dir).select("doc_id", "text")
    lines = spans.matched(docs, [r"[^\n]+"]).select("doc_id", "start", "stop")
    return spans.outside(lines, spans.facts(docs).select("doc_id", "start", "stop"), "doc_id", 512)


# --- perplexity


@query("ngram_perplexity", f"WITH {CORPUS_SQL}, {perplexity_sql('corpus', 'corpus', 'pp')} SELECT doc_id, tokens, round(perplexity, 4) AS perplexity, round(worst, 4) AS worst FROM pp")
def ngram_perplexity(spark, sf_dir):
    """D-13: each document under a model of the others, and its least likely window of 64 tokens."""
    p = px.perplexity(corpus(spark, sf_dir), window=64, stride=32)
    return p.select("doc_id", "tokens", F.round("perplexity", 4).alias("perplexity"), F.round("worst", 4).alias("worst"))


# --- alignment, vocabularies, batches


_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 1), lambda i: ('<' || {0} || '>')[i:i + 2]))"


def _aligned_sql(a: str, b: str, out: str) -> str:
    """CTE ``out`` (doc_id, share): mean over the words of list ``a`` of the best cosine to a word of list ``b`` in table al."""
    return f"""{out}_w AS (SELECT doc_id, word, count(*) AS n, any_value(list_contains(others, word)) AS there FROM (SELECT doc_id, unnest({a}) AS word, {b} AS others FROM al) GROUP BY ALL),
{out}_g AS (SELECT doc_id, word, unnest(g) AS gram, len(g) AS size FROM (SELECT doc_id, word, {_GRAMS.format('word')} AS g FROM {out}_w WHERE NOT there)),
{out}_h AS (SELECT doc_id, o, unnest(g) AS gram, len(g) AS size FROM (SELECT doc_id, o, {_GRAMS.format('o')} AS g FROM (SELECT doc_id, unnest(list_distinct({b})) AS o FROM al))),
{out}_c AS (SELECT doc_id, word, o, count(*) / sqrt(any_value(g.size) * any_value(h.size)) AS alike FROM {out}_g g JOIN {out}_h h USING (doc_id, gram) GROUP BY ALL),
{out}_b AS (SELECT doc_id, word, max(alike) AS alike FROM {out}_c GROUP BY ALL),
{out}_m AS (SELECT doc_id, sum(n * CASE WHEN there THEN 1.0 ELSE coalesce(alike, 0.0) END) AS s FROM {out}_w LEFT JOIN {out}_b USING (doc_id, word) GROUP BY doc_id),
{out} AS (SELECT doc_id, CASE WHEN len({a}) = 0 THEN CASE WHEN len({b}) = 0 THEN 1.0 ELSE 0.0 END ELSE s / len({a}) END AS share FROM al LEFT JOIN {out}_m USING (doc_id))"""


_WORDS = "regexp_extract_all(lower({}), '[a-z][a-z''-]*')"
_PART = "substr(text, CAST(length(text) // 10 AS BIGINT) + 1, length(text))"


@query(
    "word_alignment",
    f"""WITH {CORPUS_SQL}, al AS (SELECT doc_id, {_WORDS.format(_PART)} AS c, {_WORDS.format('text')} AS r FROM corpus), {_aligned_sql('c', 'r', 'p')}, {_aligned_sql('r', 'c', 'q')}
SELECT doc_id, round(p.share, 6) AS precision, round(q.share, 6) AS recall, round(coalesce(2 * p.share * q.share / nullif(p.share + q.share, 0), 0), 6) AS f1 FROM p JOIN q USING (doc_id)""",
)
def word_alignment(spark, sf_dir):
    """D-12: how well each text without its first tenth stands for the whole."""
    c = corpus(spark, sf_dir).select("doc_id", "text", F.expr("substr(text, int(length(text) div 10) + 1)").alias("part"))
    out = alignment.aligned(c, "part", "text")
    return out.select("doc_id", *(r6(x).alias(x) for x in ("precision", "recall", "f1")))


@query("vocabulary_sketch", f"WITH {CORPUS_SQL}, w AS (SELECT lang, unnest({_WORDS.format('text')}) AS word FROM corpus) SELECT lang, count(DISTINCT word) AS types, true AS close FROM w GROUP BY lang")
def vocabulary_sketch(spark, sf_dir):
    """A-21: distinct words by language from sketches of every source, against the exact number."""
    c = corpus(spark, sf_dir).select("lang", "source", "text")
    estimate = fp.distinct_by(fp.vocabularies(c, "lang", "source"), "lang")
    exact = c.select("lang", F.explode(tx.tokens("text")).alias("word")).groupBy("lang").agg(F.countDistinct("word").alias("types"))
    return exact.join(estimate, "lang").select("lang", "types", (F.abs(F.col("estimate") / F.col("types") - 1) <= 0.02).alias("close"))


@query(
    "length_batches",
    f"""WITH {CORPUS_SQL}, n AS (SELECT doc_id, len({_WORDS.format('text')}) AS n FROM corpus), p AS (SELECT *, (row_number() OVER (ORDER BY n, doc_id) - 1) // 32 AS batch FROM n),
m AS (SELECT *, max(n) OVER (PARTITION BY batch) AS width FROM p) SELECT doc_id, CAST(batch AS BIGINT) AS batch, CAST(width AS INTEGER) AS width, CAST(n AS INTEGER) AS learned FROM m""",
)
def length_batches(spark, sf_dir):
    """T-19: batches of 32 texts of like length, each padded to the longest."""
    c = corpus(spark, sf_dir).select("doc_id", F.transform(tx.tokens("text"), lambda w: F.crc32(w.cast("binary"))).alias("ids"))
    p = batches.padded(c, "ids", 32, "doc_id")
    return p.select("doc_id", "batch", F.size("padded").alias("width"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("learned"))


# --- classifiers and strategies


@query(
    "classifier_scores",
    "WITH l AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE) * 4) AS z FROM embeddings) SELECT vec_id, round(exp(z[2] - list_max(z)) / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS p_ai FROM l",
)
def classifier_scores(spark, sf_dir):
    """D-02: a classifier's logits, here three components of each vector, as the chance of its machine-made class."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 4)
    return e.select("vec_id", r6(sc.classified(logits, ["human", "Machine-written", "mixed"])).alias("p_ai"))


@query("classifier_window", f"WITH {CORPUS_SQL} SELECT doc_id, md5(regexp_extract(text, '(?s)^\\s*(?:\\S+\\s+){{0,63}}\\S*')) AS seen, len(regexp_extract_all(text, '\\S+')) > 64 AS cut FROM corpus")
def classifier_window(spark, sf_dir):
    """D-02: what a classifier of 64 words sees of each text."""
    c = corpus(spark, sf_dir)
    return c.select("doc_id", F.md5(tx.first_words("text", 64).cast("binary")).alias("seen"), (tx.word_count("text") > 64).alias("cut"))


_STRATEGIES = {"raw": "text", "lower": "lower(text)", "phrases": services._TRAINED, "contractions": services._FORMS["base_scrub"], "both": services._FORMS["trained_scrub"], "cautious": "CASE WHEN contains(text, '—') THEN NULL ELSE text END", "none": "CAST(NULL AS VARCHAR)"}
_TRIED = f"{CORPUS_SQL}, tried AS (SELECT doc_id, lang, text AS given, unnest([{', '.join(map(quoted, _STRATEGIES))}]) AS source, unnest([{', '.join(_STRATEGIES.values())}]) AS output FROM corpus), var AS (SELECT doc_id, lang, source, coalesce(output, '') AS text FROM tried)"


@query(
    "strategy_benchmark",
    f"""WITH {fps.features_of(_TRIED, 'var')}{services._SCORED}, sim AS (SELECT e.source, e.p_ai, e.p_pattern, t.output IS NULL AS failed, list_distinct(e.tok) AS x, list_distinct(regexp_extract_all(lower(t.given), '[a-z][a-z''-]*')) AS y FROM en e JOIN tried t USING (doc_id, source)),
s AS (SELECT *, {_DICE} AS similarity FROM sim)
SELECT source AS strategy, count(*) AS n, count(*) FILTER (WHERE failed) AS failed, round(avg(p_ai), 6) AS mean_p_ai, round(avg(p_pattern), 6) AS mean_pattern, round(avg(similarity), 6) AS mean_similarity, round({services._RATE.format('p_ai')}, 6) AS asr FROM s GROUP BY source""",
)
def strategy_benchmark(spark, sf_dir):
    """E-02: seven strategies over the same prompts, two of which fail on some or on all."""
    t = F.col("text")
    both = rw.contractions(rw.phrases(t))
    forms = {"raw": t, "lower": F.lower(t), "phrases": rw.phrases(t), "contractions": rw.contractions(t), "both": both, "cautious": F.when(~F.contains(t, F.lit("—")), t), "none": F.lit(None).cast("string")}
    out = jobs.benchmark(corpus(spark, sf_dir).select("text"), {name: (lambda df, x=x: df.withColumn("output", x)) for name, x in forms.items()})
    return out.select("strategy", "n", "failed", *(r6(c).alias(c) for c in ("mean_p_ai", "mean_pattern", "mean_similarity", "asr")))
