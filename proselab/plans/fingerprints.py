"""Queries over texts and signals, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.functions import text as tx
from proselab.operators import fingerprint as fp
from proselab.plans.seeded import CORPUS_SQL, corpus, quoted

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# RE2 has ASCII word classes: letters beyond ASCII become one, so that its word bounds fall where Unicode's do
def features_of(ctes: str, table: str = "corpus") -> str:
    return (
        ctes
        + """,
base AS (SELECT doc_id, lang, source, text AS body, lower(text) AS low, regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏ]', 'z', 'g') AS az,
  greatest(len(regexp_extract_all(text, '\\S+')), 1) AS wc, regexp_extract_all(lower(text), '[a-z][a-z''-]*') AS tok,
  list_filter(list_transform(string_split(regexp_replace(trim(text, ' \n\t\r'), '([.!?])\\s+([A-Z"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, ' \n\t\r')), lambda s: s <> '') AS sents
  FROM corpus),
feat AS (SELECT *, list_transform(sents, lambda s: len(regexp_extract_all(s, '\\S+'))) AS sw, list_transform(range(1, greatest(len(tok) - 2, 1)), lambda i: array_to_string(tok[i:i+3], ' ')) AS grams FROM base)
""".replace("FROM corpus)", f"FROM {table})")
    )


FEATURES_SQL = features_of(CORPUS_SQL)


def _lg(x, m, s=8):
    return f"1.0 / (1.0 + exp(-{s} * (({x}) - {m})))"


def _per100(x):
    return f"({x}) * 100.0 / wc"


def _counts(column, pieces):
    return " + ".join(f"(length({column}) - length(replace({column}, {quoted(p)}, ''))) // {len(p)}" for p in pieces)


def _hits(pattern, any_case=False):
    return f"len(regexp_extract_all(az, {quoted(('(?i)' if any_case else '') + pattern)}))"


_CV = "(CASE WHEN list_avg(sw) > 0 THEN sqrt(list_avg(list_transform(sw, lambda x: (x - list_avg(sw)) * (x - list_avg(sw))))) / list_avg(sw) ELSE 0 END)"
_C, _E = _hits(lx.CONTRACTED, True), _hits(lx.EXPANDED, True)
_FAV = "len(list_filter(tok, lambda t: t IN (" + ", ".join(map(quoted, lx.FAVOURITES)) + ")))"
_REP = "coalesce(list_sum(list_filter(map_values(list_histogram(grams)), lambda n: n > 1)), 0)"
SIGNAL_SQL = {
    "burstiness": f"CASE WHEN len(sents) < 3 THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - {_CV} / 0.7)) END",
    "stiff_transitions": _lg(_per100(_counts("body", lx.TRANSITIONS)), 0.8),
    "favorite_words": f"CASE WHEN len(tok) = 0 THEN 0.0 ELSE {_lg(f'{_FAV} * 100.0 / len(tok)', 1.0)} END",
    "em_dash_density": _lg(_per100(_counts("body", ["—", "--"])), 0.7),
    "hedging": _lg(_per100(_counts("low", lx.HEDGES)), 0.4),
    "tricolons": _lg(_per100(_hits(lx.TRICOLON)), 0.8),
    "contraction_deficit": f"CASE WHEN {_C} + {_E} < 2 THEN 0.0 ELSE {_E} / ({_C} + {_E}) END",
    "ngram_repetition": f"CASE WHEN len(tok) < 9 THEN 0.0 ELSE least(1.0, {_REP} / (len(tok) - 3) / 0.15) END",
    "type_token": "CASE WHEN len(tok) < 50 THEN 0.5 ELSE greatest(0.0, least(1.0, (0.65 - len(list_distinct(tok)) / len(tok)) / 0.25)) END",
    "sentence_start_uniformity": "CASE WHEN len(sents) < 4 THEN 0.0 ELSE least(1.0, (list_max(map_values(list_histogram(list_transform(sents, lambda s: array_to_string(regexp_extract_all(s, '\\S+')[1:2], ' '))))) - 1) / (len(sents) - 1)) END",
    "abstract_subject": f"CASE WHEN len(sents) < 3 THEN 0.0 ELSE {_lg('len(list_filter(sents, lambda s: ' + ' OR '.join(f'starts_with(lower(s), {quoted(p)})' for p in lx.ABSTRACT_SUBJECTS) + ')) / len(sents)', 0.2, 10)} END",
    "enumeration_shape": _lg(_per100(" + ".join(_hits(p, True) for p in lx.ENUMERATIONS)), 0.7),
    "modality_overload": _lg(_per100(_hits(lx.MODALS, True)), 2.0, 4),
}
_WSUM = sum(w for _, w in lx.WEIGHTS)



def prints_of(features: str) -> str:
    """The CTEs of features, signals and fingerprints."""
    return features + SIGNALS_CTE + PRINTS_CTE


SIGNALS_CTE = ", sig AS (SELECT doc_id, lang, source, body, " + ", ".join(f"{e} AS {n}" for n, e in SIGNAL_SQL.items()) + " FROM feat)"
SIGNALS_SQL = FEATURES_SQL + SIGNALS_CTE
PRINTS_CTE = (
    f", prints AS (SELECT *, ({' + '.join(f'{n} * {w}' for n, w in lx.WEIGHTS)}) / {_WSUM} AS aggregate, list_filter([{', '.join(f'CASE WHEN {n} >= 0.6 THEN {quoted(n)} END' for n, _ in lx.WEIGHTS)}], lambda x: x IS NOT NULL) AS flagged FROM sig)"
)
PRINT_SQL = prints_of(FEATURES_SQL)


def _signal_query(name: str):
    def run(spark, sf_dir):
        return fp.with_features(corpus(spark, sf_dir)).select("doc_id", r6(fp.signals()[name]).alias(name))

    run.__doc__ = f"The signal {name} of every document."
    query(f"sig_{name}", f"WITH {FEATURES_SQL} SELECT doc_id, round({SIGNAL_SQL[name]}, 6) AS {name} FROM feat")(run)


for _name in SIGNAL_SQL:
    _signal_query(_name)


@query(
    "fingerprint",
    f"WITH {PRINT_SQL} SELECT doc_id, {', '.join(f'round({n}, 6) AS {n}' for n, _ in lx.WEIGHTS)}, round(aggregate, 6) AS aggregate, array_to_string(flagged, ',') AS flagged FROM prints",
)
def fingerprint(spark, sf_dir):
    """F-01 to F-15."""
    f = fp.fingerprint(corpus(spark, sf_dir))
    return f.select("doc_id", *(r6(n).alias(n) for n, _ in lx.WEIGHTS), r6("aggregate").alias("aggregate"), F.array_join("flagged", ",").alias("flagged"))


@query(
    "fingerprint_by_source",
    f"WITH {PRINT_SQL} SELECT lang, source, count(*) AS n, round(avg(aggregate), 6) AS mean_aggregate, round(avg(CASE WHEN len(flagged) = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_flag_share FROM prints GROUP BY lang, source",
)
def fingerprint_by_source(spark, sf_dir):
    """Mean aggregate and share without a flag (A-09) by language and source."""
    f = fp.fingerprint(corpus(spark, sf_dir))
    return f.groupBy("lang", "source").agg(F.count("*").alias("n"), r6(F.avg("aggregate")).alias("mean_aggregate"), r6(F.avg((F.size("flagged") == 0).cast("double"))).alias("zero_flag_share"))


@query("flag_histogram", f"WITH {PRINT_SQL} SELECT flag, count(*) AS n FROM (SELECT unnest(flagged) AS flag FROM prints) GROUP BY flag ORDER BY n DESC, flag LIMIT 13")
def flag_histogram(spark, sf_dir):
    """A-08, L-05: the most frequent flags; thirteen is the report's length."""
    # the outer form: for the other one Spark tests each text's flags before the scan's projection, with no name for any of their parts
    f = fp.fingerprint(corpus(spark, sf_dir)).select(F.explode_outer("flagged").alias("flag")).where("flag is not null")
    return f.groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "flag").limit(13)


_LINES = " || ".join(f"chr(10) || '  ' || printf('%.2f', round({n}, 6)) || ' ' || rpad(repeat('█', CAST(floor(round({n}, 6) * 20) AS BIGINT)), 20, ' ') || {quoted('  ' + lx.SIGNAL_NOTES[n])}" for n, _ in lx.WEIGHTS)


@query(
    "fingerprint_report",
    f"WITH {PRINT_SQL} SELECT doc_id, 'Aggregate AI-likeness: ' || printf('%.2f', round(aggregate, 6)) || {_LINES} || CASE WHEN len(flagged) > 0 THEN chr(10) || 'Flagged: ' || array_to_string(flagged, ', ') ELSE '' END AS report FROM prints",
)
def fingerprint_report(spark, sf_dir):
    """F-16, T-24: the whole report."""
    f = fp.fingerprint(corpus(spark, sf_dir))
    return fp.explain(f.withColumns({n: r6(n) for n in (*(n for n, _ in lx.WEIGHTS), "aggregate")})).select("doc_id", "report")


_REDUCED_SQL = {
    "burstiness": SIGNAL_SQL["burstiness"],
    "stiff_transitions": _lg(_per100(_counts("body", lx.REDUCED_TRANSITIONS)), 0.8),
    "favorite_words": _lg("len(list_filter(tok, lambda t: t IN (" + ", ".join(map(quoted, lx.REDUCED_FAVOURITES)) + "))) * 100.0 / greatest(len(tok), 1)", 1.0),
    "hedging": _lg(_per100(_counts("low", lx.REDUCED_HEDGES)), 0.4),
    "contraction_deficit": "coalesce({e} / nullif({c} + {e}, 0), 0.0)".format(e=_hits(lx.REDUCED_EXPANDED, True), c=_hits(lx.REDUCED_CONTRACTED, True)),
}
#: The weights as the survey gives them, not as the operator has them.
REDUCED_PRINT = "CASE WHEN trim(body, ' \n\t\r') = '' THEN 1.0 ELSE (1.5 * ({burstiness}) + 1.3 * ({stiff_transitions}) + 1.6 * ({favorite_words}) + 1.2 * ({hedging}) + 1.0 * ({contraction_deficit})) / 6.6 END".format(**_REDUCED_SQL)


@query("reduced_fingerprint", f"WITH {FEATURES_SQL} SELECT doc_id, round({REDUCED_PRINT}, 6) AS aggregate FROM feat")
def reduced_fingerprint(spark, sf_dir):
    """F-17."""
    f = fp.with_features(corpus(spark, sf_dir))
    return f.select("doc_id", r6(fp.reduced_aggregate()).alias("aggregate"))


@query(
    "sentence_stats",
    f"WITH {FEATURES_SQL} SELECT doc_id, len(sw) AS n_sentences, round(coalesce(list_avg(sw), 0), 6) AS mean_words, round(coalesce({_CV} * list_avg(sw), 0), 6) AS std_words, round(coalesce({_CV}, 0), 6) AS cv_words, coalesce(list_min(sw), 0) AS min_words, coalesce(list_max(sw), 0) AS max_words FROM feat",
)
def sentence_stats(spark, sf_dir):
    """F-18, B-05."""
    f = fp.sentence_stats(corpus(spark, sf_dir))
    longs = ("n_sentences", "min_words", "max_words")
    return f.select("doc_id", *(F.col(c).cast("long").alias(c) for c in longs), *(r6(c).alias(c) for c in ("mean_words", "std_words", "cv_words")))


@query(
    "token_stats",
    f"WITH {FEATURES_SQL} SELECT doc_id, CAST(wc AS BIGINT) AS words, len(tok) AS tokens, len(list_distinct(tok)) AS types, CASE WHEN len(tok) < 4 THEN 0 ELSE len(grams) END AS four_grams FROM feat",
)
def token_stats(spark, sf_dir):
    """T-03 to T-05, A-21."""
    f = fp.with_features(corpus(spark, sf_dir))
    n = lambda c: F.size(c).cast("long")
    return f.select("doc_id", F.col("wc").cast("long").alias("words"), n("tok").alias("tokens"), n(F.array_distinct("tok")).alias("types"), n(tx.ngrams("tok")).alias("four_grams"))


@query(
    "text_preview",
    f"WITH {CORPUS_SQL} SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview, repeat('█', CAST(floor(doc_id % 10 / 10.0 * 20) AS BIGINT)) AS bar, substr('▁▂▃▄▅▆▇█', CAST(floor(doc_id % 10 / 10.0 * 8) AS BIGINT) + 1, 1) AS spark FROM corpus",
)
def text_preview(spark, sf_dir):
    """T-23, T-24."""
    value = F.pmod("doc_id", F.lit(10)) / 10.0
    return corpus(spark, sf_dir).select("doc_id", tx.preview("text").alias("preview"), tx.bar(value).alias("bar"), tx.sparkline(value).alias("spark"))


@query(
    "prompt_format",
    f"WITH {CORPUS_SQL} SELECT doc_id, 'Rewrite this.' || chr(10) || chr(10) || '---' || chr(10) || text || chr(10) || '---' AS prompt, 3 AS turns, 'system' AS first_role FROM corpus",
)
def prompt_format(spark, sf_dir):
    """T-17, T-18, C-03: fenced prompts and chat turns."""
    prompt = tx.fenced("Rewrite this.", "text")
    turns = tx.chat("Be brief.", prompt, "text")
    return corpus(spark, sf_dir).select("doc_id", prompt.alias("prompt"), F.size(turns).alias("turns"), turns[0]["role"].alias("first_role"))


@query("rates", "SELECT event_id % 50 + 1 AS n, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 60 WHEN 'signup' THEN 3600 ELSE 86400 END AS seconds, count(*) AS uses FROM events GROUP BY ALL")
def rates(spark, sf_dir):
    """T-25: rate limits parsed from their specifications, with spaces and in either case."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    unit = F.when(F.col("event_type") == "view", " / second").when(F.col("event_type") == "click", "/Minute ").when(F.col("event_type") == "signup", "/ hour").otherwise("/DAY")
    rate = tx.rate(F.concat(F.lit(" "), (F.col("event_id") % 50 + 1).cast("string"), unit))
    return e.select(rate.alias("r")).groupBy(F.col("r.n").cast("long").alias("n"), "r.seconds").agg(F.count("*").alias("uses"))


@query("durations", "SELECT l_orderkey, l_linenumber, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS took FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 7) AS BIGINT) AS s FROM lineitem)")
def durations(spark, sf_dir):
    """T-26."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", tx.duration(F.floor(F.col("l_extendedprice") / 7)).alias("took"))
