"""Queries over the rewrite stages, each with DuckDB SQL of its own making, and the whole programs put together from it.

In SQL every stage is a step from a table (doc_id, t, n) to the next one; tables of rules are recursions that apply
rule after rule. RE2 has neither look-behind nor back-references, and ASCII word classes, so patterns name what
stands before a match and put it back, or words are taken apart and numbered.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.functions import text as tx
from proselab.operators import fingerprint as fp
from proselab.operators import native as nt
from proselab.operators import rewrite as rw
from proselab.plans import fingerprints as fps
from proselab.plans.fingerprints import r6
from proselab.plans.seeded import CORPUS_SQL, corpus, quoted

QUERIES, SQL = {}, {}

# white space and word signs beyond ASCII, for use inside brackets
_S, _W = r"\t-\r \x{85}\p{Z}", r"\p{L}\p{M}\p{N}_"
S, W = f"[{_S}]", f"[{_W}]"
NOT_S = f"[^{_S}]"
STRIP = f"'^{S}+|{S}+$'"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NOT_S}+'))"


def capital(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


def is_upper(x: str) -> str:
    return f"({x} = upper({x}) AND {x} <> lower({x}))"


def each(t: str, pattern: str, of: str) -> str:
    """Every match m of a pattern becomes ``of``, an expression of m."""
    return f"array_to_string(list_transform(list_zip(string_split_regex({t}, {pattern}), list_append(regexp_extract_all({t}, {pattern}), NULL)), lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE list_transform([z[2]], lambda m: {of})[1] END), '')"


def sentence_case(t: str) -> str:
    """chr(1) stands for the beginning, as RE2 may find ^ again behind each match."""
    return "substr(" + each(f"(chr(1) || {t})", f"'(?:\\x01|[.!?]{S}+)[a-z]'", "upper(m)") + ", 2)"


def sentences(t: str) -> str:
    cut = f"regexp_replace({strip(t)}, '([.!?]){S}+([A-Z\"''(])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


class Steps:
    """A chain of common table expressions with the columns doc_id, t (text), n (edits of the last step) and kept ones."""

    def __init__(self, ctes: str, first: str):
        self.ctes, self.last, self.made = [ctes], first, 0

    def add(self, **columns: str) -> Steps:
        """Replace t and n, and add any other column."""
        new = {c: x for c, x in columns.items() if c not in ("t", "n")}
        put = ", ".join(f"{x} AS {c}" for c, x in columns.items() if c in ("t", "n"))
        return self._then(f"SELECT *{f' REPLACE ({put})' if put else ''}{''.join(f', {x} AS {c}' for c, x in new.items())} FROM {self.last}")

    def drop(self, *columns: str) -> Steps:
        return self._then(f"SELECT * EXCLUDE ({', '.join(columns)}) FROM {self.last}")

    def _then(self, select: str) -> Steps:
        self.made += 1
        name = f"w{self.made}"
        self.ctes.append(f"{name} AS MATERIALIZED ({select})")
        self.last = name
        return self

    def rules(self, table: list[tuple], of: str, edits: str = "len(regexp_extract_all(t, p))", finish: str = "u") -> Steps:
        """Rules (needle, p, r, ...) one after another where their needle is in the text: u becomes ``of``, t ``finish``."""
        self.made += 1
        name, rule = f"w{self.made}", f"r{self.made}"
        value = lambda x: f"[{', '.join(map(quoted, x))}]" if isinstance(x, tuple) else quoted(x)
        rows = ", ".join(f"({k}, {', '.join(map(value, r))})" for k, r in enumerate(table))
        hit = "contains(lower(f.t), r.needle)"
        self.ctes.append(f"{rule}(k, needle, p, r) AS (VALUES {rows})")
        # n counts the edits; rules run on a copy of the documents' texts alone
        self.ctes.append(
            f"f{self.made}(doc_id, t, n, k) AS (SELECT doc_id, t, 0, 0 FROM {self.last} UNION ALL "
            f"SELECT doc_id, CASE WHEN hit THEN {finish} ELSE t END, n + added, k + 1 FROM (SELECT doc_id, t, n, k, hit, CASE WHEN hit THEN {of} END AS u, CASE WHEN hit THEN {edits} ELSE 0 END AS added "
            f"FROM (SELECT f.doc_id, f.t, f.n, f.k, {hit} AS hit, r.p, r.r FROM f{self.made} f JOIN {rule} r ON r.k = f.k)))"
        )
        self.ctes.append(f"{name} AS MATERIALIZED (SELECT w.* REPLACE (f.t AS t, f.n AS n) FROM {self.last} w JOIN f{self.made} f USING (doc_id) WHERE f.k = {len(table)})")
        self.last = name
        return self

    def sql(self, select: str) -> str:
        return f"WITH RECURSIVE {', '.join(self.ctes)} SELECT {select} FROM {self.last}"


def tidy(x: str) -> str:
    return strip(f"regexp_replace({x}, ' {{2,}}', ' ', 'g')")


def drop_transitions(s: Steps) -> Steps:
    # what a sentence starts after is part of the match here, and stays
    at_start = lambda w: f"(?:(\\x01)|([.!?]){S}+){w}{S}+"
    table = [(w.lower(), p, r) for w in lx.DROPPED_CONNECTORS for p, r in ((at_start(w), "\\1\\2 "), (f"\\b{w}{S}+", " "))] + [(w.lower(), at_start(w), "\\1\\2 ") for w in lx.DROPPED_CONCLUDERS]
    s.add(t=tidy("t")).add(t=sentence_case("t"))
    x = "(chr(1) || t)"
    return s.rules(table, tidy(f"substr(regexp_replace({x}, p, r, 'g'), 2)"), f"len(regexp_extract_all({x}, p))", sentence_case("u"))


def _varied(s: Steps, table) -> Steps:
    pick = "r[CAST('0x' || md5('0:' || p || ':' || (i - 2))[1:8] AS BIGINT) % len(r) + 1]"
    return s.rules([(w.lower(), w, v) for w, v in table], f"array_to_string(list_transform(string_split(t, p), lambda x, i: CASE WHEN i = 1 THEN x ELSE {pick} || x END), '')", "len(string_split(t, p)) - 1")


def soften_transitions(s: Steps) -> Steps:
    return _varied(s, lx.SOFTENED)


def _literal(s: Steps, table) -> Steps:
    return s.rules([(a.lower(), f"(?i)\\Q{a}\\E", b) for a, b in table], "regexp_replace(t, p, r, 'g')")


def drop_hedges(s: Steps) -> Steps:
    _literal(s, [(h, "") for h in lx.HEDGES_DROPPED])
    return s.add(t="regexp_replace(t, ' {2,}', ' ', 'g')").add(t=sentence_case("t"))


def swap_phrases(s: Steps) -> Steps:
    return _literal(s, lx.PHRASES)


def _in_case(s: Steps, table) -> Steps:
    form = f"CASE WHEN {is_upper('m')} THEN upper(r) WHEN {is_upper('substr(m, 1, 1)')} THEN {capital('r')} ELSE r END"
    start = "(?:^|(?<=[.!?])\\s+)"
    rules = []
    for p, r in table:
        found = max((x for x in p.replace("\\s+", " ").replace("\\b", " ").replace("(?:^|(?<=[.!?]) )", " ").replace(",?", " ").split("  ")), key=len).strip().lower()
        rules.append((found, "(?i)" + p.replace(start, f"(?:\\x01|[.!?]{S}+)").replace("\\s+", f"{S}+"), r))
    # matches at a sentence's start hold the sign before it, and become that sign and a space
    before = "regexp_extract(m, '^[\\x01.!?]')"
    x = "(chr(1) || t)"
    return s.rules(rules, "substr(" + each(x, "p", f"CASE WHEN {before} <> '' THEN {before} || r ELSE {form} END") + ", 2)", f"len(regexp_extract_all({x}, p))")


def swap_favourites(s: Steps) -> Steps:
    return _in_case(s, lx.FAVOURITE_SWAPS)


def contract(s: Steps) -> Steps:
    return _in_case(s, lx.CONTRACTIONS)


def thin_dashes(s: Steps) -> Steps:
    s.add(parts="string_split(replace(t, '--', '—'), '—')").add(rest=f"list_filter(list_transform(parts[2:], lambda x: {strip('x')}), lambda x: x <> '')")
    starts = f"{is_upper('substr(x, 1, 1)')} AND {words('x')} >= 4"
    whole = f"regexp_replace(regexp_replace(parts[1], '{S}+$', '') || array_to_string(list_transform(rest, lambda x: CASE WHEN {starts} THEN '. ' ELSE ', ' END || x), ''), ',{S}*,', ',', 'g')"
    s.add(n="CASE WHEN len(parts) < 2 THEN 0 ELSE len(rest) END", u=whole)
    return s.add(t=f"CASE WHEN len(parts) < 2 THEN t ELSE {sentence_case('u')} END").drop("parts", "rest", "u")


def break_lists(s: Steps) -> Steps:
    item = f"(?:{S}[{_W}-]+)"
    p = f"'({W}[{_W}-]*{item}{{0,3}}),{S}+([{_W}-]+{item}{{0,3}}),{S}+(and|or){S}+([{_W}-]+{item}{{0,5}})'"
    g = lambda k: f"regexp_extract(m, {p}, {k})"
    return s.add(n=f"len(regexp_extract_all(t, {p}))", t=each("t", p, f"{g(1)} || ' ' || {g(3)} || ' ' || {g(2)} || '. ' || {capital(g(4))}"))


def ended(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[.!?]$') THEN {x} ELSE {x} || '.' END"


def _cut_long(sents: str, most: int) -> str:
    p = f"',{S}+(?:and|but|so|yet|or){S}+'"
    left, right = strip(f"string_split_regex(s, {p})[1]"), strip(f"substr(s, length(string_split_regex(s, {p})[1]) + length(regexp_extract(s, {p})) + 1)")
    cut = f"CASE WHEN {words('s')} > {most} AND regexp_matches(s, {p}) AND {left} <> '' AND {right} <> '' THEN [{ended(left)}, {ended(capital(right))}] ELSE [s] END"
    return f"flatten(list_transform({sents}, lambda s: {cut}))"


def split_long(s: Steps, most: int = 28) -> Steps:
    s.add(sents=sentences("t")).add(parts=_cut_long("sents", most))
    return s.add(n="len(parts) - len(sents)", t="array_to_string(parts, ' ')").drop("sents", "parts")


def merge_short(s: Steps, least: int = 5) -> Steps:
    s.add(sents=sentences("t")).add(short=f"list_transform(sents, lambda s: {words('s')} < {least})")
    s.add(joins="list_transform(short, lambda x, i: i > 1 AND x AND coalesce(short[greatest(i - 1, 1)], false))")
    bare = "regexp_replace(x, '[.!?]+$', '')"
    said = f"CASE WHEN coalesce(joins[i + 1], false) THEN {bare} WHEN joins[i] THEN {bare} || '.' ELSE x END"
    text = f"array_to_string(list_transform(sents, lambda x, i: CASE WHEN i = 1 THEN '' WHEN joins[i] THEN ', ' ELSE ' ' END || {said}), '')"
    return s.add(n="CASE WHEN len(sents) < 3 THEN 0 ELSE len(list_filter(joins, lambda x: x)) END", t=f"CASE WHEN len(sents) < 3 THEN t ELSE {text} END").drop("sents", "short", "joins")


def vary_lengths(s: Steps, least: float = 0.35, tries: int = 4, least_words: int = 4) -> Steps:
    spread = "(CASE WHEN list_sum(c) = 0 THEN 0 ELSE sqrt(list_sum(list_transform(c, lambda x: pow(x - list_avg(c), 2))) / len(c)) / list_avg(c) END)"
    count = f"list_transform(sents, lambda s: {words('s')})"
    s.add(sents=sentences("t"), n="0").add(c=count).add(even=f"len(c) >= 4 AND {spread} < {least}").drop("c")
    seps = [p.replace("\\s+", f"{S}+").replace("(?=", "(?:") for p in lx.CUTS]
    for _ in range(tries):
        s.add(c=count).add(k="list_position(c, list_max(c))").add(x="sents[k]")
        whens = []
        for p, own in zip(seps, lx.CUTS):
            left = f"string_split_regex(x, '{p}')[1]"
            found = f"regexp_extract(x, '{p}')"
            width = f"length(regexp_extract({found}, '^,{S}+'))" if "(?=" in own else f"length({found})"
            right = f"substr(x, length({left}) + {width} + 1)"
            whens.append(f"WHEN regexp_matches(x, '{p}') AND {words(left)} >= {least_words} AND {words(right)} >= {least_words} THEN [{ended(strip(left))}, {ended(capital(strip(right)))}]")
        s.add(pair=f"CASE WHEN NOT even OR NOT coalesce({spread} < {least}, false) THEN NULL {' '.join(whens)} END")
        s.add(n="n + CASE WHEN pair IS NULL THEN 0 ELSE 1 END", more="CASE WHEN pair IS NULL THEN sents ELSE list_concat(list_concat(sents[1:k - 1], pair), sents[k + 1:]) END").drop("c", "k", "x", "pair", "sents").add(sents="more").drop("more")
    return s.add(t="CASE WHEN even THEN array_to_string(sents, ' ') ELSE t END").drop("sents", "even")


def collapse_stems(s: Steps) -> Steps:
    """Of a run of words that each share the beginning of the one before, every second one goes."""
    prev, s.made = s.last, s.made + 1
    k = s.made
    s.ctes += [
        f"a{k} AS (SELECT doc_id, unnest(regexp_extract_all(t, '{W}+')) AS word, unnest(string_split_regex(t, '{W}+')[:-2]) AS gap, unnest(range(len(regexp_extract_all(t, '{W}+')))) AS i FROM {prev})",
        f"b{k} AS (SELECT *, coalesce(regexp_full_match(gap, '{S}+') AND length(word) >= 4 AND lag(length(word)) OVER o >= 4 AND lower(word)[1:4] = lag(lower(word)[1:4]) OVER o, false) AS link FROM a{k} WINDOW o AS (PARTITION BY doc_id ORDER BY i))",
        f"c{k} AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b{k})",
        f"d{k} AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) % 2 = 0 AS gone FROM c{k})",
        f"e{k} AS (SELECT doc_id, string_agg(CASE WHEN gone THEN '' ELSE gap || word END, '' ORDER BY i) AS u, count(*) FILTER (WHERE gone) AS m FROM d{k} GROUP BY doc_id)",
    ]
    return s._then(f"SELECT w.* REPLACE (CASE WHEN e.u IS NULL THEN w.t ELSE e.u || string_split_regex(w.t, '{W}+')[-1] END AS t, coalesce(e.m, 0) AS n) FROM {prev} w LEFT JOIN e{k} e USING (doc_id)")


def closed(s: Steps) -> Steps:
    p = f"'(?i)([^{_W}]|\\x01)(an?)({S}+)([a-z][a-z''-]*)'"
    g = lambda k: f"regexp_extract(m, {p}, {k})"
    word = f"lower({g(4)})"
    vowel = f"CASE WHEN regexp_matches({word}, '^(uni|use|europ|one)') THEN false WHEN regexp_matches({word}, '^hour') OR {word} IN ('honest', 'honor', 'honour', 'honesty') THEN true ELSE {word}[1] IN ('a', 'e', 'i', 'o', 'u') END"
    right = f"CASE WHEN {vowel} THEN 'an' ELSE 'a' END"
    cased = f"CASE WHEN {is_upper(f'substr({g(2)}, 1, 1)')} THEN {capital(f'({right})')} ELSE {right} END"
    s.add(t=tidy("t")).add(t=sentence_case("t"))
    s.add(t="substr(" + each("(chr(1) || t)", p, f"CASE WHEN lower({g(2)}) = ({right}) THEN m ELSE {g(1)} || ({cased}) || {g(3)} || {g(4)} END") + ", 2)")
    return s.add(t=f"regexp_replace(t, '\\.{S}*,{S}*', '. ', 'g')")


MASKED = "'\"[^\"]*\"|“[^”]*”|[\\x{E000}-\\x{F8FF}]'"


def masked(s: Steps) -> Steps:
    return s.add(spans=f"regexp_extract_all(t, {MASKED})", t=f"regexp_replace(t, {MASKED}, chr(57344), 'g')")


def unmasked(s: Steps) -> Steps:
    return s.add(t="array_to_string(list_transform(list_zip(string_split(t, chr(57344)), list_append(spans, '')), lambda z: z[1] || z[2]), '')").drop("spans")


STAGE_SQL = dict(
    zip(
        rw.STAGES,
        (drop_transitions, soften_transitions, drop_hedges, swap_phrases, swap_favourites, contract, thin_dashes, break_lists, split_long, merge_short, vary_lengths, collapse_stems),
    )
)


def start() -> Steps:
    return Steps(f"{CORPUS_SQL}, w0 AS (SELECT doc_id, lang, source, text, text AS t, 0 AS n FROM corpus)", "w0")


def program() -> Steps:
    """The whole scrub program, with the edits of each stage as n_<stage>."""
    s = masked(start())
    for name, stage in STAGE_SQL.items():
        stage(s).add(**{f"n_{name}": "n"})
    return unmasked(closed(s))


_MADE = ", ".join(f"CASE WHEN n_{x} > 0 THEN '\"{x}\":' || n_{x} END" for x in rw.STAGES)
PROGRAM_SQL = program().sql(
    f"doc_id, t AS rewrite, CAST({' + '.join(f'n_{x}' for x in rw.STAGES)} AS INTEGER) AS edits, '{{' || array_to_string(list_filter([{_MADE}], lambda x: x IS NOT NULL), ',') || '}}' AS edits_by_kind, "
    f"round(greatest({words('t')}, 1) / greatest({words('text')}, 1), 6) AS ratio"
)


def _stage_query(name: str, stage):
    def run(spark, sf_dir):
        s = corpus(spark, sf_dir).select("doc_id", stage(F.col("text")).alias("s"))
        return s.select("doc_id", F.md5(F.col("s.text").cast("binary")).alias("rewrite"), F.col("s.edits").alias("edits"))

    run.__doc__ = f"The stage {name} alone."
    query(f"stage_{name}", STAGE_SQL[name](start()).sql("doc_id, md5(t) AS rewrite, CAST(n AS INTEGER) AS edits"))(run)


for _name, _stage in nt.stages().items():
    _stage_query(_name, _stage)


@query("stage_closing", closed(start()).sql("doc_id, md5(t) AS rewrite"))
def stage_closing(spark, sf_dir):
    """R-13, T-10, T-22: spacing, capitals and articles."""
    return corpus(spark, sf_dir).select("doc_id", F.md5(nt.closed(F.col("text")).cast("binary")).alias("rewrite"))


@query("quoted_spans", masked(start()).sql("doc_id, md5(t) AS masked, len(spans) AS n_spans, array_to_string(spans, chr(10)) AS spans"))
def quoted_spans(spark, sf_dir):
    """R-15: what the program does not touch."""
    t = F.col("text")
    return corpus(spark, sf_dir).select("doc_id", F.md5(nt.masked(t).cast("binary")).alias("masked"), F.size(nt.spans(t)).cast("long").alias("n_spans"), F.array_join(nt.spans(t), "\n").alias("spans"))


def _report(s):
    return s.select("doc_id", "rewrite", "edits", F.to_json("edits_by_kind").alias("edits_by_kind"), r6(tx.length_ratio("rewrite", "text")).alias("ratio"))


@query("scrub_native", PROGRAM_SQL)
def scrub_native(spark, sf_dir):
    """R-01 to R-15, T-13 as built-in expressions."""
    return _report(nt.scrubbed(corpus(spark, sf_dir)))


@query("scrub_full", PROGRAM_SQL)
def scrub_full(spark, sf_dir):
    """R-01 to R-15, with length ratio (T-13), in one Arrow function."""
    return _report(rw.scrubbed(corpus(spark, sf_dir)))


def _effect(s):
    # two rows of each text, so that a rewrite is made once
    both = s.select("lang", F.inline(F.array(F.struct(F.lit("before").alias("v"), "text"), F.struct(F.lit("after").alias("v"), F.col("rewrite").alias("text")))))
    return fp.fingerprint(both).groupBy("lang").pivot("v", ["before", "after"]).agg(r6(F.avg("aggregate")))


_BOTH = program()
_BOTH._then(f"SELECT doc_id, lang, 'before' AS source, text FROM {_BOTH.last} UNION ALL SELECT doc_id, lang, 'after' AS source, t AS text FROM {_BOTH.last}")
_EFFECT = "lang, round(avg(aggregate) FILTER (WHERE source = 'before'), 6) AS before, round(avg(aggregate) FILTER (WHERE source = 'after'), 6) AS after"


@query("scrub_effect", f"WITH RECURSIVE {fps.prints_of(fps.features_of(', '.join(_BOTH.ctes), _BOTH.last))} SELECT {_EFFECT} FROM prints GROUP BY lang")
def scrub_effect(spark, sf_dir):
    """A-07 on rewrites: mean aggregate before and after by language."""
    return _effect(rw.scrubbed(corpus(spark, sf_dir)))


# --- the burstiness post-processor


def gathered(s: Steps, most: int = 28, least: int = 6) -> Steps:
    """B-02, B-03: long sentences cut; short ones held, and let go before a long one, at twice ``least`` words or at the end."""
    s.add(sents=sentences("t")).add(parts=_cut_long("sents", most)).add(n="len(parts) - len(sents)")
    prev, s.made = s.last, s.made + 1
    k = s.made
    s.ctes += [
        f"g{k} AS MATERIALIZED (SELECT doc_id, unnest(parts) AS x, unnest(range(1, len(parts) + 1)) AS i FROM {prev})",
        f"h{k} AS MATERIALIZED (SELECT doc_id, i, x, {words('x')} AS c FROM g{k})",
        # grp: the line that a sentence is part of; held: words held after it
        f"""q{k}(doc_id, i, grp, held, short) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM {prev} UNION ALL
  SELECT h.doc_id, h.i, q.grp + CASE WHEN h.c < {least} AND q.held > 0 THEN 0 ELSE 1 END, CASE WHEN h.c < {least} AND q.held + h.c < {2 * least} THEN q.held + h.c ELSE 0 END, h.c < {least} FROM q{k} q JOIN h{k} h ON h.doc_id = q.doc_id AND h.i = q.i + 1)""",
        f"l{k} AS (SELECT doc_id, grp, CASE WHEN bool_or(q.short) THEN string_agg(regexp_replace(h.x, '\\.+$', ''), ' ' ORDER BY i) || '.' ELSE any_value(h.x) END AS line FROM q{k} q JOIN h{k} h USING (doc_id, i) GROUP BY doc_id, grp)",
        f"m{k} AS (SELECT doc_id, string_agg(line, ' ' ORDER BY grp) AS u FROM l{k} GROUP BY doc_id)",
    ]
    return s._then(f"SELECT w.* EXCLUDE (sents, parts) REPLACE (coalesce(m.u, '') AS t) FROM {prev} w LEFT JOIN m{k} m USING (doc_id)")


def plain_contractions(s: Steps) -> Steps:
    return s.rules([(p.replace("\\b", "").lower(), f"(?i){p}", r) for p, r in lx.PLAIN_CONTRACTIONS], "regexp_replace(t, p, r, 'g')")


@query("burst_transitions", _varied(start(), lx.TRANSITION_VARIANTS).sql("doc_id, md5(t) AS rewrite, CAST(n AS INTEGER) AS edits"))
def burst_transitions(spark, sf_dir):
    """B-01."""
    s = corpus(spark, sf_dir).select("doc_id", nt.vary_transitions(F.col("text")).alias("s"))
    return s.select("doc_id", F.md5(F.col("s.text").cast("binary")).alias("rewrite"), F.col("s.edits").alias("edits"))


@query("burst_sentences", gathered(start()).sql("doc_id, md5(t) AS rewrite, CAST(n AS INTEGER) AS edits"))
def burst_sentences(spark, sf_dir):
    """B-02, B-03."""
    s = corpus(spark, sf_dir).select("doc_id", nt.gather_short(F.col("text")).alias("s"))
    return s.select("doc_id", F.md5(F.col("s.text").cast("binary")).alias("rewrite"), F.col("s.edits").alias("edits"))


_BURSTY = plain_contractions(gathered(_varied(start(), lx.TRANSITION_VARIANTS))).sql("doc_id, t AS bursty")


@query("burstiness_native", _BURSTY)
def burstiness_native(spark, sf_dir):
    """B-01 to B-04 as built-in expressions."""
    return nt.postprocessed(corpus(spark, sf_dir)).select("doc_id", "bursty")


@query("burstiness_full", _BURSTY)
def burstiness_full(spark, sf_dir):
    """B-01 to B-04 in one Arrow function."""
    return rw.postprocessed(corpus(spark, sf_dir)).select("doc_id", "bursty")
