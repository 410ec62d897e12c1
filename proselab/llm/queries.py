"""The registered queries of this package, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from proselab.llm.common import table


def op5_bpe(spark, sf_dir):
    import public_tokenizers

    from proselab.llm import bpe

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op1_lm_score(spark, sf_dir):
    from proselab.llm import ngram_lm

    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    from proselab.llm import exact_dedup

    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    from proselab.llm import secret_scan

    return secret_scan.report(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    from proselab.llm import mixing

    return mixing.plan(table(spark, sf_dir, "documents")).drop("print")


def op3_pivot_topk(spark, sf_dir):
    from proselab.llm import pivot_search

    return pivot_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_html_text(spark, sf_dir):
    from proselab.llm import html_text

    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_near_dedup(spark, sf_dir):
    from proselab.llm import near_dedup

    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("print")


def op8_quality(spark, sf_dir):
    from proselab.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs))


def op9_repeats(spark, sf_dir):
    from proselab.llm import repeats

    return repeats.remove(table(spark, sf_dir, "documents"), digest=True)


def op11_filter_audit(spark, sf_dir):
    from proselab.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroids(spark, sf_dir):
    from proselab.llm import centroids

    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark, sf_dir):
    from proselab.llm import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '\\S+'))) AS BIGINT) AS n_tokens
  FROM documents GROUP BY ALL),
sources AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n FROM units GROUP BY source),
-- largest / smallest to the power of 1 - x is the repetition of the smallest source
e AS (SELECT max(n) AS most, CASE WHEN max(n) = min(n) THEN 0 ELSE greatest(0, ceil(10000 * (1 - ln(1.5) / ln(max(n) / min(n)))) / 10000) END AS x FROM sources WHERE n > 0),
shares AS (SELECT source, n, CASE WHEN n > 0 THEN CAST(round(n * pow(most / n, 1 - x)) AS BIGINT) ELSE 0 END AS budget FROM sources, e),
parts AS (SELECT source, n, CASE WHEN n > 0 THEN budget // n ELSE 1 END AS passes, CASE WHEN n > 0 THEN budget % n ELSE 0 END AS rest FROM shares),
whole AS (SELECT u.doc_id, u.source, u.n_tokens, unnest(range(passes)) AS epoch FROM units u JOIN parts p USING (source)),
part AS (
  SELECT u.doc_id, u.source, u.n_tokens, p.passes AS epoch, p.rest, sum(u.n_tokens) OVER (PARTITION BY source ORDER BY md5('0:' || passes || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM units u JOIN parts p USING (source) WHERE p.rest > 0),
taken AS (SELECT doc_id, source, n_tokens, epoch FROM whole UNION ALL SELECT doc_id, source, n_tokens, epoch FROM part WHERE upto <= rest)
SELECT doc_id, source, n_tokens, epoch, md5('0:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
       CAST(('0x' || md5('0:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:3]) AS INTEGER) AS block
FROM taken
"""

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


#: Similarities of all documents that share a run of five words, and the closure of the links.
OP7_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM t),
b AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL),
total AS (SELECT doc_id, sum(n) AS n FROM b GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS c FROM b x JOIN b y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
linked AS (
  SELECT c.a, c.b FROM common c JOIN total x ON x.doc_id = c.a JOIN total y ON y.doc_id = c.b WHERE c.c / CAST(x.n + y.n - c.c AS DOUBLE) >= 0.8
  UNION ALL SELECT (SELECT min(doc_id) FROM t WHERE len(w) = 0) AS a, doc_id AS b FROM t WHERE len(w) = 0),
ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, ways.b FROM reach r JOIN ways ON ways.a = r.other),
class AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM class
"""

#: Every string of fifty bytes, as hexadecimal digits, with the smallest document that has it.
OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS before FROM w JOIN m USING (s) WHERE m.first < w.doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY ALL),
gone AS (SELECT doc_id, list(a ORDER BY a) AS aa, list(b ORDER BY a) AS bb, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN aa IS NULL THEN h ELSE array_to_string(list_transform(range(len(aa) + 1), lambda j: substr(h, 2 * CASE WHEN j = 0 THEN 0 ELSE bb[j] END + 1, 2 * (CASE WHEN j = len(aa) THEN len(h) // 2 ELSE aa[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE bb[j] END))), '') END AS k
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept
"""


def _op10_sql() -> str:
    from proselab.llm.secret_scan import BASE, RULES

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(RULES):
        p = quote(r.pattern)
        parts.append(f"""
SELECT blob, start + 0 AS start, {k} AS ord, '{r.kind}' AS kind, start + len AS stop FROM (
  SELECT blob, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i-1]), 0))) AS start,
         unnest(lens) AS len, unnest(own) AS own
  FROM (SELECT blob, m, list_transform(string_split_regex(text, {p}), lambda g: length(g)) AS gaps, list_transform(m, lambda g: length(g)) AS lens,
               list_transform(regexp_extract_all(text, {p}, {r.group}), lambda g: length(g)) AS own
        FROM (SELECT blob, text, regexp_extract_all(text, {p}) AS m FROM blobs WHERE regexp_matches(text, {p})))
) WHERE own >= {r.least}""")
    listed = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE {where}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH blobs AS (SELECT DISTINCT sha256(coalesce(text, '')) AS blob, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(parts)}),
by_blob AS (SELECT blob, {counts}, {listed(f'ord < {len(BASE)}')} AS base, {listed('ord >= 0')} AS spans FROM found GROUP BY blob)
SELECT d.doc_id, {', '.join(f'coalesce(b.n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(b.base, '')) AS base_sha256, coalesce(b.spans, '') AS spans
FROM documents d LEFT JOIN by_blob b ON sha256(coalesce(d.text, '')) = b.blob
"""


#: Every document against every prefix of every order.
OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
orders(o) AS (SELECT '' UNION ALL SELECT o || k FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k) WHERE NOT contains(o, k)),
steps AS (SELECT o, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders WHERE length(o) = 5),
s AS (SELECT o, step, o[step] AS k, o[1:step - 1] AS before FROM steps),
x AS (SELECT f.*, s.*, contains(fails, k) AS here, length(translate(fails, before, '')) < length(fails) AS gone FROM f, s),
c AS (
  SELECT part, o AS filter_order, step, k, count(*) FILTER (WHERE NOT gone AND NOT here) AS kept, count(*) FILTER (WHERE here AND NOT gone) AS removed,
         count(*) FILTER (WHERE here AND gone) AS redundant, count(*) FILTER (WHERE fails = k) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE here AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE here AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM c
"""


def _op12_sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """Every vector against every centroid, round by round."""
    d = "list_sum(list_transform(range(1, {0} + 1), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))".format(size)
    ctes = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, q FROM v ORDER BY cluster LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"a{r} AS MATERIALIZED (SELECT row, vec_id, q, near.cluster AS cluster, near.d AS distance FROM (SELECT v.row, v.vec_id, v.q, min({{'d': CAST({d} AS BIGINT), 'cluster': c.cluster}}) AS near FROM v, c{r} c GROUP BY ALL))"
        )
        if r < rounds:
            ctes.append(f"""m{r} AS (SELECT cluster, list(CAST(floor(s / CAST(n AS DOUBLE)) AS BIGINT) ORDER BY pos) AS q FROM
  (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range({size})) AS pos FROM a{r}) GROUP BY ALL) GROUP BY cluster)""")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    return f"""{", ".join(ctes)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)
"""


def _op13_sql() -> str:
    """Rules by string functions, globs as regular expressions, one test a rule."""
    from proselab.llm.url_filter import GLOBS, SITES

    def regex(glob: str) -> str:
        return "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t) or re.escape(t) for t in re.findall(r"\*+|[^*]", glob))

    by_site = "".join(
        f" WHEN (host = '{s.host}' OR ends_with(host, '.{s.host}')) AND starts_with(path, '{s.path}') THEN {{'rule': '{s.name}', 'verdict': '{s.verdict}'}}"
        for s in sorted(SITES, key=lambda s: -len(s.name))
    )
    by_glob = "".join(f" WHEN regexp_full_match(host || path, '(?s:{regex(g.glob)})') THEN {{'glob': '{g.glob}', 'verdict': '{g.verdict}'}}" for g in GLOBS)
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
j AS (SELECT *, CASE{by_site} END AS s, CASE{by_glob} END AS g FROM u)
SELECT page_id, host, path, s.rule AS rule, coalesce(s.verdict, g.verdict, 'allow') AS verdict, g.glob AS glob FROM j
"""


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_mixing": op2_mixing,
    "op3_pivot_topk": op3_pivot_topk,
    "op4_html_text": op4_html_text,
    "op5_bpe": op5_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality": op8_quality,
    "op9_repeats": op9_repeats,
    "op10_secret_scan": op10_secret_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_centroids": op12_centroids,
    "op13_url_filter": op13_url_filter,
}
SQL = {"op2_mixing": OP2_SQL, "op3_pivot_topk": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op7_near_dedup": OP7_SQL, "op9_repeats": OP9_SQL, "op10_secret_scan": _op10_sql(), "op11_filter_audit": OP11_SQL, "op12_centroids": _op12_sql(), "op13_url_filter": _op13_sql()}
