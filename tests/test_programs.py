"""Spans, perplexity, alignment, sketches, batches and providers against plain programs."""

import collections
import hashlib
import itertools
import math
import re
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.operators import alignment, batches, fingerprint, perplexity, spans
from proselab.plans.seeded import SENTENCES
from proselab.sources import readers

TEXTS = [
    None, "", "no facts", "On March 5, 2021 Anna Berg paid $1,250.50 for 12 tickets, or 15% more than in 1998.", "Hello March 5, 2021 and Dear May 3 of 2020", "12 12 12.5 1,234 2020 EUR 5 USD5", "été 3 Éa Anna\n$5 5%",
    "  12%  ", "x" * 3000 + " 1999 " + "Anna Berg " * 50, "OpenMart IBM 1850 Jan 3, 1999 percent 5 percent", *SENTENCES,
]


def plain_facts(text):
    claimed = []
    for kind, p in lx.FACTS:
        for m in re.finditer(p, text, 0 if kind == "proper_noun" else re.I):
            if not any(m.start() < b and a < m.end() for _, a, b, _ in claimed):
                v = m[0] if kind == "proper_noun" else re.sub(r"\s+", " ", m[0].strip()).lower().replace(",", "")
                claimed.append((kind, m.start(), m.end(), v))
    return claimed


def test_facts_as_spans(spark):
    rows = spark.createDataFrame([(k, t, "row", 1) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "row", 1)], "k long, text string, note string, start2 int").repartition(3)
    got = sorted((r.k, r.kind, r.start, r.stop, r.value) for r in spans.facts(rows).collect())
    want = sorted((k, *f) for k, t in [*enumerate(TEXTS), (3, TEXTS[3])] for f in plain_facts(t or ""))
    assert got == want
    assert spans.facts(rows.where("false")).count() == 0


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_intervals_outside(spark, width):
    rng = np.random.default_rng(width)
    some = lambda n, most: [(None if rng.random() < 0.05 else int(k), int(s), int(s + w), "x") for k, s, w in zip(rng.integers(0, 4, n), rng.integers(-20, 100, n), rng.integers(0, most, n))]
    a, b = some(200, 12), some(40, 9)
    kind = "k long, start long, stop long, `_bin` string"
    got = spans.outside(spark.createDataFrame(a, kind).repartition(3), spark.createDataFrame(b, kind).drop("_bin"), "k", width)
    hit = lambda x, y: x[0] is not None and x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(x) for x in a if not any(hit(x, y) for y in b))
    one = spark.createDataFrame([(0, 4, 2, 6)], "a int, b int, c int, d int")
    assert one.select(spans.overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0] and not one.select(spans.overlap(F.col("a"), F.col("c"), F.col("c"), F.col("d"))).first()[0]


def plain_perplexity(asked, fit, folds, share, window, stride):
    tokens = lambda t: re.findall(r"[a-z][a-z'-]*", (t or "").lower())
    fold = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % folds
    out = []
    for i, text in asked:
        two = collections.Counter(p for j, t in fit if fold(j) != fold(i) for p in zip(["", *tokens(t)], tokens(t)))
        before, word = collections.Counter(), collections.Counter()
        for (h, w), n in two.items():
            before[h] += n
            word[w] += n
        nll = []
        for h, w in zip(["", *tokens(text)], tokens(text)):
            one = (word[w] + 1) / (sum(word.values()) + len(word) + 1)
            nll.append(-math.log(share * two[h, w] / before[h] + (1 - share) * one if before[h] else one))
        slid = [nll[max(0, s + stride - window) : s + stride] for s in range(0, len(nll), stride)]
        out.append((i, len(nll), math.exp(sum(nll) / len(nll)) if nll else math.nan, max((math.exp(sum(x) / len(x)) for x in slid), default=math.nan)))
    return out


def test_perplexity(spark):
    rng = np.random.default_rng(3)
    words = ["the", "old", "mill", "by", "it's", "a-b", "new"]
    data = [(i, " ".join(words[k] for k in rng.integers(0, 7, int(rng.integers(1, 40))))) for i in range(30)] + [(30, None), (31, ""), (32, "zzz zzz unknown"), (None, "the old mill"), (3, "the new")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in data], "doc_id long, text string, n int, word string").repartition(3)
    other = [(i + 100, t) for i, t in data[:12]]
    for fit in (None, other):
        got = perplexity.perplexity(frame, None if fit is None else spark.createDataFrame(fit, "doc_id long, text string"), folds=3, window=8, stride=4).collect()
        want = plain_perplexity(data, data if fit is None else fit, 3, 0.7, 8, 4)
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        for g, w in itertools.zip_longest(sorted(map(tuple, got), key=key), sorted(want, key=key)):
            assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], nan_ok=True)
    assert perplexity.perplexity(frame.where("false"), folds=3).count() == 0


def test_alignment(spark):
    pairs = [("the old mill", "the old mills"), ("", ""), (None, "a b"), ("a b", None), ("cat cat dog", "cat dogs dog"), ("xyz", "abc"), ("running runner the", "runs the the run"), ("a", "a")]
    grams = lambda w: {f"<{w}>"[i : i + 3] for i in range(len(w))}
    cos = lambda x, y: len(grams(x) & grams(y)) / math.sqrt(len(grams(x)) * len(grams(y)))

    def share(a, b):
        return (1.0 if not b else 0.0) if not a else sum(max((cos(x, y) for y in b), default=0.0) for x in a) / len(a)

    got = alignment.aligned(spark.createDataFrame([(k, *p, 1, "s") for k, p in enumerate(pairs)], "k int, a string, b string, side int, word string").repartition(3), "a", "b").collect()
    for r in got:
        a, b = ((x or "").split() for x in pairs[r.k])
        p, q = share(a, b), share(b, a)
        assert (r.precision, r.recall, r.f1) == pytest.approx((p, q, 2 * p * q / (p + q) if p + q else 0.0))
    assert len(got) == len(pairs) and got[0].side == 1


def test_sketches_unite(spark):
    words = [chr(97 + a) + chr(97 + b) + chr(97 + c) for a, b, c in itertools.product(range(26), range(26), range(9))]
    rows = spark.createDataFrame([("x" if k % 3 else "y", k % 5, " ".join(words[k * 7 : k * 7 + 40])) for k in range(860)] + [("x", 9, None), ("y", 9, "")], "lang string, part int, text string")
    parts = fingerprint.vocabularies(rows, "lang", "part")
    exact = {r.lang: r.n for r in rows.select("lang", F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy("lang").agg(F.countDistinct("w").alias("n")).collect()}
    for r in fingerprint.distinct_by(parts, "lang").collect():
        assert abs(r.estimate / exact[r.lang] - 1) < 0.02


def test_padded_batches(spark):
    rng = np.random.default_rng(4)
    data = [(i, list(map(int, rng.integers(1, 99, int(rng.integers(0, 9)))))) for i in range(200)] + [(200, None), (201, [])] + [(i, [7, 7, 7]) for i in range(300, 420)]
    rows = batches.padded(spark.createDataFrame(data, "k long, ids array<int>").repartition(5), "ids", 16, "k").collect()
    order = sorted(((len(t or []), k, t or []) for k, t in data), key=lambda x: x[:2])
    want = {}
    for at in range(0, len(order), 16):
        most = order[min(at + 16, len(order)) - 1][0]
        for n, k, t in order[at : at + 16]:
            want[k] = (at // 16, t + [0] * (most - n), [1] * n + [0] * (most - n))
    assert {r.k: (r.batch, r.padded, r.mask) for r in rows} == want
    assert batches.padded(spark.createDataFrame([], "k long, ids array<int>"), "ids", 16, "k").count() == 0


def test_calls_at_once(spark, tmp_path):
    """At most eight calls of a task are under way; answers, retries and failures are as one after another."""
    log = tmp_path / "log"
    log.mkdir()

    def prepare():
        (log / f"made-{time.monotonic_ns()}").touch()
        return {"now": 0, "most": 0, "lock": threading.Lock(), "tried": set()}

    def call(text, k, held):
        with held["lock"]:
            held["now"] += 1
            held["most"] = max(held["most"], held["now"])
            (log / f"most-{held['most']}").touch()
            again = (text, k) in held["tried"]
            held["tried"].add((text, k))
        try:
            time.sleep(0.02 + 0.001 * (len(text) % 5))
            if text.endswith("bad") or text.endswith("7") and not again:
                raise OSError
            return f"{text}/{k}"
        finally:
            with held["lock"]:
                held["now"] -= 1

    rows = spark.createDataFrame([(i, f"t{i}" + ("bad" if i % 10 == 0 else "")) for i in range(60)], "k int, text string").coalesce(1)
    both = [readers.provided(rows, call, n=2, retries=1, failed="none", prepare=prepare, at_once=n).collect() for n in (1, 8)]
    assert [tuple(r) for r in both[0]] == [tuple(r) for r in both[1]]
    assert sum(r.output == "none" for r in both[1]) == 12
    assert (log / "most-8").exists() and not (log / "most-9").exists()
    assert sum(p.name.startswith("made") for p in log.iterdir()) == 2
