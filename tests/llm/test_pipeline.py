"""The pipeline's stages on a small table, each against what it should keep."""

import collections
import hashlib
import math
import re
import struct

import numpy as np
import pytest

import corpus_pipeline as cp


def prose(k, n=60):
    """Texts of different k have hardly a run of five words in common."""
    rng = np.random.default_rng(1000 + k)
    letters = [["aeiou", "bcdfghklmnprst"][i % 2] for i in range(8)]
    words = ["".join(rng.choice(list(x)) for x in letters[: rng.integers(3, 9)]) for _ in range(n)]
    return " ".join(w + "." * (i % 9 == 8) for i, w in enumerate(words)) + "."


def test_pipeline(spark, tmp_path):
    data = [(i, prose(i), "en", f"s{i % 4 // 3}", 1) for i in range(60)]
    data += [(100, prose(3), "en", "s0", 1), (101, prose(5) + " tail", "en", "s0", 1)]
    data += [(200 + i, " ".join(["BUY!! NOW!! CHEAP!!"] * 30), "en", "s1", 1) for i in range(12)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        left.append({r.doc_id for r in docs.collect()})
    clean = {i for i, *_ in data if i < 200}
    assert left[0] == clean
    assert left[1] == clean - {3}
    assert 101 not in left[2] and left[2] == left[1] - {101}
    assert left[3] == left[2] == left[4]
    assert "n_tokens" in docs.columns
    assert cp.run(spark, str(tmp_path)).count() == docs.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _sha string, _print string, `row` int, print string, `digest of the pipeline` int"


def odd_rows():
    texts = [prose(k) for k in range(6)]
    data = [(k, texts[k], "en", "s", 1) for k in range(6)]
    data += [(k, texts[k], "en", "s", 1) for k in (2, 2, 3)] + [(20, texts[2], "en", None, None), (None, texts[4], None, "s", 1), (None, texts[4], None, "s", 1)]
    data += [(30, None, "en", "s", 1), (31, "", None, None, None), (31, "", None, None, None), (None, None, None, None, None), (40, texts[5] + " tail", "en", "t", 1), (41, prose(9, 20_000), "en", "t", 1)]
    return [(*r, "a", "b", "c", k, "d", 7) for k, r in enumerate(data)]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns with names that clash."""
    data = odd_rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(2)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    key = lambda x: (x is not None, x or 0)
    groups = {}
    for r in data:
        groups.setdefault(r[1] or "", []).append(r[0])
    for name, stage in cp.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    kept = cp.exact(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text or "") for r in kept), key=repr) == sorted(((max(ids, key=key), t) for t, ids in groups.items()), key=repr)
    kept = cp.near(spark, docs, str(tmp_path)).collect()
    tail = prose(5) + " tail"
    want = [(min(ids + (groups[tail] if t == prose(5) else []), key=key), t) for t, ids in groups.items() if t != tail]
    assert sorted(((r.doc_id, r.text or "") for r in kept), key=repr) == sorted(want, key=repr)
    assert {(r.doc_id, r.text) for r in cp.mixed(spark, docs, str(tmp_path)).collect()} == {(r[0], r[1]) for r in data}
    assert all((r.text or "").strip() for r in cp.quality_classifier(spark, docs, str(tmp_path)).collect())
    assert cp.encoded(spark, docs, str(tmp_path)).count() == len(data)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def near_classes(data):
    """The smallest id of each text's class, by comparing all pairs."""
    bags = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) for w in (t.lower().split() for _, t in data)]
    top = list(range(len(data)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            every = sum((bags[a] | bags[b]).values())
            if sum((bags[a] & bags[b]).values()) / every >= 0.8:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(data):
        low[find(k)] = min(i, low.get(find(k), i))
    return {low[find(k)] for k in range(len(data))}


def mixed_ids(docs, limit=1.5):
    """doc_ids as often as the mix takes them; docs are (doc_id, text, source)."""
    n, by = collections.Counter(), collections.defaultdict(list)
    for i, t, s in docs:
        k = len(re.findall(r"\S+", t, re.ASCII))
        n[s] += k
        by[s].append((i, k))
    most, least = max(n.values()), min(c for c in n.values() if c)
    x = next(k / 10_000 for k in range(10_001) if k == 10_000 or (most / least) ** (1 - k / 10_000) <= limit)
    out = []
    for s, rows in by.items():
        budget = math.floor(n[s] * (most / n[s]) ** (1 - x) + 0.5) if n[s] else 0
        passes = budget // n[s] if n[s] else 1
        rest, upto = budget - passes * n[s], 0
        out += [i for i, _ in rows] * passes
        for _, k, i in sorted((hashlib.md5(f"0:{passes}:{i}".encode()).hexdigest(), k, i) for i, k in rows):
            upto += k
            if rest > 0 and upto <= rest:
                out.append(i)
    return out


def test_pipeline_by_a_plain_program(spark):
    """The whole run against loops over the documents; only the trained classifier is the operator's own."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from proselab.llm import bpe, quality

    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(df)
    docs = {r.doc_id: (r.text or "", r.source or "") for r in df.collect()}
    good = {i: t for i, (t, _) in docs.items() if model.score(t) >= 0.5}
    last = {}
    for i, t in good.items():
        last[t] = max(i, last.get(t, i))
    left = near_classes(sorted((i, t) for t, i in last.items()))
    enc = bpe._encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = []
    for i in mixed_ids([(i, *docs[i]) for i in left]):
        ids = enc.encode_ordinary(docs[i][0])
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(docs[i][0].encode()).hexdigest()))
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(want)
    assert len(left) < len(last) < len(docs)
