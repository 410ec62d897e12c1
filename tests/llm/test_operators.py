"""The operators of proselab.llm against plain programs, on small tables with the odd cases in them."""

import collections
import hashlib
import itertools
import math
import pickle
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proselab.llm import blocks, bpe, centroids, exact_dedup, filter_audit, html_text, mixing, near_dedup, ngram_lm, pivot_search, quality, repeats, secret_scan, url_filter

WORDS = [f"word{i}" for i in range(40)] + ["Été", "naïve", "don't", "3,000", "—"]


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n)) + "."


def rows():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, long and repeated rows."""
    base, passage = prose(1, 120), prose(2, 40)
    near = base.replace("word7", "word8", 1)
    out = [(i, prose(100 + i, 30 + i)) for i in range(20)]
    out += [(20, base), (21, base), (22, near), (23, f"{prose(3, 20)} {passage} {prose(4, 20)}"), (24, f"{prose(5, 9)} {passage}"), (25, None), (26, ""), (27, "   \n"), (28, "one"), (29, "x" * 300)]
    out += [(None, prose(8, 25)), (None, None), (None, base), (35, prose(9, 60_000)), (36, "x" * 200_000), (2, prose(102, 32)), (2, prose(102, 32))]
    out += [(30, "ab" * 100), (31, "ba" * 60), (32, prose(6, 3000)), (33, "日本語 текст é 👍🏽  \n\n tabs\t"), (20, base), (34, 'password = "abcdef1"; token: ab\nAKIA' + "B" * 16 + " " + "0f" * 14)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, f"s{(i or 0) % 3}", "en", 0, "clash", k) for k, (i, t) in enumerate(rows())]
    # names that the operators use inside
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long, `row` string, block long").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def test_bpe(docs, empty):
    path, pattern = vocabulary()
    enc = bpe._encoding(path, pattern)
    want = [(i, t or "", enc.encode_ordinary(t or "")) for i, t in rows()]
    got = [(r.doc_id, bytes(r.decoded).decode(), r.ids) for r in bpe.encode(docs, path, pattern).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    digests = [(i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t, x in want]
    assert sorted(map(repr, digests)) == sorted(repr(tuple(r)) for r in bpe.encode(docs, path, pattern, digest=True).collect())
    assert bpe.encode(empty, path, pattern).count() == 0


@pytest.mark.parametrize("text", ["a  b\n c", "it's  'S x", "\x1c\x85 ²½ª", "café   x", "!!' 's", "  "])
def test_pretokens_encode_alone(text):
    path, pattern = vocabulary()
    enc = bpe._encoding(path, pattern)
    assert [i for w in bpe.pretokens(text, pattern) for i in enc.encode_ordinary(w)] == enc.encode_ordinary(text)


def test_language_model(docs, empty):
    data = [(i, t or "") for i, t in rows()]
    train = collections.Counter()
    for i, t in data:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*t.encode().lower().split(), b" "])
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in data:
        w = [*t.encode().lower().split(), b" "]
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), n, round(base, 5)))
    got = ngram_lm.score(docs).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))) for r in got)
    assert all(r.score < 0 for r in got)
    assert ngram_lm.score(empty).count() == 0


def plain_scores(data, least=1):
    """Deleted interpolation by counters over all tokens, with an expectation-maximisation of its own."""

    def fold(i):
        return -1 if i is None else zlib.crc32(str(i).encode()) % 7

    seqs = [(fold(i), ["<s>", *(t or "").encode().lower().split(), "</s>"]) for i, t in data]

    def counted(kept):
        uni, bi, tri = collections.Counter(), collections.Counter(), collections.Counter()
        for f, w in seqs:
            if f != 2 and (f != 6 or not kept):
                uni.update(w)
                bi.update(zip(w, w[1:]))
                tri.update(zip(w, w[1:], w[2:]))
        n = sum(c for x, c in uni.items() if x != "<s>")
        return uni, bi, tri, n, sum(x != "<s>" for x in uni)

    def tokens(model, w):
        uni, bi, tri, n, v = model
        for k in range(1, len(w)):
            c, pair = uni[w[k - 1]], bi[w[k - 2], w[k - 1]] if k > 1 else 0
            two, one = (bi[w[k - 1], w[k]] / c if c else 0.0), uni[w[k]] / n
            if pair >= least:
                yield 64 + pair.bit_length(), tri[w[k - 2], w[k - 1], w[k]] / pair, two, one
            else:
                yield c.bit_length(), 0.0, two, one

    held = counted(True)
    step = lambda p: 2 ** (round(2 * math.log2(p * (held[4] + 1))) / 2) if p else 0.0
    seen = [(b, *map(step, p), 1.0) for f, w in seqs if f == 6 for b, *p in tokens(held, w)]

    def learn(cells):
        w = [0.25] * 4
        for _ in range(60 if cells else 0):
            new = [0.0] * 4
            for _, *odds in cells:
                total = sum(x * o for x, o in zip(w, odds))
                new = [a + x * o / total for a, x, o in zip(new, w, odds)]
            # one more token for each estimate
            w = [(x + 1) / (len(cells) + 4) for x in new]
        return w

    def weights(bucket, cache={}):
        if bucket not in cache:
            own = [c for c in seen if c[0] == bucket]
            if len(own) < 100 or not bucket:
                own = [c for c in seen if (c[0] >= 64) == (bucket >= 64)]
            w = learn(own)
            if bucket < 64:
                w[0] = 0.0
            if not bucket:
                w[1] = 0.0
            cache[bucket] = [x / sum(w) for x in w]
        return cache[bucket]

    model, out = counted(False), []
    for (i, _), (_, w) in zip(data, seqs):
        out.append((i, sum(math.log10(sum(x * p for x, p in zip(weights(b), (*found, 1 / (model[4] + 1))))) for b, *found in tokens(model, w))))
    return out


@pytest.mark.parametrize("how", [None, (3, 2, 2)])
def test_interpolated_score(spark, monkeypatch, how):
    """Against a plain program, on texts of a grammar whose trigrams matter, in several blocks, directly and by relays."""
    if how:
        monkeypatch.setattr(blocks, "exchange", lambda *_, **__: blocks.Exchange(*how))
    monkeypatch.setattr(ngram_lm, "BLOCK_CHARS", 4000)
    rng, data = np.random.default_rng(12), []
    for i in range(120):
        w = ["a", "b"]
        for _ in range(int(rng.integers(0, 60))):
            w.append(f"{w[-1][0]}{w[-2][0]}{rng.integers(0, 3)}" if rng.random() < 0.8 else str(rng.choice(list("abcdefg"))))
        data.append((i, " ".join(w)))
    data += [(None, data[3][1]), (3, data[3][1]), (500, None), (501, ""), (502, "never seen words")]
    got = ngram_lm.score(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    want = sorted((repr(i), round(x, 4)) for i, x in plain_scores(data))
    assert [a for a, _ in want] == [a for a, _ in sorted((repr(r.doc_id), round(r.score, 4)) for r in got)]
    assert [b for _, b in sorted((repr(r.doc_id), r.score) for r in got)] == pytest.approx([b for _, b in want], abs=2e-4)


def test_weights_sum_to_one():
    import pandas as pd

    none = ngram_lm.NO_ESTIMATE
    w = ngram_lm.learn_weights(pd.DataFrame({"bucket": [3, 3, 70], "tri": [none, none, 9], "bi": [20, none, 8], "uni": [8, 4, none], "n": [500, 300, 20]}))
    assert set(w) == {-1, -2, 3} and all(sum(x) == pytest.approx(1) for x in w.values()) and w[3][0] == pytest.approx(1 / 804)  # its one token more


def test_exact_dedup(docs, empty):
    data = [(i, t or "") for i, t in rows()]
    groups = collections.defaultdict(list)
    for i, t in data:
        groups[t].append(i)
    got = exact_dedup.classes(docs).collect()
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    want = sorted(repr((i, top(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())) for i, t in data)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.classes(empty).count() == 0


def test_chunks_are_the_text(spark):
    text = prose(9, 20_000)
    n = spark.createDataFrame([(1, text)], "doc_id long, text string")
    lens = [c.n for c in exact_dedup.chunked(n).first().chunks]
    assert sum(lens) == len(text) and max(lens) <= exact_dedup.MAX and len(lens) > 10


def by_brute_force(data):
    """The smallest id of each document's class, by comparing all pairs."""
    bags = []
    for _, t in data:
        w = (t or "").lower().split()
        bags.append(collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else collections.Counter())
    top = list(range(len(data)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            common, every = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if bags[a] == bags[b] or (every and common / every >= 0.8):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(data):
        low.setdefault(find(k), []).append(i)
    return [(i, None if None in low[find(k)] else min(low[find(k)])) for k, (i, _) in enumerate(data)], len(low)


def as_keys(pairs):
    return sorted(pairs, key=lambda p: [(x is not None, x or 0) for x in p])


def test_near_dedup(docs, empty):
    want, n = by_brute_force(rows())
    got = near_dedup.classes(docs).collect()
    assert as_keys((r.doc_id, r.class_id) for r in got) == as_keys(want)
    assert sum(r.kept for r in got) == n
    assert near_dedup.classes(empty).count() == 0


@pytest.mark.parametrize("nodes", [512, 16])
def test_near_dedup_of_a_group_of_many_unlinked_copies(spark, monkeypatch, nodes):
    """Copies of one text with so many changes that most pairs share a bucket and few are linked; small cells split it."""
    monkeypatch.setattr(near_dedup, "CELL_NODES", nodes)
    rng, base = np.random.default_rng(7), [f"w{i}" for i in range(150)]
    data = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(1, 9)):
            words[at] = f"x{rng.integers(0, 3)}"
        data.append((i, " ".join(words)))
    want, n = by_brute_force(data)
    got = near_dedup.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert 5 < n < 145 and sorted((r.doc_id, r.class_id) for r in got) == want


def test_overlaps():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(3, 80))) for _ in range(40)]
    doc, shingle, weight = near_dedup.bags(texts, 2)
    packs = [near_dedup.packed(shingle[doc == k], weight[doc == k]) for k in range(40)]
    found = [near_dedup.unpacked(*p) for p in packs]
    words = [collections.Counter(zip(t.split(), t.split()[1:])) for t in texts]
    want = [[sum((a & b).values()) for b in words] for a in words]
    assert near_dedup.cell_overlaps(found, room=300).tolist() == want
    assert near_dedup.star_overlaps(found[3], found[5:]).tolist() == want[3][5:]
    linked = np.array(want) >= 30
    np.fill_diagonal(linked, False)
    tree = near_dedup.spanning(linked)
    assert all(linked[a, b] for a, b in tree) and len({b for _, b in tree}) == len(tree)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(30):
        a = [f"w{i}" for i in rng.integers(0, 500, 120)]
        b = [w if rng.random() > 0.04 else "new" for w in a]
        a += a[:6] * 20
        doc, shingle, weight = near_dedup.bags([" ".join(a), " ".join(b + b[:6] * 9)])
        common = near_dedup.cell_overlaps([(shingle[doc == k], weight[doc == k]) for k in (0, 1)])
        j = common[0, 1] / (common[0, 0] + common[1, 1] - common[0, 1])
        s = near_dedup.signatures(doc, shingle, weight, 2, size=1024)
        off.append(((s[0] == s[1]).mean() - j) / math.sqrt(max(j * (1 - j), 1e-3) / 1024))
    assert abs(np.mean(off)) < 0.6 and np.std(off) < 1.6


def test_repeats(docs, empty):
    data = [(i, (t or "").encode()) for i, t in rows()]
    first, low = {}, lambda i: -1 if i is None else i
    for i, b in sorted(data, key=lambda x: low(x[0])):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], low(i))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < low(i):
                gone[k : k + 50] = True
        edges = np.diff(gone.astype(int), prepend=0, append=0)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = repeats.remove(docs, digest=True).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(map(repr, want))
    assert repeats.remove(empty, digest=True).count() == 0


def test_repeats_spreads_a_phrase_in_many_contexts():
    """One phrase in 20000 contexts: no owner gets much more than the others."""
    rng, parts = np.random.default_rng(4), 64
    phrase = "this very common phrase of forty-one byte"
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts = [noise(40) + phrase + noise(40) for _ in range(20_000)]
    x = blocks.Exchange(parts, 1, 1)
    payload, replies = asked_once(repeats._declare(list(range(len(texts))), texts, x), lambda c: [[repeats._shared(*c[0])]], x)
    sizes = [len(channel[1][1].data) for dest, _, data in repeats._send(payload[blocks.PAYLOAD], replies, x) if dest is not None for channel in blocks._read(data)]
    assert len(sizes) == parts and max(sizes) < 1.5 * np.median(sizes)


def test_repeats_keeps_texts_out_of_the_exchange(docs, monkeypatch):
    """Texts of blocks move to meet answers only; what goes to owners are names and snippets."""
    seen, own = [], blocks.own

    def spied(x, rows, answer):
        seen.append({r.kind for r in rows.select("kind").distinct().collect()})
        return own(x, rows, answer)

    monkeypatch.setattr(blocks, "own", spied)
    assert repeats.remove(docs, digest=True).count() == docs.count()
    assert seen == [{blocks.KEYS}, {blocks.KEYS, repeats.RUNS}]


def asked_once(made, answer, x):
    """A block's own rows and the answers to its messages, without Spark."""
    own, replies = {}, {}
    for dest, kind, data in made:
        if dest is None:
            own[kind] = data
        else:
            got = blocks._read(data)
            replies[-1 - dest] = blocks._message([(np.array([c.sum()]), a) for (c, _), a in zip(got, answer([v for _, v in got]))])
    return own, replies


def test_repeats_of_common_names(docs, spark, monkeypatch):
    """The same result where every shared string goes on its own."""
    plain = sorted(map(tuple, (r for r in repeats.remove(docs.where("doc_id is not null"), digest=True).collect())))
    monkeypatch.setattr(repeats, "COMMON", 0)
    data = [(r.doc_id, r.text or "") for r in docs.where("doc_id is not null").collect()]
    x, out = blocks.Exchange(7, 1, 1), []
    kept, replies = asked_once(repeats._declare(*map(list, zip(*data)), x), lambda c: [[repeats._shared(*c[0])]], x)
    runs, judged = asked_once(repeats._send(kept[blocks.PAYLOAD], replies, x), lambda c: [[repeats._judge(*c[0])]], x)
    for doc_id, b, gone in repeats._marked(kept[blocks.PAYLOAD], runs[repeats.RUNS], judged, x):
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        out.append((doc_id, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(b[~gone].tobytes()).hexdigest()))
    assert sorted(out) == plain and any(r[2] for r in out)


@pytest.mark.parametrize("how", [(256, 1, 1), (5, 4, 3)])
def test_exchange(spark, how):
    """Words counted over all blocks, directly and by relays; no block or relay has more messages than groups or slices."""
    x = blocks.Exchange(*how)
    data = [(i, prose(i % 9, 20 + i % 7)) for i in range(60)] + [(60, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)

    def make(ids, texts):
        words = sorted({w for t in texts for w in t.split()})
        part = np.array([zlib.crc32(w.encode()) % x.parts for w in words], np.int64)
        yield None, blocks.PAYLOAD, pickle.dumps((ids, words, part))
        if len(words):
            n = collections.Counter(w for t in texts for w in t.split())
            yield from blocks.asked(x, [(part, [[w.encode() for w in words], np.array([n[w] for w in words], np.uint32)]), (part[:1], [np.array([7], np.uint64)])])

    def answer(channels):
        (words, n), (sevens,) = channels
        names = [words.data[a : a + k].tobytes() for a, k in zip(words.starts, words.lens)]
        total = collections.Counter()
        for w, k in zip(names, n.tolist()):
            total[w] += k
        return [[np.array([total[w] for w in names], np.int64), blocks.Ragged.from_bytes(names)], [sevens * 2]], [(len(total), sum(total.values()), 0, 0)]

    def done(own, replies):
        import pandas as pd

        ids, words, part = pickle.loads(own[blocks.PAYLOAD])
        if not words:
            return pd.DataFrame({"word": [], "n": []}).astype({"n": "int64"})
        (n, names), (fourteen,) = blocks.answered(x, [part, part[:1]], replies)
        assert [names.data[a : a + k].tobytes().decode() for a, k in zip(names.starts, names.lens)] == words and fourteen.tolist() == [14]
        return pd.DataFrame({"word": words, "n": n})

    rows_ = blocks.own(x, blocks.build(x, df, make, block_chars=300), answer).cache()
    total = collections.Counter(w for _, t in data for w in t.split())
    assert {tuple(r) for r in blocks.finish(rows_, done, "word string, n long").collect()} == set(total.items())
    stats = rows_.where(F.col("kind") == blocks.STATS).agg(F.sum("n1"), F.sum("n2")).first()
    assert tuple(stats) == (len(total), sum(total.values()))
    messages = blocks.build(x, df, make, block_chars=300).where(F.col("kind") == blocks.KEYS).groupBy("block").count().agg(F.max("count")).first()[0]
    assert messages <= x.groups


def test_previous_factors():
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    buf[2000:2600] = buf[100:700]
    starts, docs = np.arange(3900), np.sort(rng.integers(0, 30, 3900))
    seen, want = {}, []
    for s, d in zip(starts, docs):
        w = buf[s : s + 50].tobytes()
        want.append(seen.setdefault(w, d) < d)
    assert repeats.previous_factors(buf, starts, docs).tolist() == want


def base_spans(t):
    base = [(m.start(), 0, "assign", m.end()) for m in re.finditer(secret_scan.BASE[0].pattern, t) if len(m[2]) >= 6]
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(base)


def test_secrets(docs, empty):
    want = []
    for i, t in rows():
        found = base_spans(t or "")
        n = collections.Counter(k for _, _, k, _ in found)
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()))
    got = secret_scan.report(docs).drop("spans").collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert secret_scan.report(empty).count() == 0


def test_secret_ledger_scans_only_new_blobs(docs):
    _, ledger = secret_scan.update_ledger(docs)
    _, again = secret_scan.update_ledger(docs, ledger)
    assert again.count() == ledger.count()
    _, newer = secret_scan.update_ledger(docs, ledger, secret_scan.BASE)
    assert newer.count() == 2 * ledger.count()


def test_secret_ledger_across_versions_of_a_corpus(docs):
    """A report with yesterday's ledger, and with one of other rules, is a report from scratch."""
    part = docs.where("doc_id % 2 = 0")
    want = sorted(map(repr, secret_scan.report(docs).collect()))
    _, ledger = secret_scan.update_ledger(part)
    _, ledger = secret_scan.update_ledger(part, ledger, secret_scan.BASE[:1])
    assert sorted(map(repr, secret_scan.report(docs, ledger).collect())) == want


def test_secrets_in_a_text_with_very_many_matches(spark):
    text = " ".join(f"é token={'ab' * (k % 5)} {'0f' * 13}" for k in range(3000))
    spans = secret_scan.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_spans(text))


def test_too_short_matches_are_consumed(spark):
    df = spark.createDataFrame([(1, 'secret=token": abcdefgh'), (2, "éé token=abcdefg")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.report(df).collect()}
    assert got == {1: "", 2: "assign:3:16"}


def test_mixing(docs, empty):
    plan = mixing.plan(docs, repetition=1.5).collect()
    tokens = collections.Counter()
    for r in docs.select("source", "text").collect():
        tokens[r.source] += len((r.text or "").split())
    taken = collections.Counter()
    for r in plan:
        taken[r.source] += r.n_tokens
    units = {(i, t or "") for i, t in rows()}
    assert {r.doc_id for r in plan if r.epoch == 0} == {i for i, _ in units}
    assert all(n <= taken[s] <= 1.5 * n + 1 for s, n in tokens.items())
    big = max(tokens, key=tokens.get)
    assert taken[big] == tokens[big]
    assert mixing.realise(docs).columns == docs.columns
    held = collections.Counter(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    assert mixing.realise(docs).count() == sum(held[r.doc_id, r.print] for r in plan)
    assert mixing.plan(empty).count() == 0


def test_mixing_to_a_total_and_an_entropy(spark):
    """Budgets by whole passes and a partial one, also of a source without a name and one without tokens."""
    data = [(i, "w " * (1 + i % 7), ["a", "b", None, "a", "a", "a"][i % 6]) for i in range(300)] + [(900, "", "c"), (901, None, "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    n = collections.Counter()
    for _, t, s in data:
        n[s or ""] += len((t or "").split())
    for how in ({"total": 3000, "repetition": 2.0}, {"repetition": None, "entropy": 1.0}):
        taken, largest = collections.Counter(), 0
        plan = mixing.plan(df, **how).collect()
        for r in plan:
            taken[r.source] += r.n_tokens
        x = mixing.exponent(spark.createDataFrame(list(n.items()), "source string, n long"), how["repetition"], how.get("entropy"), how.get("total"))
        z = sum(c**x for c in n.values() if c)
        for s, c in n.items():
            budget = round(how["total"] * c**x / z if "total" in how else c * (max(n.values()) / c) ** (1 - x)) if c else 0
            assert 0 <= budget - taken[s] < 7, (s, budget, taken[s])
        assert {r.doc_id for r in plan if r.source == "c"} == {900, 901}
        if "entropy" in how:
            p = np.array([c**x / z for c in n.values() if c])
            assert -(p * np.log(p)).sum() >= 1.0


def test_mixing_entropy(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, n long")

    def h(x):
        p = np.array([1000.0, 100.0, 10.0]) ** x
        p /= p.sum()
        return float(-(p * np.log(p)).sum())

    x = mixing.exponent(s, None, 0.9, None)
    assert h(x) >= 0.9 > h(x + 2 / mixing.GRID)


def test_pivot_search(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "ANNULUS", 64)
    monkeypatch.setattr(pivot_search, "SLAB", 2)
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)] + [(i, [0.5] * 8) for i in range(600, 900)]
    data += [(900, None), (901, [float("nan")] * 8), (902, [None] + [1.0] * 7), (950, [1.0, 2.0]), (951, [3.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, query string")
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in data if i is not None and i not in (900, 901, 902)}
    want = []
    for q in ok:
        if q % 50 == 0:
            best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = pivot_search.search(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert pivot_search.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_pivot_search_repeated_ids(spark, monkeypatch):
    import duckdb
    import pandas as pd

    from proselab.llm.queries import OP3_SQL

    monkeypatch.setattr(pivot_search, "ANNULUS", 64)
    monkeypatch.setattr(pivot_search, "SLAB", 2)
    rng = np.random.default_rng(5)
    data = [(i % 150, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(600)]
    data += [(200, [2.0] * 6)] * 300 + [(7, [3.0] * 6), (7, [3.0] * 6), (50, [1.0] * 6), (50, [-1.0] * 6)]
    embeddings = pd.DataFrame(data, columns=["vec_id", "embedding"])
    want = duckdb.query(OP3_SQL).fetchall()
    assert len(embeddings) == 904 and len(want) == 20
    got = pivot_search.search(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def nearest(ok, k=5):
    """query_id, rank, vec_id, score by comparing whole numbers of any size, each within the range of long."""
    out = []
    for q, a in ok.items():
        if q % 50 == 0:
            best = sorted((-max(-pivot_search.LONG, min(pivot_search.LONG, sum(x * y for x, y in zip(a, v)))), i) for i, v in ok.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("step", [1.0, 1e5, 3.3e5, 1e7, 1.2e7, 1e8, 1e15])
def test_pivot_search_large_scores(spark, step):
    """Scores from small ones over 2^43, 2^53 and 2^62 to beyond a long; many ties at the end of the range."""
    data = [(i, [step * i, 1.0 - i % 3]) for i in range(150)]
    got = pivot_search.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    ok = {i: [min(pivot_search.LONG, math.floor(256 * x)) for x in v] for i, v in data}
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == nearest(ok)


def test_pivot_search_blocks_and_pieces(spark, monkeypatch):
    """Several blocks of summaries and several tasks a slab give what one gives."""
    for name, value in {"ANNULUS": 8, "SLAB": 2, "SUMMARIES": 7, "BATCHES": 3}.items():
        monkeypatch.setattr(pivot_search, name, value)
    rng = np.random.default_rng(11)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(700)]
    got = pivot_search.search(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == nearest({i: [math.floor(256 * x) for x in v] for i, v in data})


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<div class='post'><h1>T</h1><p>a <b>b</b>c&nbsp;d<p>e<br>f</div><div class=comments><p>no</div>", "T a bc d e f"),
        ("<body><nav><a href=x>m</a></nav><article><p>one</p><script>var a='</p>'</script><aside>x</aside><p>two</article><footer>f</footer>", "one two"),
        ("<article><p>1 < 2 &lt; 3</p><form><input>go</form><!-- c --><p hidden>h</p>", "1 < 2 < 3"),
        ("<div><p>cut off &am", "cut off &am"),
    ],
)
def test_html(html, text):
    assert html_text.extract(html, None) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body style='overflow:hidden'><article><p>one</p><p>two</p></article></body>", "one two"),
        ("<article><div class=box style=\"overflow: hidden; color: red\"><p>one</p></div><p aria-hidden='false'>two</p><p title='a hidden gem'>three</p></article>", "one two three"),
        ("<article><p data-hidden=1>one</p><p data-x=hidden>two</p><p title=\"a 'hidden' b>c\">three</p><p data-class=ad>four</p></article>", "one two three four"),
        ("<article><p>one</p><p hidden>a</p><p HIDDEN=''>b</p><p class=x hidden>c</p><p class='x'hidden>d</p><p id=y\nhidden=hidden>e</p><div class='top ad' style=x>f</div></article>", "one"),
        ("<article><p>one</p><div role='navigation'><p>a</p></div><p class='x' title='role=\"search\"'>two</p><p title='it is hidden>three</p></article>", "one two three"),
    ],
)
def test_html_attributes(html, text):
    assert html_text.extract(html, None) == text


LONG = " ".join(f"body{k}" for k in range(60))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><article><h1>T</h1><p>lead</p><div class=body><p>{LONG}</p></div><p>end</p></article><div class=box><p>x</p></div></body>", f"T lead {LONG} end"),
        (f"<article><section><p>intro</p></section><section><p>{LONG}</p></section><section><p>outro</p></section></article>", f"intro {LONG} outro"),
        (f"<main><h1>T</h1><article><div><p>{LONG}</p></div></article><aside>x</aside></main>", f"T {LONG}"),
        (f"<main><article><p>x</p></article><article><h1>T</h1><div><p>{LONG}</p></div></article></main>", f"T {LONG}"),
        (f"<main><div><p>lead</p></div><div><p>{LONG}</p></div></main>", f"lead {LONG}"),
        (f"<body><div class=page><h1>T</h1><div class=body><p>{LONG}</p></div><p>end</p></div><div class=box><p>x</p></div></body>", f"T {LONG} end"),
        (f"<div><section><p>intro</p></section><section><p>{LONG}</p></section></div>", f"intro {LONG}"),
        (f"<h1>T</h1><div><p>{LONG}</p></div>", f"T {LONG}"),
        (f"<body><div class=story><p>{LONG}</p></div><div class=box><p>x</p></div></body>", LONG),
    ],
)
def test_html_whole_article(html, text):
    assert html_text.extract(html, None) == text


def test_html_empty_winner(spark):
    page = f"<body><article><h1>T</h1><div class=body><p>{LONG}</p></div></article></body>"
    empty = f"<body><article> <br></article><div class=text><p>{LONG}</p></div></body>"
    links = "<body><article></article><a href=x>link</a></body>"
    df = spark.createDataFrame([(i, "http://a.b/x", h) for i, h in enumerate([page, page, page, empty, links])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == {0: f"T {LONG}", 1: f"T {LONG}", 2: f"T {LONG}", 3: LONG, 4: "link"}


def test_html_votes(spark):
    good = "<div class='c1 story'><p>" + "long text here " * 20 + "</p></div><div class=box><p>short</p></div>"
    odd = "<div class='c2 story'><p>tiny</p></div><div class=box><p>" + "words of a long teaser " * 20 + "</p></div>"
    data = [(i, "http://a.b/x", good) for i in range(5)] + [(5, "http://a.b/y", odd), (6, None, None), (7, "http://c.d/", "<main><p>m</p></main>"), (None, "http://a.b/z", good)]
    df = spark.createDataFrame([(*r, "p") for r in data], "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert got[5].text == "tiny" and got[6].text == "" and got[7].text == "m" and len(got) == 9
    assert got[0].text == ("long text here " * 20).strip() and got[0].n_chars == len(got[0].text)
    assert html_text.main_text(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<div class=a>" * 30_000 + "<p>x</p>", "<b>" * 20_000 + "x", "<p>" + "<i>" * 30_000 + "x", "<ul>" + "<li><div>" * 20_000 + "x", "</b>" * 30_000 + "<div>" * 20_000 + "x", "<a href='" * 20_000 + "'>x</a>"],
)
def test_html_deep_pages_take_linear_time(page):
    import time

    began = time.process_time()
    assert html_text.extract(page, None).endswith("x") and html_text.Page(page).root is not None
    assert time.process_time() - began < 5


def test_html_headers_of_articles_stay():
    page = "<body><header>Site</header><article><header><h1>Title</h1></header><p>one</p><nav>x</nav></article></body>"
    assert html_text.extract(page, None) == "Title one"


@pytest.mark.parametrize(("name", "kept"), [("side-by-side", True), ("tag-line", True), ("price_tag", True), ("related-work", True), ("side", False), ("post-tags", False), ("share-buttons", False), ("x related", False), ("alert", False), ("ad", False), ("top-ad-box", False)])
def test_html_names_of_blocks(name, kept):
    page = f"<article><p>one</p><div class='{name}'><p>two</p></div><div id='{name}'><p>three</p></div></article>"
    assert html_text.extract(page, None) == ("one two three" if kept else "one")


def test_html_against_a_plain_program(spark):
    """Votes counted and pages extracted in a loop; repeated pages, ties of votes and pages without a url among them."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").limit(40).collect()
    one, two = ("<div class=%s><p>" % c + "words of text " * 9 + "</p></div>" for c in ("one", "two"))
    data = [tuple(r) for r in pages] + [tuple(pages[0])] * 3 + [(900, "http://t.t/", one), (901, "http://t.t/", two), (902, "http://t.t/", two + "<p>x</p>"), (903, None, one), (904, None, None), (None, "x", two)]
    votes = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0.0]))

    def host(url):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
        return m[1].lower() if m else ""

    for _, url, html in data:
        p = html_text.Page(html or "")
        if p.elected() is not None:
            v = votes[host(url)][p.elected().path]
            v[0], v[1] = v[0] + 1, v[1] + p.score
    best = {h: min(found, key=lambda x: (-found[x][0], -round(found[x][1], 3), x)) for h, found in votes.items()}
    want = [(i, url, html_text.extract(html or "", best.get(host(url)))) for i, url, html in data]
    got = html_text.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert sorted(map(repr, ((r.page_id, r.url, r.text) for r in got))) == sorted(map(repr, want))
    assert all(r.n_chars == len(r.text) for r in got)


def test_quality_sample_is_bounded(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(quality, "train_scorer", lambda rows, target: drawn.append(len(rows)) or (np.zeros(quality.DIMENSIONS), 0.0))
    texts = [prose(k, 30) for k in range(400)]
    ids = {"null": [None] * 400, "one": [7] * 400, "own": list(range(400)), "third": [None if k % 3 == 0 else k for k in range(400)]}
    for column in ids.values():
        quality.train(spark.createDataFrame(list(zip(column, texts)), "doc_id long, text string"), 100)
    assert drawn == [100] * 4
    quality.train(spark.createDataFrame([(None, texts[k % 3]) for k in range(400)], "doc_id long, text string"), 100)
    assert drawn[4:] == [3]


def test_labellers_by_a_plain_program():
    """The expectation-maximisation, document by document."""
    rng, patterns = np.random.default_rng(21), collections.Counter()
    for _ in range(400):
        good = rng.random() < 0.7
        patterns["".join("0" if rng.random() < 0.3 else ("+" if (rng.random() < 0.85) == good else "-") for _ in range(4))] += 1
    docs = sorted(patterns.elements())
    post = [0.1 if d.count("-") > 1 or d.count("+") == 0 else 0.9 for d in docs]
    for _ in range(100):
        weight = [sum(post), len(docs) - sum(post)]
        chance = [[{v: (sum(p if c == 0 else 1 - p for p, d in zip(post, docs) if d[j] == v) + 0.5) / (weight[c] + 1.5) for v in "+-0"} for j in range(4)] for c in (0, 1)]
        prior = (sum(post) + 1) / (len(docs) + 2)
        new = []
        for d in docs:
            a, b = prior * math.prod(chance[0][j][v] for j, v in enumerate(d)), (1 - prior) * math.prod(chance[1][j][v] for j, v in enumerate(d))
            new.append(a / (a + b))
        post = new
    got, table, share = quality.learn_labellers(patterns)
    assert [got[d] for d in docs] == pytest.approx(post, abs=1e-6) and share == pytest.approx(prior, abs=1e-6)
    assert table[0][2][0] == pytest.approx(chance[0][2]["+"], abs=1e-6)


def test_scorer_descends():
    """The scorer's loss on soft labels is below that of the constant share, and repeated rows move nothing."""
    texts = [prose(k, 40) for k in range(40)] + ["BUY NOW !!! " * 9] * 20
    rows_ = [quality.features(t) for t in texts]
    target = np.array([0.9] * 40 + [0.1] * 20)
    weight, bias = quality.train_scorer(rows_, target)
    p = np.array([1 / (1 + np.exp(-(weight[a] * v).sum() - bias)) for a, v in rows_])
    loss = lambda q: -(target * np.log(q) + (1 - target) * np.log(1 - q)).mean()
    assert loss(p) < loss(np.full(60, target.mean())) - 0.2 and len(set(p[40:])) == 1


def test_quality_of_odd_tables(spark):
    schema = "doc_id long, text string, score int, votes string, place long"
    empty = spark.createDataFrame([], schema)
    model = quality.train(empty)
    assert quality.scored(empty, model).count() == 0 and quality.keep(empty, model).columns == empty.columns
    data = [(None, None), (None, ""), (5, prose(1, 40)), (5, prose(1, 40)), (5, prose(2, 40)), (None, prose(3, 30_000)), (6, "!!! " * 200)] * 3
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in data], schema)
    got = quality.scored(df, quality.train(df)).collect()
    assert len(got) == len(data) and sum(r.score == 0 for r in got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id, r.votes].add(round(r.score, 9))
    assert all(len(x) <= 2 for x in by.values())


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs)
    got = quality.scored(docs, model).join(labels, "doc_id").select("kept", "quality").collect()
    right = sum(r.kept == (r.quality == 1) for r in got) / len(got)
    lost = sum(not r.kept for r in got if r.quality == 1) / max(sum(r.quality == 1 for r in got), 1)
    assert right >= 0.97 and lost <= 0.01
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, prose(1, 50), 5)], "doc_id long, text string, score int")
    assert [r.kept for r in quality.scored(odd, model).orderBy("doc_id").collect()] == [True, False, False]
    assert quality.keep(odd, model).columns == odd.columns
    assert quality.scored(odd.where("false"), model).count() == 0


def plain_audit(data, known, names="ABCDE"):
    """(part, order, step) -> counts, one document at a time."""
    first = {}
    for i, t, _ in data:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, part in data:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        said = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        fails.append((part or "", {k for k, v in said.items() if v}, *((any(k[0] == i and k[at] == 1 for k in known) if i is not None else False) for at in (1, 2))))
    out, shares = {}, collections.Counter()
    for order in map("".join, itertools.permutations(names)):
        for step, k in enumerate(order):
            before = set(order[:step])
            for part in {f[0] for f in fails}:
                own = [f for f in fails if f[0] == part]
                gone = [f for f in own if k in f[1] and not f[1] & before]
                out[part, order, step + 1] = [
                    sum(not f[1] & before and k not in f[1] for f in own), len(gone), sum(k in f[1] and bool(f[1] & before) for f in own),
                    sum(f[1] == {k} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone),
                ]
                shares[part, k] += len(gone)
    return {key: (*v, shares[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_filter_audit(spark, docs, empty):
    data = [(i, t, None if k % 5 == 0 else f"l{k % 3}") for k, (i, t) in enumerate(rows())] + [(41, "SHOUT " * 120, ""), (42, "a#b", None), (43, "a#b", "l1"), (43, "a#b", "l1")]
    known = [(20, 1, 0), (21, 0, 1), (21, 1, 0), (2, 1, 1), (43, None, 1), (None, 1, 1), (999, 1, 1)]
    # names that the operator uses inside clash with columns of the input
    frame = spark.createDataFrame([(*d, 0, "x", 1) for d in data], "doc_id long, text string, lang string, mask int, part string, n int").repartition(3)
    labels = spark.createDataFrame([(*k, 5) for k in known], "doc_id long, quality int, toxic int, mask int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(frame, labels).collect()}
    assert got == plain_audit(data, known)
    some = filter_audit.audit(frame, labels.where("false"), orders=["EDCBA"]).collect()
    assert {r.filter_order for r in some} == {"EDCBA"} and all(r.good_lost == r.toxic_lost == 0 for r in some)
    assert filter_audit.audit(frame.where("false"), labels).count() == 0


def plain_means(vectors, k, rounds, seed="2"):
    """Clusters and squared distances of (id, whole numbers), all pairs, in unbounded whole numbers."""
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(vectors, key=lambda x: (name(x[0]), x[1]))[:k]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in vectors]
        if r < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, n) in zip(vectors, near) if n == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    total = sum(d for d, _ in near)
    out = []
    for (i, _), (d, j) in zip(vectors, near):
        digest = hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
        out.append((i, j, *(min(x, 2**63 - 1) for x in (d, sum(e for e, n in near if n == j), total)), digest))
    return sorted(map(repr, out))


def vectors_frame(spark, data):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in data], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)


@pytest.mark.parametrize("scale_up", [1.0, 1e4, 1e14, 1e30])
def test_centroids(spark, scale_up):
    rng = np.random.default_rng(5)
    made = (rng.normal(size=(5, 4))[rng.integers(0, 5, 60)] + 0.1 * rng.normal(size=(60, 4))) * scale_up
    data = [(i, v) for i, v in enumerate(made.tolist())]
    data += [(100, data[3][1]), (101, data[3][1]), (4, data[4][1]), (4, data[5][1]), (None, data[6][1]), (None, data[7][1])]  # ties and repeated ids
    odd = [(200, None), (201, [1.0, 2.0]), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 0.0, 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [])]
    limit = lambda x: max(-(2**63), min(2**63 - 1, math.floor(256 * x)))
    want = plain_means([(i, [limit(x) for x in v]) for i, v in data], 7, 4)
    got = centroids.cluster(vectors_frame(spark, data + odd), k=7, rounds=4, size=4)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_centroids_of_few_and_of_none(spark):
    few = [(i, [float(i % 2), 1.0]) for i in range(3)]
    got = centroids.cluster(vectors_frame(spark, few), k=9, rounds=3, size=2)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_means([(i, [256 * int(x) for x in v]) for i, v in few], 9, 3)
    one = centroids.cluster(vectors_frame(spark, few), k=1, rounds=3, size=2).collect()
    assert {r.cluster for r in one} == {0}
    assert centroids.cluster(vectors_frame(spark, few).where("false"), size=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster(vectors_frame(spark, few).where("false"), size=2).count() == 0


def test_bounds_spare_most_scans(spark):
    rng = np.random.default_rng(6)
    data = [(i, v) for i, v in enumerate((4 * rng.normal(size=(8, 16))[rng.integers(0, 8, 3000)] + 0.2 * rng.normal(size=(3000, 16))).tolist())]
    trace = []
    centroids.cluster(vectors_frame(spark, data), k=8, rounds=6, size=16, trace=trace).count()
    assert trace[0] == (3000, 3000) and [n for n, _ in trace] == [3000] * 7
    assert sum(s for _, s in trace[1:]) < 0.3 * 3000 * 6


def test_url_filter(spark):
    hosts = ["example.com", "www.example.com", "a.www.example.com", "notexample.com", "com", "x.net", "net", "xnet", "big-casino.org", "ads-1.org", "b.ads-1.org", "EXAMPLE.Com", "user@h.net:80", "é.org", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/x", "/fr/1", "/es/", "/big-casino", "/a/login", "/x.exe", "/www.example.com/en/", "/日本/login/", "/a:b"]
    urls = [f"{s}{h}{p}{t}" for s in ("http://", "x://y://", "") for h in hosts for p in paths for t in ("", "?q=/es/", "#/fr/", "?a#b")] + [None, "", "://", "http:/x.net/es/", "http://x.net\n/es/", "h://" + "a" * 30_000 + ".net/es/" + "b" * 9000]
    data = [(i, u, "clash", "rule") for i, u in enumerate(urls)] + [(None, "http://x.net/es/", "", ""), (0, urls[0], "", "")]
    frame = spark.createDataFrame(data, "page_id long, url string, host string, rule string").repartition(3)

    def plain(url):
        after = (url or "").partition("://")[2]
        host = re.split("[/?#]", after)[0]
        path = re.split("[?#]", after[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [s for s in url_filter.SITES if (host == s.host or host.endswith("." + s.host)) and path.startswith(s.path)]
        best = max(fit, key=lambda s: len(s.name), default=None)
        as_regex = lambda g: "".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(t) or re.escape(t) for t in re.findall(r"\*\*|.", g))
        glob = next((g for g in url_filter.GLOBS if re.fullmatch(as_regex(g.glob), host + path)), None)
        return host, path, best and best.name, (best or glob or url_filter.Site("allow", "", "")).verdict, glob and glob.glob

    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.glob) for r in url_filter.judge(frame).collect()]
    assert sorted(map(repr, got)) == sorted(repr((d[0], *plain(d[1]))) for d in data)
    assert len({g[4] for g in got}) == 2 and len({g[3] for g in got}) == 6 and len({g[5] for g in got}) >= 6
    assert url_filter.judge(frame.where("false")).count() == 0


def test_wildcards_over_many_words():
    rng = np.random.default_rng(7)
    sign = lambda n, signs: "".join(rng.choice(list(signs), n))
    globs = ["", "*", "**", "?", "a**b", "*/b", *(sign(int(rng.integers(1, 60)), "ab/?*") for _ in range(60))]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    texts = ["", "é", "/", *(sign(int(rng.integers(0, 12)), "ab/é") for _ in range(400))]
    automaton = url_filter.Automaton(globs)
    assert automaton.words > 5
    want = [[bool(re.fullmatch("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(t) or re.escape(t) for t in re.findall(r"\*\*|.", g)), t)) for g in globs] for t in texts]
    assert (automaton.matches(texts) == np.array(want)).all() and np.array(want).any(0).sum() > 15
    with pytest.raises(ValueError):
        url_filter.judge(None, sites=[url_filter.Site("block", "*.com", "/")])


ONE_TWO = "<h1>Title</h1><p>First paragraph of some length here.</p><p>Second one, as long as that.</p>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        *((f'<div class="{c}">{ONE_TWO}</div>', "Title First paragraph of some length here. Second one, as long as that.") for c in ("site has-sidebar", "no-comments", "nav-open", "sidebar", "page-banner", "wrap menu-collapsed")),
        (f'<div class="has-sidebar"><div class="sidebar"><p>Other words of the side.</p></div>{ONE_TWO}</div>', "Title First paragraph of some length here. Second one, as long as that."),
        (f'<form id="aspnetForm" class="popup">{ONE_TWO}<div class="comments"><p>Me too!</p></div></form>', "Title First paragraph of some length here. Second one, as long as that."),
        ('<p class="a"">He said hello to "everyone" here.</p><p>Second para.</p>', 'He said hello to "everyone" here. Second para.'),
        ("<p title=it's>Hello it is fine and don't worry.</p><p>More.</p>", "Hello it is fine and don't worry. More."),
        ('<p title = "a > b" class=\'c > "d\'>One</p><p data-x=">Two.</p>', "One Two."),
        ("<p>Before.</p><!--><p>After one.</p><!---><p>After two.</p><!-- > --><p>End.</p>", "Before. After one. After two. End."),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Some text of it.</p><div class="comment-header"><p>By me</p></div></article>', "Title Some text of it."),
        ('<article><p>Use the code <span class="promo-code">AB12</span> with <em class="notice">care</em>, <a href="x">now</a>.</p></article>', "Use the code AB12 with care, now."),
        (f'<div class="main">{ONE_TWO}</div><div id="comments"><article><p>{"A comment that is much longer than the article. " * 9}</p></article></div>', "Title First paragraph of some length here. Second one, as long as that."),
    ],
)
def test_html_keeps_the_article(html, text):
    assert html_text.extract(html, None) == text


@pytest.mark.parametrize("seed", range(12))
def test_html_of_pages_made_from_their_text(seed):
    """Pages put together from an article's blocks, which are the answer, and from what surrounds them."""
    rng = np.random.default_rng(seed)
    any_of = lambda *x: x[int(rng.integers(len(x)))]
    said = [prose(1000 * seed + k, int(rng.integers(15, 60))) for k in range(int(rng.integers(2, 7)))]
    escaped = lambda t: t.replace("&", "&amp;").replace("é", "&eacute;").replace("'", "&#39;").replace(" ", any_of(" ", "\n  ", "\t"), 1)
    inside = lambda t: t.replace(" ", any_of(' <b class="ads">', " <em>", ' <span class="notice-x">'), 1).replace("</", "<!-- </p> --></") if any_of(0, 1) else t
    body = "".join(any_of("<p>{}</p>", "<p class=x>{}", '<blockquote title="a>b">{}</blockquote>', "<ul><li>{}</li></ul>").format(inside(escaped(t))) for t in said)
    wrap = any_of("<article>{}</article>", '<main id="c">{}</main>', '<div class="post has-sidebar">{}</div>', '<div class="site nav-open"><article class=p>{}</article></div>')
    around = ['<nav><a href="/">Home</a></nav>', '<div class="sidebar"><p>Short.</p></div>', "<footer><p>All rights.</p></footer>", '<div id=comments><p>Nice one!</p></div>', "<script>var p = '<p>x</p>';</script>", '<aside><p>See too</p></aside>', "<form><p>Name <input></p></form>"]
    cut = int(rng.integers(len(around)))
    html = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(around[:cut]) + wrap.format(body) + "".join(around[cut:]) + "</body></html>"
    assert html_text.extract(html, None) == " ".join(" ".join(said).split())


def test_language_model_of_copies(spark):
    """Held-out words that are all well foretold must not take all the weight: an unknown word stays possible."""
    words = " ".join(f"w{i}" for i in range(300))
    data = [(i, words) for i in range(200)] + [(i, "w1 w2 zzz w10 w11 qqq") for i in range(200, 400) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = ngram_lm.score(spark.createDataFrame(data, "doc_id long, text string")).where("doc_id >= 200").collect()
    assert got and all(math.isfinite(r.score) and r.score > 2 * r.base_score for r in got)
    cells = pd.DataFrame({"bucket": [70, 5], "tri": [12, ngram_lm.NO_ESTIMATE], "bi": [12, 12], "uni": [3, 3], "n": [10**6, 10**6]})
    for w in ngram_lm.learn_weights(cells, rounds=400).values():
        assert min(w) > 0 and sum(w) == pytest.approx(1)


def test_pivot_bounds_spare_comparisons(spark):
    """Vectors in clusters: most pairs are never compared, and the results are those of all pairs."""
    rng = np.random.default_rng(8)
    n, size = 12_000, 24
    made = (6 * rng.normal(size=(60, size)))[rng.integers(0, 60, n)] + 0.15 * rng.normal(size=(n, size))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": made.tolist()}))
    compared = spark.sparkContext.accumulator(0)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in pivot_search.search(frame, F.col("vec_id") % 50 == 0, compared=compared).collect()}
    m = np.floor(256 * made).astype(np.int64)
    for q in range(0, n, 50):
        scores = m @ m[q]
        order = [i for i in np.lexsort((np.arange(n), -scores))[:7].tolist() if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, int(scores[i])) for i in order]
    assert 0 < compared.value < 0.4 * (n // 50) * n
