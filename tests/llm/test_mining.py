"""Phrases, the positional index and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from check import frames_equal
from pointweave.llm import phrases, postings, runs, words
from pointweave.llm.common import table
from pointweave.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def with_clashes(df):
    """Every column name an operator might want for itself."""
    for name in ("lang", "n", "a", "l", "r", "phrase", "words", "part", "doc", "start", "window", "terms", "id", "runs", "key", "_slice", "_at", "block"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("other"))
    return df.withColumn("bag", F.create_map(F.lit("k"), F.lit(1)))


# words

def test_words_of_a_batch():
    texts = ["Ab c", None, "", "  x\ty ", "ü,é", "\n", "c"]
    found = list(words.cut_words(pa.array(["no", *texts, "no"]).slice(1, len(texts)), words.WHITE, lower=True))
    got = [[] for _ in texts]
    for w in found:
        for doc, word in zip(w.doc.tolist(), w.vocabulary.take(pa.array(w.ids)).to_pylist()):
            got[w.rows.start + doc].append(word)
    assert got == [["ab", "c"], [], [], ["x", "y"], ["ü,é"], [], ["c"]]


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_stretches_do_not_change_the_words(size):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab,. \n") for _ in range(rng.randint(0, 30))) for _ in range(50)]
    flat = [
        (w.rows.start + d, w.vocabulary[int(i)].as_py(), bool(b))
        for w in words.cut_words(pa.array(texts), phrases.BETWEEN, phrases.ENDS, size=size)
        for d, i, b in zip(w.doc.tolist(), w.ids.tolist(), w.breaks.tolist())
    ]
    want = [
        (row, word, at == 0)
        for row, text in enumerate(texts)
        for piece in re.split(r"[.,;:!?\n]", text)
        for at, word in enumerate(re.findall(r"[^ \t]+", piece))
    ]
    assert flat == want


# phrases

def brute_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        n[lang] += 0
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def brute_phrases(rows, threshold, report):
    f, n = brute_counts(rows)
    cand = {key: a for key, a in f.items() if a >= threshold and len(key[1]) > 1}
    out = []
    for (lang, p), a in cand.items():
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(
            lang == other and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in cand.items()
        )
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    rows, rank = [], Counter()
    for lang, score, a, p, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= report:
            rows.append((lang, rank[lang], p.decode(), -a, left, right, total, -score))
    return rows


def test_a_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(5)
    for threshold in (3, 20):
        keys = np.sort(rng.zipf(1.3, 20_000) % 5_000).astype(np.uint64)
        capacity = len(keys) // threshold + 1
        for parts in (1, 7, 60):
            summary = phrases.Summary(capacity)
            for part in np.array_split(rng.permutation(keys), parts):
                summary.add(*phrases.tally(part))
            frequent = {int(k) for k, c in Counter(keys.tolist()).items() if c >= threshold}
            assert frequent <= set(summary.frequent(threshold).tolist())
            assert summary.error < threshold and len(summary.keys) <= capacity


def test_a_full_summary_is_cut_and_stays_right():
    summary = phrases.Summary(10)
    stream = [k for k in range(1000)] + [7] * 150
    random.Random(1).shuffle(stream)
    for k in range(0, len(stream), 50):
        summary.add(*phrases.tally(np.array(stream[k : k + 50], dtype=np.uint64)))
    assert 0 < summary.error <= len(stream) // 11
    assert 7 in summary.frequent(summary.error + 1).tolist()


def test_counters_are_packed_without_loss():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << phrases.KEY_BITS, 5000)).astype(np.uint64)
    counts = rng.integers(1, 2**31, len(keys))
    for a, b in zip(phrases.unpack(phrases.pack(keys, counts)), (keys, counts)):
        assert np.array_equal(a, b)


def test_equal_hashes_of_different_phrases_do_no_harm():
    w = next(words.cut_words(pa.array(["a b a b c a b"]), phrases.BETWEEN, phrases.ENDS))
    heads, counts, _ = phrases.distinct_phrases(w, 2, np.arange(6), np.zeros(6, np.uint64), np.zeros(1, np.int64))
    found = {tuple(w.vocabulary[int(w.ids[h + k])].as_py() for k in range(2)): int(c) for h, c in zip(heads, counts)}
    assert found == {("a", "b"): 3, ("b", "a"): 1, ("b", "c"): 1, ("c", "a"): 1}


def some_texts():
    rng = random.Random(8)
    rows = []
    for k in range(120):
        w = [rng.choice("New york of the a b c d, e. f; York".split()) for _ in range(rng.randint(0, 80))]
        rows.append((k, " ".join(w), rng.choice(["en", "de", None])))
    return rows + [(500, None, "en"), (501, "", "fr"), (501, "", "fr"), (None, "the the the the\nthe\tthe", "en")]


@pytest.mark.parametrize("report", [15, 2000])
def test_phrases_equal_brute_force(spark, report):
    rows = some_texts()
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = phrases.collocations(df, threshold=12, report=report)
    assert got.columns == "lang rank phrase a l r n score".split()
    assert sorted(map(tuple, got.collect())) == sorted(brute_phrases([(r[2], r[1]) for r in rows], 12, report))


def test_counting_in_slices_and_with_a_crowded_filter(spark, monkeypatch):
    rows = some_texts()
    monkeypatch.setattr(phrases, "FILTER_ROWS", 200)
    monkeypatch.setattr(phrases, "HELD", 300)
    monkeypatch.setattr(words, "CHUNK", 400)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, totals = phrases.frequent_phrases(df, 12)
    f, n = brute_counts([(r[2], r[1]) for r in rows])
    assert {(r.lang, tuple(r.phrase.split(" "))): r.a for r in got.collect()} == {k: a for k, a in f.items() if a >= 12}
    assert dict(map(tuple, totals.collect())) == dict(n)


def test_phrases_of_nothing(spark, nothing):
    assert phrases.collocations(nothing.withColumn("lang", F.lit("en"))).count() == 0


@pytest.mark.parametrize("name", ["op11_phrases", "op12_positional_index"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert frames_equal(QUERIES[name](spark, FOLDER).toPandas(), con.sql(ORACLES[name]).df()) == ""


# positional index

def brute_contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = [(i, tuple(w[k : k + 10])) for i, t in items for w in [cut(t)] if w for k in range(max(1, len(w) - 9))]
    out = []
    for doc, text in docs:
        w, hit, ids = cut(text), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids.update([] if item is None else [str(item)])
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 200_000])
def test_contamination_equals_brute_force(spark, block, monkeypatch):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice(["Uno", "due", "tre,", "quattro", "cinque-sei"]) for _ in range(n))
    items = [(k, line(n)) for k, n in enumerate([3, 1, 5, 12, 14, 10, 30])] + [(8, None), (9, " ,"), (3, "due tre uno"), (None, "sette otto"), (11, "é")]
    docs = [(k, line(rng.randint(0, 40))) for k in range(30)] + [(100, None), (101, ""), (102, "sette otto nove"), (102, "sette otto nove"), (None, items[3][1]), (103, "E É é")]
    docs += [(200 + k, f"nove {items[k][1]}! {items[k][1]}") for k in range(7)]
    monkeypatch.setattr(postings, "SEGMENT_BYTES", 300)
    left = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    right = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    got = postings.contamination(left, right, block_windows=block)
    assert got.columns == "doc_id n_words n_hit n_items items_sha256 contaminated".split()
    assert sorted(map(tuple, got.collect()), key=str) == brute_contamination(docs, items)


def test_contamination_of_and_by_nothing(spark, documents, nothing):
    items = nothing.select(F.col("doc_id").alias("item_id"), "text")
    assert postings.contamination(nothing, items).count() == 0
    assert {(r.n_hit, r.n_items, r.contaminated) for r in postings.contamination(documents, items).collect()} == {(0, 0, False)}


def test_proximity_matches_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(12)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for k in range(25)]
    items = [(k, " ".join(rng.sample(vocabulary, 3))) for k in range(10)]
    index = postings.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    windows, owners = postings.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    for within in (0, 2, 4):
        found = postings.proximity_matches(index, windows, within).join(owners, "window").join(postings.index_docs(index), "doc")
        got = {(r.doc_id, r.item_id) for r in found.select("doc_id", "item_id").distinct().collect()}
        want = set()
        for doc, text in docs:
            w = text.split()
            for item, terms in items:
                t = terms.split()
                # the anchor is the rarest term of the segment that holds the text, so any of the terms may be it
                anchors = [a for a in t if any(x == a and all(y in w[max(0, k - within) : k + within + 1] for y in t) for k, x in enumerate(w))]
                if anchors:
                    want.add((doc, str(item), tuple(anchors)))
        sure = {(d, i) for d, i, anchors in want if len(anchors) == 3}
        assert sure <= got <= {(d, i) for d, i, _ in want}


# runs

def brute_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def odd_texts(rng, n):
    for _ in range(n):
        kind, size, k = rng.random(), rng.randint(0, 100), rng.choice([1, 2, 2, 3, 6, 40])
        w = [rng.randrange(k) for _ in range(size)]
        if kind < 0.4 and size:
            p, a = rng.randint(1, max(1, size // 2)), rng.randrange(size)
            w = [x if i < a or a + (i - a) % p >= size else w[a + (i - a) % p] for i, x in enumerate(w)]
        elif kind > 0.75:
            u = [rng.randrange(2) for _ in range(rng.randint(1, 7))]
            w = (u * rng.randint(2, 8) + [rng.randrange(2) for _ in range(rng.randint(0, 3))]) * rng.randint(1, 5)
        yield w


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        texts = list(odd_texts(rng, 12))
        sizes = [len(w) for w in texts]
        at = np.cumsum([0, *sizes])
        s, e, q = runs.find_runs(np.array([x for w in texts for x in w]), np.repeat(np.arange(12), sizes).astype(np.int32))
        want = [(a + at[k], a + n + at[k], p) for k, w in enumerate(texts) for a, n, p in brute_runs(w)]
        assert sorted(zip(s.tolist(), e.tolist(), q.tolist())) == sorted(want)


@pytest.mark.parametrize("word", ["aabab" * 60, "a" * 400, "ab" * 30 + "a" + "ab" * 30 + "a", "abaab" * 20 + "abaababaab" * 10])
def test_runs_of_highly_periodic_texts(word, monkeypatch):
    monkeypatch.setattr(runs, "CANDIDATES", 50)
    ids = np.frombuffer(word.encode(), np.uint8).astype(np.int64)
    s, e, q = runs.find_runs(ids, np.zeros(len(ids), np.int32))
    assert [(a, b - a, p) for a, b, p in zip(s.tolist(), e.tolist(), q.tolist())] == brute_runs(list(word))


def test_wavelet_tree_counts_and_selects():
    rng = np.random.default_rng(1)
    for n in (1, 2, 37, 256):
        values = rng.permutation(n)
        tree = runs.WaveletTree(values)
        for _ in range(200):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            x, y = sorted(rng.integers(0, n + 5, 2).tolist())
            inside = sorted(v for v in values[a:b].tolist() if x <= v < y)
            got = [int(g[0]) for g in tree.successors(*(np.array([k]) for k in (a, b, x, y)))]
            assert got[0] == len(inside)
            assert got[1] == (inside[0] if inside else 0) and got[2] == (inside[1] if len(inside) > 1 else 0) and got[3] == (inside[-1] if inside else 0)


def test_extensions_by_names_of_stretches():
    rng = np.random.default_rng(2)
    ids, doc = rng.integers(0, 2, 300), np.repeat([0, 1, 2], 100)
    ids[150:190] = ids[110:150]
    suffixes = runs.Suffixes.of(ids, doc)
    assert sorted(suffixes.array.tolist()) == list(range(300))
    for a, b in rng.integers(0, 300, (500, 2)).tolist():
        if a == b or doc[a] != doc[b]:
            continue
        a, b = min(a, b), max(a, b)
        end, begin = 100 * (doc[b] + 1), 100 * doc[a]
        forward = next((k for k in range(end - b) if ids[a + k] != ids[b + k]), end - b)
        backward = next((k for k in range(a - begin) if ids[a - 1 - k] != ids[b - 1 - k]), a - begin)
        assert (suffixes.forward(np.array([a]), np.array([b]))[0], suffixes.backward(np.array([a]), np.array([b]))[0]) == (forward, backward)


def test_repetitions_of_the_fixture(spark, documents, nothing):
    rows = [(50, "  ".join(["la", "le\n"] * 9) + " fin", "s", "x"), (51, "x " * 12, None, None), (51, "x " * 12, None, None), (52, "x " * 11, None, None)]
    df = with_clashes(documents.unionByName(spark.createDataFrame(rows, documents.schema)))
    texts = [(r.doc_id, r.text) for r in df.collect()]
    got = runs.repetitions(df)
    assert got.columns == ["doc_id", "runs", "collapsed"]
    want = []
    for doc, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want.append((doc, brute_runs(w), collapsed(w, brute_runs(w))))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str) == sorted(want, key=str)
    assert runs.repetitions(nothing).count() == runs.run_digest(nothing).count() == 0
    # the digest query takes the same rows, null ids among them
    assert runs.run_digest(df).count() == len(texts)


def test_run_query_equals_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    docs = table(spark, FOLDER, "documents").collect()
    assert len(got) == len(docs)
    altered = 0
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if n > 2500:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a, altered = g % n, altered + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        digests = ("".join("%d,%d,%d\n" % x for x in found), collapsed(w, found))
        longest = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
        assert got[r.doc_id] == (r.doc_id, len(found), *longest, *(hashlib.sha256(x.encode()).hexdigest() for x in digests))
    assert altered > 5
