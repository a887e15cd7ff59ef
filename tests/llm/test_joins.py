"""The two similarity joins and the pipeline against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointweave.llm import blocks, buckets, jaccard, metric, mixing, shingles, toxicity
from pointweave.llm.common import table
from pointweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def word_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_links(texts, threshold=0.8):
    sets = word_sets(texts)
    return [
        (a, b) for b in range(len(sets)) for a in range(b)
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    ]


def test_shingles_are_the_sets_of_word_windows():
    import pyarrow as pa

    texts = ["a b c d e f", "a  b\nc\td e f ", "a b", "b a", "", None, "x", "a b c d e", "one two three four five six one two three four five", "é   ü"]
    got = [s for sh, n in shingles.shingle_arrays(pa.array(texts)) for s in shingles.distinct_sets(sh, n)]
    assert [len(s) for s in got] == [len(s) for s in word_sets(texts)]
    assert got[0].tolist() == got[1].tolist() and got[2].tolist() != got[3].tolist()
    sliced = pa.array(["drop", *texts, "drop"]).slice(1, len(texts))
    again = [s for sh, n in shingles.shingle_arrays(sliced) for s in shingles.distinct_sets(sh, n)]
    assert all(np.array_equal(a, b) for a, b in zip(got, again))


def test_stretches_do_not_change_the_hashes(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["aa", "b", "ccc", "dé"], rng.integers(0, 60))) for _ in range(200)]
    whole = [s.tolist() for sh, n in shingles.shingle_arrays(pa.array(texts)) for s in shingles.distinct_sets(sh, n)]
    monkeypatch.setattr(shingles, "CHUNK", 300)
    assert whole == [s.tolist() for sh, n in shingles.shingle_arrays(pa.array(texts)) for s in shingles.distinct_sets(sh, n)]


def test_agreements_estimate_the_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for share in (0.2, 0.5, 0.8):
        other = base.copy()
        change = int(len(base) * (1 - share) / (1 + share))
        other[:change] = rng.integers(0, 2**63, change).astype(np.uint64)
        m = shingles.minhashes(np.concatenate([base, other]), np.array([len(base), len(other)]))
        assert abs((m[0] == m[1]).mean() - share) < 0.17


def test_pruning_keeps_pairs_at_the_threshold():
    needed = jaccard.least_agreements(0.8, 1e-7)
    assert list(needed) == sorted(needed) and needed[-1] < 0.8 * shingles.HASHES
    rng = np.random.default_rng(1)
    agree = rng.random((20_000, shingles.HASHES)) < 0.8
    for k, m in enumerate(needed):
        assert (agree[:, : 16 * (k + 1)].sum(axis=1) >= m).all()
    few = rng.random((20_000, shingles.HASHES)) < 0.3
    assert (few[:, :32].sum(axis=1) >= needed[1]).mean() < 0.2


def test_near_duplicates_of_edge_cases(documents, nothing):
    got = jaccard.near_duplicates(documents).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert len(got) == 12
    assert [(by[i].class_id, by[i].n_links) for i in (1, 2, 3)] == [(1, 2)] * 3
    assert [(by[i].class_id, by[i].n_links, by[i].kept) for i in (4, 5, 11)] == [(4, 0, True), (5, 0, True), (11, 0, True)]
    assert (by[6].class_id, by[6].n_links, by[7].class_id, by[7].n_links) == (6, 2, 6, 2)
    assert (by[9].class_id, by[9].n_links, by[10].class_id) == (9, 1, 9)
    assert (by[None].class_id, by[None].n_links) == (None, 0)
    left = jaccard.drop_near_duplicates(documents)
    assert left.columns == documents.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 4, 5, 6, 9, 11]
    assert jaccard.near_duplicates(nothing).count() == 0 and jaccard.drop_near_duplicates(nothing).count() == 0


def test_a_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BAND_ROWS", 16)
    monkeypatch.setattr(jaccard, "SET_ROWS", 16)
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(0, 60)] = f"v{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = brute_links(texts)
    degree, parent = Counter(x for p in pairs for x in p), roots(len(texts), pairs)
    got = {r.doc_id: r for r in jaccard.near_duplicates(df).collect()}
    assert all((got[i].n_links, got[i].class_id) == (degree[i], parent[i]) for i in range(len(texts)))


def test_jaccard_query_equals_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect())
    pairs = brute_links([t for _, t in rows])
    degree, parent = Counter(x for p in pairs for x in p), roots(len(rows), pairs)
    got = {r.doc_id: r for r in QUERIES["op4_bayes_jaccard"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        assert (got[i].n_links, got[i].class_id) == (degree[k], rows[parent[k]][0])


def brute_vectors(rows, threshold):
    usable = {}
    for k, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0:
            usable[k] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))
    return [
        (a, b) for a in usable for b in usable
        if a < b and rows[a][2] == rows[b][2] and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= threshold
    ]


@pytest.mark.parametrize("pivots,block", [(1, 1024), (6, 8)])
def test_vectors_against_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(metric, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(160):
        v = rng.normal(size=5) if k % 3 else np.round(rng.normal(size=5))
        rows.append((k, [float(x) for x in v], int(k % 2)))
        if k % 4 == 0:
            rows.append((1000 + k, [float(x) for x in 2 * v + rng.normal(size=5) * 0.1], int(k % 2)))
    rows += [
        (2000, None, 0), (2001, [0.0] * 5, 0), (2002, [float("nan"), 1.0, 0.0, 0.0, 0.0], 0), (2003, [None, 1.0, 0.0, 0.0, 0.0], 0), (2004, [], 0),
        (2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0), (2007, rows[0][1], None), (2008, rows[0][1], 0), (2009, rows[0][1], 0), (2009, rows[0][1], 0),
        (2010, [float("inf"), 1.0, 0.0, 0.0, 0.0], 0),
    ]
    pairs = brute_vectors(rows, 0.95)
    degree, parent = Counter(x for p in pairs for x in p), roots(len(rows), pairs)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[parent[k]] = min(least.get(parent[k], i), i)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in metric.link_vectors(df, 0.95, pivots=pivots).collect())
    want = sorted((i, degree[k], least[parent[k]], least[parent[k]] == i) for k, (i, _, _) in enumerate(rows))
    assert got == want


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert metric.link_vectors(none).count() == 0


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    rows, to = blocks.forest_edges(300, a, b)
    assert roots(300, list(zip(a, b))) == roots(300, list(zip(rows, to)))
    assert len(rows) < 300


def test_pipeline_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    model = toxicity.fit(docs, table(spark, FOLDER, "labels"))
    scorer = toxicity.Scorer(model.lexicon)
    left = [r for r in docs.collect() if model.probability(np.array([scorer.features(r.text or "")]))[0] < 0.5]
    best = {}
    for r in left:
        if r.text not in best or best[r.text].doc_id < r.doc_id:
            best[r.text] = r
    left = sorted(best.values(), key=lambda r: r.doc_id)
    parent = roots(len(left), brute_links([r.text for r in left]))
    left = [r for k, r in enumerate(left) if parent[k] == k]

    import hashlib

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in left}
    own = {}
    for r in left:
        own.setdefault(r.source, []).append(r)
    targets = {r.source: r.target for r in mixing.source_targets(
        spark.createDataFrame([(r.source, size[r.doc_id]) for r in left], "source string, size long")).collect()}
    copies = []
    for s, rows in own.items():
        rows.sort(key=lambda r: (hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest(), r.doc_id))
        total, so_far = sum(size[r.doc_id] for r in rows), 0
        for r in rows:
            so_far += size[r.doc_id]
            if size[r.doc_id]:
                copies += [((e * total + so_far) / targets[s], hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest(), r.doc_id, e) for e in range(3)]
    budget, used, taken = sum(size.values()), 0, Counter()
    for _, _, i, _ in sorted(copies):
        used += size[i]
        if used <= budget:
            taken[i] += 1

    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(r.doc_id for r in got) == taken
    assert all(r.n_tokens == size[r.doc_id] for r in got)
    lengths = Counter(size[i] for i in taken.elements())
    uppers = sorted(lengths)
    bounds = buckets.best_boundaries(np.array(uppers), np.array([lengths[u] for u in uppers]), buckets.BUCKETS)
    best_padding = sum(n * min(b for b in bounds if b >= u) for u, n in lengths.items())
    assert sum(r.padded_to for r in got) <= best_padding * (1 + 1 / buckets.RESOLUTION)


def test_stages_keep_the_columns(spark):
    docs = table(spark, FOLDER, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name
