"""Exact dedup, URL rules, fair mixing and length buckets on edge cases and against brute force."""

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest

from check import frames_equal
from pointweave.llm import buckets, dedup, mixing, urls
from pointweave.llm.common import running_total, spread_key, word_count
from pointweave.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents embeddings pages".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert frames_equal(QUERIES[name](spark, FOLDER).toPandas(), con.sql(ORACLES[name]).df()) == ""


def test_copies(documents):
    got = {(r.doc_id, r.keep_id, r.group_size) for r in dedup.classify_copies(documents).collect()}
    assert {(1, 3, 3), (2, 3, 3), (3, 3, 3), (4, 5, 2), (5, 5, 2), (6, 7, 3), (7, 7, 3), (9, 9, 1), (None, None, 1)} <= got
    rows = dedup.classify_copies(documents).collect()
    assert len(rows) == 12
    assert sum(r.kept for r in rows if r.doc_id == 7) == 1  # of tied rows one stays
    assert {r.text_sha256 for r in rows if r.doc_id in (4, 5)} == {hashlib.sha256(b"").hexdigest()}


def test_copies_dropped_with_all_columns(documents):
    left = dedup.drop_copies(documents)
    assert left.columns == documents.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 3, 5, 7, 9, 10, 11]


def test_copies_of_nothing(nothing):
    assert dedup.classify_copies(nothing).count() == 0 and dedup.drop_copies(nothing).count() == 0


def test_saturated_filter_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FILTER_BITS", dedup.BLOCK_BITS)
    df = spark.range(60_000).selectExpr("id as doc_id", "cast(id % 50000 as string) as text")
    got = dedup.classify_copies(df).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in got} == {True: 50_000, False: 10_000}


def test_rule_precedence(spark):
    cases = {
        "http://a.example.com/en/x": ("example.com/en/", "block"),
        "http://www.example.com/en/x": ("www.example.com/en/", "allow"),
        "https://EXAMPLE.com/en": ("com/", "allow"),
        "http://x.net/es/1?q#f": ("net/es/", "block"),
        "http://x.net/ES/1": (None, "allow"),
        "http://notexample.com": (None, "allow"),
        "no scheme": (None, "allow"),
        None: (None, "allow"),
        "": (None, "allow"),
        "http://net/fr/": ("net/fr/", "block"),
        "http://x.org/" + "a/" * 5000: (None, "allow"),
        "http://x.net/fr/" + "a/" * 5000: ("net/fr/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)], "page_id int, url string, rule string")
    got = {r.url: (r.rule, r.verdict) for r in urls.judge(pages, urls.rule_table(spark, urls.RULES)).collect()}
    assert got == cases


def test_rules_inside_a_segment_and_ties(spark):
    rules = urls.rule_table(spark, [("block", "a.b", "/pre"), ("allow", "a.b", "/pre"), ("allow", "b", ""), ("block", "c", "/x/y")])
    pages = spark.createDataFrame([("http://a.b/prefix",), ("http://z.a.b/other",), ("http://c/x/yz/",), ("http://c/x/",)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert got["http://a.b/prefix"] == ("a.b/pre", "block")
    assert got["http://z.a.b/other"] == ("b", "allow")
    assert got["http://c/x/yz/"] == ("c/x/y", "block")
    assert got["http://c/x/"] == (None, "allow")
    assert urls.judge(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.where("false"), default="block").collect()} == {"block"}


def test_word_count(spark):
    texts = ["a b", None, "", " \t\n ", "x y z", "\x0b1\x0c2\x1f3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count("t")).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_running_total_over_slices(spark):
    df = spark.range(5000).selectExpr("id % 3 as g", "id div 100 as b", "id as v")
    from pointweave.session import cut

    got = running_total(cut(df), ["g"], "b", ["v"], "v", "total").collect()
    for g in range(3):
        own = sorted((r.v, r.total) for r in got if r.g == g)
        assert [t for _, t in own] == list(itertools.accumulate(v for v, _ in own))


def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in names if s not in capped]
        if not rest:
            return capped
        left, weight = total - sum(capped.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / weight >= 3 * sizes[s]]
        if not over:
            return capped | {s: left * w[s] / weight for s in rest}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_are_shared_out_again(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 25):
        sizes = {f"s{i}": int(v) for i, v in enumerate(10 ** rng.uniform(0, 5, n))} | ({None: 17} if n > 1 else {})
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_mix_of_edge_cases(documents, nothing):
    plan = mixing.schedule(documents).collect()
    assert len(plan) == 12
    assert all(r.taken <= 3 * r.size and r.taken == r.times * r.size for r in plan)
    assert all(r.taken == 0 for r in plan if r.doc_id in (4, 5, 11))
    again = mixing.schedule(documents.repartition(5)).collect()
    key = lambda r: (r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, plan)) == sorted(map(key, again))
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    assert mixed.count() == sum(r.times for r in plan)
    assert mixing.schedule(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_mix_comes_near_its_targets(spark):
    df = spark.range(6000).selectExpr(
        "id as doc_id", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source", "repeat('w ', cast(1 + id % 40 as int)) as text"
    )
    plan = mixing.schedule(df).toPandas()
    per = plan.merge(df.select("doc_id", "source").toPandas()).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per.taken - per.target) <= 80).all()


def brute_cost(lengths, counts, buckets_):
    best = None
    for k in range(1, min(buckets_, len(lengths)) + 1):
        for inner in itertools.combinations(lengths[:-1], k - 1):
            bounds = [*inner, lengths[-1]]
            cost = sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts))
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.sort(rng.choice(200, 9, replace=False))
        counts = rng.integers(1, 50, 9)
        for k in (1, 2, 3, 9, 12):
            bounds = buckets.best_boundaries(lengths, counts, k)
            assert len(bounds) <= k and bounds[-1] == lengths[-1]
            assert sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts)) == brute_cost(list(lengths), list(counts), k)


def test_bins(spark):
    got = spark.range(100_000).select("id", buckets.length_bin("id").alias("b")).toPandas()
    assert (got.b >= got.id).all() and (got.b <= got.id * (1 + 1 / buckets.RESOLUTION) + 1e-9).all()
    assert (got.b[:256] == got.id[:256]).all()


def test_batches(documents, nothing):
    rows = buckets.pack(documents, budget=64, buckets=3).collect()
    assert len(rows) == 12
    by = {}
    for r in rows:
        assert r.n_tokens <= r.padded_to
        by.setdefault(r.batch_id, []).append(r)
    for own in by.values():
        assert len({r.padded_to for r in own}) == 1
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or sum(r.padded_to for r in own) <= 64
    assert buckets.pack(nothing).count() == 0


def test_batches_fill_up(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "repeat('w ', cast(id % 90 as int)) as text")
    rows = buckets.pack(df, budget=1000, buckets=4).toPandas()
    for bound, own in rows.groupby("padded_to"):
        full = max(1, 1000 // bound)
        sizes = own.groupby("batch_id").size()
        assert sizes.max() <= full and (sizes < full).sum() <= 1


def test_spread_key_is_repeatable(spark):
    assert spark.range(1).select(spread_key("s", "id")).first()[0] == hashlib.md5(b"s:0").hexdigest()
