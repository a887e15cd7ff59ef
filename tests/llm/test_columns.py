"""Columns of a caller with any name and type pass through every operator and stage that hands them on."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointweave.llm import buckets, dedup, jaccard, mixing, templates, toxicity, urls

NAMES = "_id _key _sha _block _bit1 _bit2 _bitmap _maybe _rows _row _k _tk _times _turn _gone _gone_key _host _path _html _page _text row id key sha times rows turn total_id".split()


def crowded(df):
    for name in NAMES:
        df = df.withColumn(name, F.lit(f"of {name}"))
    return df.withColumn("a.b", F.lit(1)).withColumn("bag", F.create_map(F.lit("k"), F.lit("v")))


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()), key=str)


def check(work, df, extra=()):
    """``work`` gives the same rows with and without the other columns, and these come out as they went in."""
    plain, full = work(df), work(crowded(df))
    assert set(full.columns) == {*crowded(df).columns, *extra}
    assert rows(plain, [c for c in plain.columns if c in full.columns]) == rows(full, [c for c in plain.columns if c in full.columns])
    for r in full.collect():
        assert all(r[n] == f"of {n}" for n in NAMES) and r["a.b"] == 1 and r["bag"] == {"k": "v"}
    assert work(crowded(df).where("false")).count() == 0


@pytest.mark.parametrize("work", [dedup.drop_copies, jaccard.drop_near_duplicates, mixing.mix], ids=lambda f: f.__name__)
def test_filters(documents, work):
    check(work, documents.drop("kept"))


def test_scores(documents):
    model = toxicity.Model({}, (0.0,) * len(toxicity.FEATURES), 0.0)
    check(lambda df: toxicity.score(df, model), documents, ("score", "predicted", "toxic_clauses"))


def test_urls(spark, documents):
    pages = documents.withColumn("url", F.lit("http://example.com/en/x"))
    check(lambda df: urls.judge(df, urls.rule_table(spark, urls.RULES)), pages, ("host", "path", "rule", "verdict"))


def test_pages(documents):
    pages = documents.select("doc_id", F.lit("http://a.org/").alias("url"), "text").withColumnRenamed("text", "html")
    plain, full = templates.extract(pages), templates.extract(crowded(pages))
    assert rows(plain, ["doc_id", "text"]) == rows(full, ["doc_id", "text"])
    assert {r["_host"] for r in full.collect()} == {"of _host"} and templates.extract(crowded(pages).where("false")).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, documents, name, stage):
    """Every stage on the fixture with null and empty texts, ties, repeated rows and a null id, and on the empty table."""
    docs = crowded(documents.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")))
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert name == "packing" or out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0
