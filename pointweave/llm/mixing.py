"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a repeatable random order and read up to
three times. A copy's virtual finish time is the source's tokens so far divided
by the source's target, so every source advances through its target at the same
pace. All copies are then sorted by finish time over the whole corpus and the
sequence ends where its tokens reach the total budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import folded, key_block, running_total, spread_key, unfolded, word_count
from pointweave.session import cut

#: no source and no document is used more often than this
MAX_REPEATS = 3
#: rows of one slice of a sorted order
SLICE_ROWS = 500
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_id, source_size, n_docs, target) from rows of (source, size).

    Sources in code-point order, null last, get the weights in turn and share
    the total by weight; none gets more than MAX_REPEATS times its size, and the
    excess is shared out again until none is above. That water level is found
    in one sorted pass over sources, of which there are few: the sources that
    stop first are those with the least size per weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = cut(per, "sources")
    named = per.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = named.withColumn("_w", F.element_at(cycle, ((F.col("source_id") - 1) % len(weights) + 1).cast("int"))).withColumn(
        "_cap", F.col("source_size").cast("double") * MAX_REPEATS
    )
    ranked = Window.orderBy(F.col("_cap") / F.col("_w"), "source_id")
    past = ranked.rowsBetween(Window.unboundedPreceding, -1)
    onward = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = named.withColumn(
        "_level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(past), F.lit(0.0))) / F.sum("_w").over(onward),
    )
    # the first source in rank order that its level does not fill sets the level of all that follow
    open_level = F.min(F.when(F.col("_cap") > F.col("_w") * F.col("_level"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), "source_id", "_level"))).over(everything)
    return levels.withColumn("_open", open_level).select(
        "source",
        "source_id",
        "source_size",
        "n_docs",
        F.when(F.col("_open").isNull(), F.col("_cap"))
        .otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_open._level")))
        .alias("target"),
    )


def schedule(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``df``: id, ``size``, ``source_size``, ``target``, ``times`` the mix uses it, ``taken`` words.

    Null texts have size 0; null sources form one source; equal finish times are
    ordered by the documents' shuffle keys; repeated rows are scheduled each for
    itself; an empty table gives an empty schedule. Also ``_text_key`` to find
    the document again.
    """
    sized = cut(
        df.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("source"),
            word_count(text_col).alias("size"),
            spread_key(SEED, id_col).alias("_key"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_key"),
        ),
        "sized",
    )
    targets = cut(source_targets(sized), "targets")
    located = sized.join(targets, sized.source.eqNullSafe(targets.source)).select(
        "_id", "size", "_key", "_text_key", "source_id", "source_size", "target",
        key_block("_key", F.ceil(F.col("n_docs") / SLICE_ROWS)).alias("_slice"),
    )
    located = cut(located, "located")
    paced = running_total(located, ["source_id"], "_slice", ["_key", "_id", "_text_key"], "size", "_sofar")
    paced = cut(paced.withColumn("_row", F.monotonically_increasing_id()), "paced")

    budget, rows = paced.agg(F.sum("size"), F.count(F.lit(1))).first()
    slices = max(1, (rows or 0) // SLICE_ROWS)
    finish = (F.col("_epoch") * F.col("source_size") + F.col("_sofar")) / F.col("target")
    copies = (
        paced.where("size > 0 and target > 0")
        .select("_row", "_id", "size", "_key", "source_size", "_sofar", "target", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("_epoch"))
        .select("_row", "_id", "size", "_key", "_epoch", finish.alias("_finish"))
        .withColumn("_range", F.floor(F.col("_finish") * slices))
        .withColumn("_all", F.lit(0))
    )
    copies = cut(copies.repartitionByRange("_finish"), "copies")
    ordered = running_total(copies, ["_all"], "_range", ["_finish", "_key", "_id", "_epoch"], "size", "_total")
    times = ordered.where(F.col("_total") <= F.lit(budget or 0)).groupBy("_row").agg(F.count(F.lit(1)).alias("times"))
    return (
        paced.join(cut(times, "times"), "_row", "left")
        .withColumn("times", F.coalesce("times", F.lit(0)).cast("long"))
        .select(
            F.col("_id").alias(id_col), "size", "source_size", "target", "times",
            (F.col("times") * F.col("size")).alias("taken"), "_text_key",
        )
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the rows of ``df``, each as often as the schedule takes it, with their columns, whatever their names and types.

    Null texts have no words, so the mix never takes them; null sources form one
    source; an empty table stays empty. Rows that tie in id and text share their
    turns: the one that comes last in JSON stands for all of them.
    """
    plan = schedule(df, id_col, text_col, source_col)
    totals = cut(
        plan.groupBy(F.col(id_col).alias("total_id"), F.col("_text_key").alias("total_key"))
        .agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"))
        .where("times > 0"),
        "totals",
    )
    keyed = folded(df, F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    # the totals grow with the corpus, so they are never sent whole to the executors
    found = keyed.join(totals.hint("merge"), F.col("id").eqNullSafe(F.col("total_id")) & (F.col("key") == F.col("total_key")))
    single = found.where("rows = 1").select("row", "times")
    tied = found.where("rows > 1").groupBy("id", "key").agg(F.max_by("row", F.to_json("row")).alias("row"), F.max("times").alias("times"))
    turns = single.unionByName(tied.select("row", "times")).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return turns.select(*unfolded(df.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
s1 AS (SELECT *, (sid - 1) % 3 + 1.0::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s1),
s AS (SELECT source, sid, source_size, least(cap, w * coalesce((SELECT lv FROM s2 WHERE cap > w * lv ORDER BY cap / w, sid LIMIT 1), 1e300)) AS target FROM s2),
p AS (SELECT d.doc_id, d.size, d.k, s.source_size, s.target, CAST(sum(d.size) OVER (PARTITION BY s.sid ORDER BY d.k, d.doc_id) AS BIGINT) AS sofar
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT *, (e * source_size + sofar) / target AS finish FROM p, (VALUES (0), (1), (2)) t(e) WHERE size > 0 AND target > 0),
t AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, k, doc_id, e) AS total FROM c),
n AS (SELECT doc_id, count(*) AS times FROM t WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, p.source_size, p.target, CAST(coalesce(n.times, 0) * p.size AS BIGINT) AS taken
FROM p LEFT JOIN n USING (doc_id)
"""
