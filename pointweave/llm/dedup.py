"""Exact deduplication: only rows whose hash may repeat are shuffled.

Pass one marks, in a Bloom bitmap of fixed size, the bits that at least two
rows hit. Pass two tests every row against it: a row with an unmarked bit has
no equal and goes straight through; the others, few, are grouped by their
SHA-256. The bitmap has no false negatives, so results are exact at any size;
a corpus far beyond ``FILTER_BITS`` rows only sends more rows to the grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import folded, unfolded
from pointweave.session import cut

#: bits of one bitmap row, as Spark's bitmap functions have them
BLOCK_BITS = 32768
#: size of the whole filter: 2^27 bits are 16 MiB, whatever the corpus; this bounds the broadcast
FILTER_BITS = 1 << 27


def digest(text: str | Column) -> Column:
    """Lowercase hex SHA-256 of the text in UTF-8; a null text counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _with_bits(df: DataFrame, sha: str) -> DataFrame:
    """A block and two bits in it, from three separate pieces of the digest."""
    def piece(start: int, modulus: int) -> Column:
        return F.pmod(F.conv(F.substring(F.col(sha), start, 8), 16, 10).cast("long"), F.lit(modulus))

    return (
        df.withColumn("_block", piece(1, FILTER_BITS // BLOCK_BITS))
        .withColumn("_bit1", piece(9, BLOCK_BITS))
        .withColumn("_bit2", piece(17, BLOCK_BITS))
    )


def repeat_filter(hashes: DataFrame, sha: str = "text_sha256") -> DataFrame:
    """Pass one: (_block, _bitmap), the bits that two or more rows hit; at most FILTER_BITS in all."""
    twice = _positions(hashes, sha).groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _bitmaps(twice)


def member_filter(hashes: DataFrame, sha: str) -> DataFrame:
    """(_block, _bitmap): a plain Bloom filter of the given hashes, of the same bounded size."""
    return _bitmaps(_positions(hashes, sha))


def _positions(hashes: DataFrame, sha: str) -> DataFrame:
    bits = [F.col("_block") * BLOCK_BITS + F.col(b) + 1 for b in ("_bit1", "_bit2")]
    return _with_bits(hashes.select(sha), sha).select(F.explode(F.array_distinct(F.array(*bits))).alias("_at"))


def _bitmaps(positions: DataFrame) -> DataFrame:
    block = (F.expr("bitmap_bucket_number(_at)") - 1).alias("_block")
    return cut(positions.groupBy(block).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_at))").alias("_bitmap")), "bloom")


def flag_members(df: DataFrame, bloom: DataFrame, sha: str = "text_sha256") -> DataFrame:
    """Adds ``_maybe``; false only for rows whose hash is certainly not in the filter (pass two, for a filter of repeats)."""
    def marked(bit: str) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.floor(F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10)
        return F.call_function("shiftright", byte.cast("int"), (F.col(bit) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

    # the bitmap is at most FILTER_BITS / 8 bytes, so a copy for every executor is bounded
    tested = _with_bits(df, sha).join(F.broadcast(bloom), "_block", "left")
    maybe = F.coalesce(marked("_bit1") & marked("_bit2"), F.lit(False))
    return tested.withColumn("_maybe", maybe).drop("_block", "_bit1", "_bit2", "_bitmap")


def classify_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical; a null text equals an empty one. Of equal
    texts the row with the largest id stays; a null id loses to any other; among
    rows that tie in text and id one stays. An empty table gives an empty
    result. Other columns, whatever their names, are not looked at.
    """
    # the row number is fixed once written, so tied rows stay apart
    hashes = cut(
        df.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(id_col).alias("_id"),
            digest(text_col).alias("text_sha256"),
        ),
        "digests",
    )
    flagged = cut(flag_members(hashes, repeat_filter(hashes)), "flagged")
    several = flagged.where("_maybe").select("_row", "_id", "text_sha256")
    groups = several.groupBy("text_sha256").agg(
        F.max(F.struct("_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("group_size")
    )
    # written first: both sides of the join are then plain shuffles, which Spark can split when one text is hot
    groups = cut(groups.where("group_size > 1"), "groups")
    checked = several.join(groups, "text_sha256", "left").select(
        "_id",
        F.coalesce(F.col("_best._id"), "_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_best._row") == F.col("_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    alone = flagged.where("not _maybe").select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return alone.unionByName(checked).withColumnRenamed("_id", id_col)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their columns, whatever their names and types; same rule as ``classify_copies``.

    Rows without a possible equal are passed on as they are. The others are
    grouped by digest, and partial aggregation keeps one row of a text per task
    before anything is shuffled, so a text with very many copies stays cheap.
    An empty table stays empty.
    """
    hashed = folded(df, F.col(id_col).alias("id"), digest(text_col).alias("sha"))
    bloom = repeat_filter(hashed.select(F.col("sha").alias("text_sha256")))
    flagged = flag_members(hashed, bloom, "sha")
    alone = flagged.where("not _maybe").select("row")
    stay = flagged.where("_maybe").groupBy("sha").agg(F.max_by("row", F.struct(F.col("id").isNotNull(), "id")).alias("row"))
    return alone.unionByName(stay.select("row")).select(*unfolded(df.columns))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
