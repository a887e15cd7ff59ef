"""Phrases whose words occur together far more often than by chance.

Phrases of one and two words, then those of three to five, go through
Misra-Gries summaries: a task counts what it reads, deals the counts to hash
partitions, and a partition merges the summaries it gets under a capacity that
exceeds its mass (all occurrences that fall into it) divided by the threshold.
So every frequent phrase survives in memory that does not depend on how many
different phrases there are. What survives is kept as a bitmap of fixed size; a
longer phrase enters the second summaries only if all its word pairs survive.
A last pass over the texts counts the survivors exactly, by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.words import Words, byte_class, cut_words, mix64
from pointweave.session import cut

#: a phrase is frequent from so many occurrences on; words of a phrase at most; rows a language reports
THRESHOLD, LONGEST, REPORT = 100, 5, 2000
#: hash partitions at least, and text bytes for each of them in a larger corpus: this bounds a partition's mass, so its counters
LEAST_PARTS, PART_BYTES = 256, 256 << 20
#: a summary's key is a phrase's hash cut to so many bits; phrases that share a key only survive together
KEY_BITS = 38
#: bits of a survivors' filter, 16 MiB whatever the corpus, and survivors of one filter of the counting pass
FILTER_BITS, FILTER_ROWS = 1 << 27, 1 << 24
#: bits of one bitmap row, as Spark's bitmap functions have them
BLOCK_BITS = 32768
#: counters a task holds before it hands them on
HELD = 1_500_000

ENDS = byte_class(b".,;:!?\n\v\f\r")
BETWEEN = ENDS | byte_class(b" \t")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def language(lang_col: str | Column) -> Column:
    return F.coalesce(F.col(lang_col) if isinstance(lang_col, str) else lang_col, F.lit("und"))


class Filter:
    """A set of phrase keys as a bitmap: what it denies is certainly not in the set."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scrambled = mix64(keys ^ _ODD)
        modulus = np.uint64(FILTER_BITS)
        return scrambled % modulus, (scrambled >> np.uint64(32)) % modulus

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for at in self.places(keys):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return found


def keys_of(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS)


def windows(words: Words, salts: np.ndarray, longest: int, pairs: Filter | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length 1, 2, ..: first words and hashes of all phrases inside pieces.

    ``salts`` holds a hash per text (its language). With ``pairs``, phrases go
    on growing only while all their word pairs may be in that filter.
    """
    word = words.vocabulary_hash[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    at = np.arange(len(word))
    hashes = mix64(word ^ salts[words.doc])
    joined = np.zeros(len(word), dtype=bool)
    yield 1, at, hashes
    for n in range(2, longest + 1):
        room = at + n - 1 < len(word)
        at, hashes = at[room], hashes[room]
        # the last word must not begin a piece; earlier ones were looked at for shorter phrases
        inside = ~words.breaks[at + n - 1]
        if n > 2 and pairs is not None:
            inside &= joined[at + n - 2]
        at = at[inside]
        with np.errstate(over="ignore"):
            hashes = mix64(hashes[inside] * _ODD + word[at + n - 1])
        if n == 2 and pairs is not None:
            joined[at] = pairs(keys_of(hashes))
        yield n, at, hashes
        if n == 2 and pairs is not None:
            at, hashes = at[joined[at]], hashes[joined[at]]


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their (summed) counts."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    if counts is None:
        keys = np.sort(keys)
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[begin], np.diff(np.append(begin, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begin], np.add.reduceat(counts, begin)


class Summary:
    """A mergeable Misra-Gries summary of at most ``capacity`` counters.

    A count is too low by at most ``error``. Every cut by some amount takes that
    amount from more than ``capacity`` counters, so ``error`` stays at or below
    mass / (capacity + 1).
    """

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > self.capacity:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.held = [], 0
        self.keys, self.counts = tally(keys, counts)
        if len(self.keys) > self.capacity:
            cut_by = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            self.error += cut_by
            stays = self.counts > cut_by
            self.keys, self.counts = self.keys[stays], self.counts[stays] - cut_by

    def frequent(self, threshold: int) -> np.ndarray:
        """All keys that may have ``threshold`` occurrences."""
        self.merge()
        return self.keys[self.counts + self.error >= threshold]


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences and counts, byte by byte of equal weight, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T[:5]
    sizes = counts.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(steps.tobytes() + sizes.tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    n = len(raw) // 9
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :5] = raw[: 5 * n].reshape(5, n).T
    keys = np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)
    return keys, raw[5 * n :].reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def _salts(langs: pa.Array) -> np.ndarray:
    # another seed than words have: the word "es" in "en" is not the word "en" in "es"
    return np.array([xxhash.xxh3_64_intdigest((x or "und").encode(), seed=1) for x in langs.to_pylist()], dtype=np.uint64)


def summaries(texts: DataFrame, lengths: range, parts: int, pairs=None) -> DataFrame:
    """What tasks counted: rows (part, mass, counters), and with part -1 a row (lang, words) per language and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(np.frombuffer(pairs.value, dtype=np.uint8)) if pairs is not None else None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        words_of: dict[str, int] = {}

        def hand_on() -> pa.RecordBatch:
            keys, counts = tally(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            owner = ((keys * np.uint64(parts)) >> np.uint64(KEY_BITS)).astype(np.int64)
            bounds = np.searchsorted(owner, np.arange(parts + 1))
            rows = [(p, a, b) for p, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _, _ in rows], pa.int32()),
                    pa.array([int(counts[a:b].sum()) for _, a, b in rows], pa.int64()),
                    pa.array([pack(keys[a:b], counts[a:b]) for _, a, b in rows], pa.binary()),
                    pa.nulls(len(rows), pa.string()),
                ],
                names=["part", "mass", "counters", "lang"],
            )

        for batch in batches:
            langs, salts = batch.column(0), _salts(batch.column(0))
            for words in cut_words(batch.column(1), BETWEEN, ENDS, lower=True):
                if lengths.start == 1:
                    for lang, n in zip(langs[words.rows.start : words.rows.stop].to_pylist(), words.per_doc().tolist()):
                        words_of[lang] = words_of.get(lang, 0) + n
                found = [keys_of(h) for n, _, h in windows(words, salts[words.rows], lengths.stop - 1, known) if n in lengths]
                held.append(tally(np.concatenate(found)))
                if sum(len(k) for k, _ in held) > HELD:
                    yield hand_on()
        if held:
            yield hand_on()
        if words_of:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1] * len(words_of), pa.int32()),
                    pa.array(list(words_of.values()), pa.int64()),
                    pa.nulls(len(words_of), pa.binary()),
                    pa.array(list(words_of), pa.string()),
                ],
                names=["part", "mass", "counters", "lang"],
            )

    return cut(texts.mapInArrow(run, "part int, mass long, counters binary, lang string"), "summaries")


def survivors(tallied: DataFrame, threshold: int) -> DataFrame:
    """(key, at1, at2) of every key that may have ``threshold`` occurrences, with its two places in a filter."""
    found = tallied.where("part >= 0")
    # one row per hash partition; both sides are written tables, so Spark knows that this one is small
    masses = cut(found.groupBy("part").agg(F.sum("mass").alias("total")), "masses")
    dealt = found.select("part", "counters").join(masses, "part").repartition("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, Summary] = {}
        for batch in batches:
            for part, blob, total in zip(*(batch.column(k).to_pylist() for k in ("part", "counters", "total"))):
                if part not in open_:
                    open_[part] = Summary(total // threshold + 1)
                open_[part].add(*unpack(blob))
        for part in list(open_):
            summary = open_.pop(part)
            keys = summary.frequent(threshold)
            assert summary.error < threshold
            at1, at2 = Filter.places(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (keys, at1, at2)], names=["key", "at1", "at2"]
            )

    return cut(dealt.mapInArrow(run, "key long, at1 long, at2 long"), "survivors")


def shared_filter(keys: DataFrame):
    """A broadcast bitmap of (at1, at2); FILTER_BITS / 8 bytes at most, whatever the number of keys."""
    at = keys.select(F.explode(F.array("at1", "at2")).alias("at"))
    block = (F.expr("bitmap_bucket_number(at + 1)") - 1).alias("block")
    rows = at.groupBy(block).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("bitmap")).collect()
    bits = bytearray(FILTER_BITS // 8)
    for row in rows:
        bits[row.block * BLOCK_BITS // 8 : (row.block + 1) * BLOCK_BITS // 8] = row.bitmap
    return keys.sparkSession.sparkContext.broadcast(bytes(bits))


def _same_words(ids: np.ndarray, at: np.ndarray, group: np.ndarray, heads: np.ndarray, n: int) -> bool:
    return all(np.array_equal(ids[at + k], ids[heads[group] + k]) for k in range(n))


def distinct_phrases(words: Words, n: int, at: np.ndarray, hashes: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the different phrases among those that begin at ``at``, how often each occurs there, and its hash.

    Sorted by hash; the words themselves decide, so equal hashes of different phrases do no harm.
    """
    order = np.argsort(hashes, kind="stable")
    at, hashes = at[order], hashes[order]
    new = np.append(True, hashes[1:] != hashes[:-1])
    heads, key, group = at[new], hashes[new], np.cumsum(new) - 1
    if not (_same_words(words.ids, at, group, heads, n) and np.array_equal(lang[words.doc[at]], lang[words.doc[heads[group]]])):
        rows = np.column_stack([lang[words.doc[at]], *[words.ids[at + k] for k in range(n)]])
        _, first, group = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        heads, key, group = at[first], hashes[first], group.ravel()
    return heads, np.bincount(group, minlength=len(heads)), key


COUNTED = ["lang", "n", "phrase", "a"]


def _summed(held: list[pa.RecordBatch], by: list[str]) -> pa.Table:
    table = pa.Table.from_batches(held).group_by(by, use_threads=False).aggregate([("a", "sum")])
    return table.select([*by, "a_sum"]).rename_columns([*by, "a"])


def _in_bounds(found: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The batches' rows summed; more than one table only where more different rows than HELD come together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in found:
        held.append(batch)
        rows += batch.num_rows
        if rows > HELD:
            table = _summed(held, by)
            held, rows = table.to_batches(), table.num_rows
            if rows > HELD // 2:  # summing frees too little: what is there goes on
                yield table
                held, rows = [], 0
    if held:
        yield _summed(held, by)


def _stretch_counts(batches: Iterator[pa.RecordBatch], longest: int, short: Filter, keep: Filter, number: int, slices: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        salts = _salts(batch.column(0))
        codes = batch.column(0).dictionary_encode()
        lang_ids, lang_names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary
        for words in cut_words(batch.column(1), BETWEEN, ENDS, lower=True):
            lang = lang_ids[words.rows]
            for n, at, hashes in windows(words, salts[words.rows], longest, short):
                keys = keys_of(hashes)
                stays = keep(keys) & (keys % np.uint64(slices) == np.uint64(number))
                if not stays.any():
                    continue
                heads, counts, key = distinct_phrases(words, n, at[stays], hashes[stays], lang)
                taken = [words.vocabulary.take(pa.array(words.ids[heads + k])) for k in range(n)]
                phrase = taken[0] if n == 1 else pc.binary_join_element_wise(*taken, " ")
                part = ((keys_of(key) * np.uint64(parts)) >> np.uint64(KEY_BITS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part),
                        lang_names.take(pa.array(lang[words.doc[heads]])),
                        pa.array(np.full(len(heads), n, dtype=np.int32)),
                        phrase.cast(pa.string()),
                        pa.array(counts.astype(np.int64)),
                    ],
                    names=["part", *COUNTED],
                )


def exact_counts(texts: DataFrame, threshold: int, longest: int, parts: int, pairs, known, slice_of: tuple[int, int]) -> DataFrame:
    """(lang, n, phrase, a) of the phrases with ``threshold`` occurrences whose keys may be in ``known`` and fall into the slice.

    A task sums what it finds, phrase by phrase, and hands each hash partition
    its part as one compressed piece; a partition adds the pieces up.
    """
    number, slices = slice_of

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        short, keep = (Filter(np.frombuffer(x.value, dtype=np.uint8)) for x in (pairs, known))
        for table in _in_bounds(_stretch_counts(batches, longest, short, keep, number, slices, parts), ["part", *COUNTED[:3]]):
            table = table.sort_by("part").combine_chunks()
            part = table["part"].to_numpy()
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
            pieces = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(part)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema.remove(0), options=options) as writer:
                    writer.write_table(table.slice(a, b - a).drop_columns("part"))
                pieces.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(pieces, pa.binary())], names=["part", "piece"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (x for batch in batches for piece in batch.column(1) for x in pa.ipc.open_stream(piece.as_buffer()))
        held: list[pa.RecordBatch] = []
        rows, limit = 0, HELD
        for piece in pieces:
            held.append(piece)
            rows += piece.num_rows
            if rows > limit:
                table = _summed(held, COUNTED[:3])
                held, rows = table.to_batches(), table.num_rows
                limit = max(HELD, 2 * rows)
        if held:
            total = _summed(held, COUNTED[:3])
            yield from total.filter(pc.greater_equal(total["a"], threshold)).to_batches()

    return texts.mapInArrow(count, "part int, piece binary").repartition("part").mapInArrow(add, "lang string, n int, phrase string, a long")


def frequent_phrases(
    df: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``threshold`` occurrences in their language, and the words per language.

    Returns (lang, n, phrase, a) and (lang, words). A null text is empty, a null
    language is ``und``; other columns are not looked at; an empty table gives
    empty results. Repeated rows count each time.
    """
    spark = df.sparkSession
    texts = df.select(language(lang_col).alias("lang"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    first = summaries(texts, range(1, min(2, longest) + 1), parts)
    totals = first.where("part < 0").groupBy("lang").agg(F.sum("mass").alias("words"))
    short = survivors(first, threshold)
    pairs = shared_filter(short)
    keys = short
    if longest > 2:
        keys = short.unionByName(survivors(summaries(texts, range(3, longest + 1), parts, pairs), threshold))
    slices = max(1, -(-keys.count() // FILTER_ROWS))
    counted = None
    for number in range(slices):
        known = pairs if longest <= 2 and slices == 1 else shared_filter(keys.where(F.col("key") % slices == number))
        part = exact_counts(texts, threshold, longest, parts, pairs, known, (number, slices))
        counted = part if counted is None else counted.unionByName(part)
    return cut(counted, "phrases"), cut(totals, "words")


def _words(of: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split(of, " "), start, length), " ")


#: copies of a single word's count in the look-up of parts, so that a word which begins very many phrases has several tasks
SALTS = 16


def score_phrases(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates of two or more words with the lowest-scoring cut: (lang, phrase, words, a, l, r, n, score)."""
    candidates = frequent.where("n >= 2").select("lang", "phrase", F.col("n").alias("words"), "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cuts = (
        cuts.withColumn("left", _words("phrase", F.lit(1), F.col("k")))
        .withColumn("right", _words("phrase", F.col("k") + 1, F.col("words") - F.col("k")))
        .withColumn("left_salt", F.when(F.col("k") == 1, salt).otherwise(0))
        .withColumn("right_salt", F.when(F.col("words") - F.col("k") == 1, salt).otherwise(0))
    )
    copies = F.explode(F.when(F.col("n") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    counts = frequent.select("lang", "phrase", "a", copies.alias("salt"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("salt").alias("left_salt"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("salt").alias("right_salt"), F.col("a").alias("r"))
    known = cuts.join(left, ["lang", "left", "left_salt"]).join(right, ["lang", "right", "right_salt"]).join(
        totals.withColumnRenamed("words", "n"), "lang"
    )
    big = [F.col(c).cast("decimal(14,0)") for c in ("a", "n", "l", "r")]
    known = known.withColumn("above", F.lit(1000).cast("decimal(4,0)") * big[0] * big[1]).withColumn("below", big[2] * big[3])
    scored = known.withColumn("score", F.expr("above div below"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return scored.groupBy("lang", "phrase", "words", "a", "n").agg(best).select(
        "lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score"
    )


def drop_parts(candidates: DataFrame) -> DataFrame:
    """Candidates without those that occur only inside a longer candidate.

    A longer phrase occurs at most as often as any part of it, and a phrase
    between the two lies between them in number, so the phrases one word longer
    decide.
    """
    longer = candidates.where("words > 2")
    inner = F.explode(
        F.array_distinct(
            F.array(
                _words("phrase", F.lit(1), F.col("words") - 1),
                _words("phrase", F.lit(2), F.col("words") - 1),
            )
        )
    )
    most = longer.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_within"))
    kept = candidates.join(most, ["lang", "phrase"], "left")
    return kept.where(F.coalesce(100 * F.col("_within") < 100 * F.col("a"), F.lit(True))).drop("_within")


def collocations(
    df: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, report: int = REPORT, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The ``report`` best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    By score, then number of occurrences, both falling, then by the phrase's
    bytes. Nulls, repeated rows and other columns as in ``frequent_phrases``.
    """
    frequent, totals = frequent_phrases(df, threshold, longest, lang_col, text_col)
    scored = cut(drop_parts(cut(score_phrases(frequent, totals), "scored")), "candidates")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of every slice first, so that no task sorts a whole language
    dealt = scored.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    heads = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_at") <= report)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= report).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
grams AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM starts, range(1, 6) lengths(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, k::INT AS words, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT * FROM f WHERE words >= 2),
cuts AS (
  SELECT lang, phrase, words, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp
  FROM cand, range(1, 5) ks(k) WHERE k < words
), scored AS (
  SELECT c.lang, c.phrase, c.words, c.a, k, x.a AS l, y.a AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM cand c WHERE c.lang = b.lang AND c.words > b.words AND 100 * c.a >= 100 * b.a
      AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
