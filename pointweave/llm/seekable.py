"""Token ids in seekable compressed files.

A file holds independent zstandard frames, each with the ids of a few
consecutive documents as little-endian unsigned 32-bit integers, and ends with
an index in a skippable frame, so any zstandard tool can still decompress the
whole. Layout of the index frame (all numbers little-endian):

    magic 0x184D2A5E, length of the rest as u32
    per document  u32 number of ids
    per frame     u32 documents, u32 compressed bytes, u32 ids' bytes, u32 crc32 of those bytes
    footer        u32 documents, u32 frames, u32 crc32 of the two lists, u32 0x8F92EAB1

The footer's place is known from the file's end. A reader takes the footer, the
two lists, and then only the frames that hold the documents it wants.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.session import cut, scratch_path

INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
END_ID = 2
#: a frame is closed once it has this many bytes of ids (a longer document has a frame to itself)
FRAME_BYTES = 1 << 18
#: words whose ids a task remembers; only speed depends on it
REMEMBERED = 600_000
#: new words that go to the tokenizer as one text
JOINED_WORDS = 64
PUNCTUATION = ".,;:!?"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Texts to ids with a byte-level BPE tokenizer file, as ``encode(text, add_special_tokens=False)`` gives them.

    The tokenizer first splits a text, never joins a character that is not white
    space with a space after it, and never a letter with punctuation after it.
    So a text falls into words that are encoded apart, and the ids of words seen
    before are remembered. New words go to the tokenizer many at a time as one
    text; a token that begins with a space begins the next word. Texts with
    other white space before a space, or with a special token's string, are
    encoded in one piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how the vocabulary writes a space
        self.words: dict[str, bytes] = {}
        self.odd = re.compile(r"\s ").search

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _learn_plain(self, new: list[str]) -> None:
        """Remembers the ids of " word" for distinct words without a space inside."""
        remember, begins = self.words.update, self.begins
        for start in range(0, len(new), JOINED_WORDS):
            part = new[start : start + JOINED_WORDS]
            text = " " + " ".join(part)
            ids = self._encode([text])[0]
            at = (np.flatnonzero(begins[np.frombuffer(ids, "<u4")]) * 4).tolist()
            if len(at) != len(part) or self.odd(text):  # white space at an end of a word
                remember(zip(part, self._encode([" " + w for w in part])))
            else:
                remember(zip(part, map(ids.__getitem__, map(slice, at, [*at[1:], None]))))

    def _learn(self, unseen: set[str]) -> None:
        words = self.words
        marked = [w for w in unseen if w and w[-1] in PUNCTUATION]
        stems = [w.rstrip(PUNCTUATION) for w in marked]
        split = [(w, s) for w, s in zip(marked, stems) if s and s[-1].isalnum()]
        unseen.difference_update([w for w, _ in split])
        unseen.update([s for _, s in split if s not in words])
        self._learn_plain(list(unseen))
        tails = list({w[len(s) :] for w, s in split})
        tail_ids = dict(zip(tails, self._encode(tails)))
        words.update([(w, words[s] + tail_ids[w[len(s) :]]) for w, s in split])

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        pieces = [None if self.odd(t) or SPECIAL in t else t.split(" ") for t in texts]
        heads = self._encode([t if p is None else p.pop(0) for t, p in zip(texts, pieces)])
        words = self.words
        if len(words) > REMEMBERED:
            words.clear()
        self._learn(set().union(*filter(None, pieces)).difference(words))
        get = words.__getitem__
        return [h + b"".join(map(get, p)) if p else h for h, p in zip(heads, pieces)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``n_tokens`` of every row, without an end token; null texts have none. One narrow pass, no ids are kept."""
    source = df.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            counts = [len(ids) // 4 for at in range(0, len(texts), 256) for ids in encode(texts.slice(at, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[id_col, "n_tokens"])

    return source.mapInArrow(run, source.select(id_col).schema.add("n_tokens", "long"))


class Writer:
    """Collects documents into frames; ``data`` gives the file's bytes so far and forgets them."""

    def __init__(self, level: int = 1):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.sizes: list[int] = []
        self.frames: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = 0

    def add(self, ids: bytes) -> bytes:
        """Adds one document; returns the bytes of a frame when one is full, else nothing."""
        self.sizes.append(len(ids) // 4)
        self.open.append(ids)
        self.open_bytes += len(ids)
        return self.close_frame() if self.open_bytes >= FRAME_BYTES else b""

    def close_frame(self) -> bytes:
        if not self.open:
            return b""
        raw = b"".join(self.open)
        packed = self.compress(raw)
        self.frames.append((len(self.open), len(packed), len(raw), zlib.crc32(raw)))
        self.open, self.open_bytes = [], 0
        return packed

    def index(self) -> bytes:
        lists = np.asarray(self.sizes, dtype="<u4").tobytes() + np.asarray(self.frames, dtype="<u4").tobytes()
        footer = struct.pack("<4I", len(self.sizes), len(self.frames), zlib.crc32(lists), FOOTER_MAGIC)
        return struct.pack("<2I", INDEX_MAGIC, len(lists) + len(footer)) + lists + footer


class Reader:
    """Random access to the documents of one file, given as a seekable binary stream."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.decompress = stream, zstandard.ZstdDecompressor().decompress
        end = stream.seek(0, 2)
        if end < 24:
            raise ValueError("no index: the file is too short")
        stream.seek(end - 16)
        docs, frames, crc, magic = struct.unpack("<4I", stream.read(16))
        if magic != FOOTER_MAGIC:
            raise ValueError("no index: the footer's magic number is missing")
        size = 4 * docs + 16 * frames
        stream.seek(end - 16 - size)
        lists = stream.read(size)
        if zlib.crc32(lists) != crc:
            raise ValueError("the index does not match its checksum")
        self.sizes = np.frombuffer(lists, "<u4", docs).astype(np.int64)
        self.frames = np.frombuffer(lists, "<u4", 4 * frames, 4 * docs).reshape(-1, 4).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.frames[:, 0])]).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 1])]).astype(np.int64)

    def frame(self, k: int) -> bytes:
        self.stream.seek(int(self.at[k]))
        docs, packed, size, crc = (int(v) for v in self.frames[k])
        raw = self.decompress(self.stream.read(packed), max_output_size=size) if size else b""
        if len(raw) != size or zlib.crc32(raw) != crc:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def documents(self, wanted: Sequence[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(number in the file, ids) of the wanted documents, ascending; only their frames are read."""
        wanted = range(len(self.sizes)) if wanted is None else sorted(set(wanted))
        now, raw, starts = -1, b"", None
        for n in wanted:
            k = int(np.searchsorted(self.first, n, side="right")) - 1
            if k != now:
                now, raw = k, self.frame(k)
                own = self.sizes[self.first[k] : self.first[k + 1]]
                starts = np.concatenate([[0], np.cumsum(own)]).astype(np.int64)
            i = n - int(self.first[k])
            yield n, np.frombuffer(raw, "<u4", int(self.sizes[n]), 4 * int(starts[i]))


def _store(uri: str):
    """(file system, path) for a URI of any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_files(
    df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> DataFrame:
    """Encodes all texts and writes one file per range of ids; returns (id, file_no, file, place, n_tokens).

    Ids ascend through the files, null ids first. A null text is an empty one and
    has only the end id; repeated rows are written each for itself; an empty
    table writes nothing. A task writes under a name of its own and renames
    at the end, so a task that runs again after a loss puts the same file in
    the same place. The result is a written table.
    """
    ordered = df.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    id_type = ordered.schema["_id"].dataType.simpleString()
    ordered = ordered.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    end = np.asarray([end_id], dtype="<u4").tobytes()
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, place, sink = encoder(tokenizer), Writer(), 0, None
        number = TaskContext.get().partitionId()
        store, base = _store(folder)
        name, draft = f"{base}/part-{number:06d}.ids.zst", f"{base}/.part-{number:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                if not piece.num_rows:
                    continue
                if sink is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(draft)
                counts = []
                for ids in encode(piece.column(1).to_pylist()):
                    counts.append(len(ids) // 4 + 1)
                    if data := writer.add(ids + end):
                        sink.write(data)
                rows = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([number] * rows, pa.int32()),
                        pa.array([f"{folder}/part-{number:06d}.ids.zst"] * rows),
                        pa.array(range(place, place + rows), pa.int32()),
                        pa.array(counts, pa.int64()),
                    ],
                    names=["_id", "file_no", "file", "place", "n_tokens"],
                )
                place += rows
        if sink is not None:
            sink.write(writer.close_frame())
            sink.write(writer.index())
            sink.close()
            store.move(draft, name)

    schema = f"_id {id_type}, file_no int, file string, place int, n_tokens bigint"
    return cut(ordered.mapInArrow(run, schema).withColumnRenamed("_id", id_col), "token-index")


def read_files(wanted: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(file, place, n_tokens, ids_crc32, *keep) of the documents in ``wanted`` (file, place, *keep).

    Files are spread over tasks; each task opens its files one after the other
    and decompresses only the frames that hold wanted documents.
    """
    keep = list(keep)
    spread = wanted.select("file", "place", *keep).repartition("file").sortWithinPartitions("file", "place")
    types = {f.name: f.dataType.simpleString() for f in spread.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, stream = None, None, None
        for batch in batches:
            files, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            counts, crcs, start = [], [], 0
            while start < len(files):
                stop = start
                while stop < len(files) and files[stop] == files[start]:
                    stop += 1
                if files[start] != now:
                    if stream is not None:
                        stream.close()
                    now = files[start]
                    store, path = _store(now)
                    stream = store.open_input_file(path)
                    reader = Reader(stream)
                got = {n: (len(ids), zlib.crc32(ids.tobytes())) for n, ids in reader.documents(places[start:stop])}
                counts += [got[n][0] for n in places[start:stop]]
                crcs += [got[n][1] for n in places[start:stop]]
                start = stop
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                names=[*batch.schema.names, "n_tokens", "ids_crc32"],
            )
        if stream is not None:
            stream.close()

    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + ", n_tokens bigint, ids_crc32 bigint"
    return spread.mapInArrow(run, schema)


def token_digest(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the files, reads them back: id, ``start``, ``n_tokens``, ``ids_crc32`` per row of ``df``."""
    written = write_files(df, folder or scratch_path(df.sparkSession, "token-files"), tokenizer, id_col, text_col)
    back = cut(read_files(written, [id_col, "file_no"]), "token-digest")
    # offsets of files from their totals, then of documents inside a file: no task owns more than a file's index
    totals = back.groupBy("file_no").agg(F.sum("n_tokens").alias("_sum"))
    past = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(totals.select("file_no", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_before")), "offsets")
    inside = Window.partitionBy("file_no").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return back.join(offsets, "file_no").select(
        id_col,
        (F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
