"""Point-cloud files as DataFrames: PCD, PLY and NPY through ``binaryFile``, text through ``text``."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, point_id long, x double, y double, z double"
CHUNK = 200_000

# Scalar types of the two formats.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


def lzf_expand(data: bytes, size: int) -> bytes:
    """Undo LZF: literal runs and back references; the result must have exactly ``size`` bytes."""
    out, i = bytearray(), 0
    while i < len(data):
        head = data[i]
        i += 1
        if head < 32:
            out += data[i : i + head + 1]
            i += head + 1
            continue
        length = head >> 5
        if length == 7:
            length += data[i]
            i += 1
        start = len(out) - ((head & 31) << 8) - data[i] - 1
        i += 1
        if start < 0:
            raise ValueError("back reference before the start of the data")
        for j in range(length + 2):  # the source may overlap what is being written
            out.append(out[start + j])
    if len(out) != size:
        raise ValueError(f"expanded to {len(out)} bytes, expected {size}")
    return bytes(out)


def parse_pcd(raw: bytes) -> np.ndarray:
    head, pos = {}, 0
    while "DATA" not in head:
        end = raw.index(b"\n", pos)
        words = raw[pos:end].decode("ascii", "replace").split("#")[0].split()
        pos = end + 1
        if words:
            head[words[0].upper()] = words[1:]
    names = [n.lower() for n in head["FIELDS"]]
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    types = [t.lower() + s for t, s in zip(head["TYPE"], head["SIZE"])]
    n = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    for a in "xyz":
        if a not in names or counts[names.index(a)] != 1:
            raise ValueError(f"field {a} is missing or repeated")
    kind, body = head["DATA"][0].lower(), raw[pos:]
    if kind == "ascii":
        table = np.loadtxt(io.BytesIO(body), ndmin=2)
        at = np.cumsum([0, *counts])
        if table.shape != (n, at[-1]):
            raise ValueError(f"expected {n} rows of {at[-1]} values, got {table.shape}")
        return np.stack([table[:, at[names.index(a)]] for a in "xyz"], axis=1)
    layout = np.dtype([(f"f{i}", "<" + t, (c,) if c > 1 else ()) for i, (t, c) in enumerate(zip(types, counts))])
    if kind == "binary":
        if len(body) < n * layout.itemsize:
            raise ValueError("binary body is too short")
        rows = np.frombuffer(body, layout, n)
        return np.stack([rows[f"f{names.index(a)}"].astype(float) for a in "xyz"], axis=1)
    if kind != "binary_compressed":
        raise ValueError(f"unknown DATA {kind}")
    packed, size = struct.unpack("<II", body[:8])
    if size != n * layout.itemsize or len(body) < 8 + packed:
        raise ValueError("compressed body does not fit the header")
    flat, out, at = lzf_expand(body[8 : 8 + packed], size), {}, 0
    for name, t, c in zip(names, types, counts):  # compressed bodies hold one field after the other
        width = np.dtype(t).itemsize * c * n
        if name in "xyz" and name not in out:
            out[name] = np.frombuffer(flat[at : at + width], "<" + t).astype(float)
        at += width
    return np.stack([out[a] for a in "xyz"], axis=1)


def parse_ply(raw: bytes) -> np.ndarray:
    end = raw.index(b"end_header")
    body = raw[raw.index(b"\n", end) + 1 :]
    order, n, props, current = None, 0, [], None
    skip_rows = 0
    for line in raw[:end].decode("ascii").splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "format":
            order = w[1]
        elif w[0] == "element":
            current = w[1]
            if current == "vertex":
                n = int(w[2])
            elif n == 0:
                skip_rows = 1
        elif w[0] == "property" and current == "vertex":
            if w[1] == "list":
                raise ValueError("list property in the vertex element")
            props.append((w[2], PLY_TYPES[w[1]]))
    if skip_rows:
        raise ValueError("an element precedes the vertex element")
    names = [p[0] for p in props]
    if order == "ascii":
        rows = np.loadtxt(io.BytesIO(body), max_rows=n, ndmin=2)
        return rows[:, [names.index(a) for a in "xyz"]].astype(float)
    mark = {"binary_little_endian": "<", "binary_big_endian": ">"}[order]
    layout = np.dtype([(name, mark + t) for name, t in props])
    if len(body) < n * layout.itemsize:
        raise ValueError("vertex data is too short")
    rows = np.frombuffer(body, layout, n)
    return np.stack([rows[a].astype(float) for a in "xyz"], axis=1)


def parse(path: str, raw: bytes) -> np.ndarray:
    """Coordinates of one file; fewer than three columns, no rows or non-finite values are errors."""
    low = path.lower()
    if low.endswith(".pcd"):
        xyz = parse_pcd(raw)
    elif low.endswith(".ply"):
        xyz = parse_ply(raw)
    else:
        xyz = np.load(io.BytesIO(raw), allow_pickle=False)
        if xyz.ndim != 2 or xyz.shape[1] < 3:
            raise ValueError(f"{path}: needs at least three columns")
        xyz = xyz[:, :3].astype(float)
    if len(xyz) == 0 or not np.isfinite(xyz).all():
        raise ValueError(f"{path}: empty or non-finite")
    return xyz


def _read(batches):
    for pdf in batches:
        for path, raw in zip(pdf["path"], pdf["content"]):
            xyz = parse(path, raw)
            for at in range(0, len(xyz), CHUNK):
                part = xyz[at : at + CHUNK]
                yield pd.DataFrame(
                    {"path": path, "point_id": np.arange(at, at + len(part)), "x": part[:, 0], "y": part[:, 1], "z": part[:, 2]}
                )


def read_binary_clouds(spark: SparkSession, root: str, pattern: str = "*.{pcd,ply,npy}", only: DataFrame | None = None) -> DataFrame:
    """(path, point_id, x, y, z): a file is one record of ``binaryFile``, files spread over tasks; ``only`` lists the paths to parse."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    if only is not None:
        files = files.join(only, "path", "left_semi")
    return files.select("path", "content").mapInPandas(_read, SCHEMA)


def read_text_clouds(spark: SparkSession, root: str, pattern: str = "*.{txt,xyz,csv}") -> DataFrame:
    """(path, point_id, values): numeric rows, comma or blank separated, in file order.

    Text is splittable, so large files are read by many tasks; the row number
    comes from the order of splits and rows.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    rows = rows.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.trim("value").alias("value"),
    ).where(F.col("value") != "")
    order = Window.partitionBy("path").orderBy("block", "seq")
    values = F.transform(F.split("value", r"[,\s]+"), lambda v: v.cast("double"))
    return rows.select("path", (F.row_number().over(order) - 1).cast("long").alias("point_id"), values.alias("values"))


def read_clouds(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """All supported files under ``root``, or those whose path ``only`` lists, as (path, point_id, x, y, z)."""
    text = read_text_clouds(spark, root)
    if only is not None:
        text = text.join(only, "path", "left_semi")
    # a row with fewer than three numbers, or with one that is not finite, is an error as in the binary readers
    spot = F.slice("values", 1, 3)
    sound = (F.size("values") >= 3) & F.forall(spot, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    checked = F.when(sound, spot).otherwise(F.raise_error(F.concat(F.lit("fewer than three finite columns in "), F.col("path"))))
    text = text.withColumn("values", checked)
    text = text.select("path", "point_id", *[F.get("values", F.lit(i)).alias(a) for i, a in enumerate("xyz")])
    return read_binary_clouds(spark, root, only=only).unionByName(text)
