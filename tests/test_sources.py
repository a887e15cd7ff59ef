import struct

import numpy as np
import pytest
from helpers import cloud, points

from pointweave.config import Settings
from pointweave.operators import labels as L
from pointweave.sources import discover, formats, sinks
from pointweave.streaming.incoming import incoming_clouds, process_incoming

XYZ = np.arange(12, dtype=float).reshape(4, 3) / 3


def lzf_literals(data):
    return b"".join(bytes([len(data[i : i + 32]) - 1]) + data[i : i + 32] for i in range(0, len(data), 32))


def test_pcd_encodings():
    head = "VERSION 0.7\nFIELDS x y z i\nSIZE 4 4 4 2\nTYPE F F F U\nCOUNT 1 1 1 2\nWIDTH 4\nHEIGHT 1\nPOINTS 4\nDATA "
    rows = np.zeros(4, np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("i", "<u2", (2,))]))
    for i, a in enumerate("xyz"):
        rows[a] = XYZ[:, i]
    ascii_ = head + "ascii\n" + "\n".join(" ".join(map(str, [*p, 1, 2])) for p in XYZ)
    flat = b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in ("x", "y", "z", "i"))
    packed = lzf_literals(flat)
    for raw in (
        ascii_.encode(),
        (head + "binary\n").encode() + rows.tobytes(),
        (head + "binary_compressed\n").encode() + struct.pack("<II", len(packed), len(flat)) + packed,
        sinks.pcd_bytes(XYZ),
    ):
        assert np.allclose(formats.parse_pcd(raw), XYZ, atol=1e-6)


def test_lzf_back_reference():
    assert formats.lzf_expand(bytes([0, 65, 0x80, 0]), 7) == b"A" * 7
    with pytest.raises(ValueError):
        formats.lzf_expand(bytes([0, 65]), 2)


def test_ply_encodings():
    for order, mark in (("ascii", None), ("binary_little_endian", "<"), ("binary_big_endian", ">")):
        head = f"ply\nformat {order} 1.0\nelement vertex 4\nproperty double x\nproperty float q\nproperty double y\nproperty double z\nend_header\n"
        if mark is None:
            body = "\n".join(f"{a} 7 {b} {c}" for a, b, c in XYZ).encode()
        else:
            rows = np.zeros(4, [("x", mark + "f8"), ("q", mark + "f4"), ("y", mark + "f8"), ("z", mark + "f8")])
            for i, a in enumerate("xyz"):
                rows[a] = XYZ[:, i]
            body = rows.tobytes()
        assert np.allclose(formats.parse_ply(head.encode() + body), XYZ)


def test_reading_discovery_and_stream(spark, tmp_path):
    for folder in ("test", "gt", "good"):
        (tmp_path / "fish" / folder).mkdir(parents=True)
    (tmp_path / "fish/test/a.pcd").write_bytes(sinks.pcd_bytes(XYZ))
    np.save(tmp_path / "fish/test/a.npy", XYZ)
    (tmp_path / "fish/good/b_good.xyz").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "fish/gt/a.txt").write_text("0\n1\n0\n0\n")
    files = discover.list_files(spark, str(tmp_path)).cache()
    bad = discover.defective_samples(files, "d").collect()
    assert [(r.sample_id, r.pc_path.rsplit("/", 1)[1]) for r in bad] == [("a", "a.pcd")]
    assert [r.sample_id for r in discover.good_samples(files, "d").collect()] == ["b_good"]
    got = formats.read_clouds(spark, str(tmp_path / "fish/test")).toPandas()
    assert len(got) == 8 and got.point_id.max() == 3
    text = formats.read_text_clouds(spark, str(tmp_path / "fish/good")).orderBy("point_id").collect()
    assert [list(r["values"]) for r in text] == [[1, 2, 3], [4, 5, 6]]
    seen = []
    run = process_incoming(
        incoming_clouds(spark, str(tmp_path / "fish/test")), lambda df, i: seen.append(df.count()), str(tmp_path / "ckpt")
    )
    run.awaitTermination(60)
    assert sum(seen) == 8


def test_truth_alignment(spark):
    x = np.random.default_rng(0).normal(size=(60, 3))
    p = cloud(spark, x)
    gt = spark.createDataFrame([("a", *np.round(x[i], 5).tolist(), float(i % 2)) for i in range(10)], "cloud_id string, x double, y double, z double, label double")
    out = L.align_coordinates(p, gt).where("defect").toPandas()
    assert sorted(out.point_id) == [1, 3, 5, 7, 9]
    off = gt.withColumn("x", gt.x + 0.001)
    assert sorted(L.align_coordinates(p, off).where("defect").toPandas().point_id) == [1, 3, 5, 7, 9]


def test_label_vectors(spark):
    p = points(spark, range(4))
    one = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 4.0)], "cloud_id string, row long, value double")
    assert sorted(L.from_vector(p, one).where("defect").toPandas().point_id) == [1, 3]
    full = spark.createDataFrame([("a", i, float(i == 2)) for i in range(4)], "cloud_id string, row long, value double")
    assert sorted(L.from_vector(p, full).where("defect").toPandas().point_id) == [2]


def test_settings_round_trip():
    s = Settings(va_gamma=5.0)
    assert Settings.load(s.snapshot()) == s and s.digest() != Settings().digest()
    with pytest.raises(ValueError):
        Settings.load('{"config": {"no_such": 1}}')


def test_tolerance_is_three_median_spacings(spark):
    grid = cloud(spark, [[float(i), 0.0, 0.0] for i in range(10)] + [[0.0, 0.0, 0.0]])
    lone = cloud(spark, [[5.0, 5.0, 5.0]], name="b")
    got = {r.cloud_id: r.tolerance for r in L.spacing_tolerance(grid.unionByName(lone)).collect()}
    assert got == {"a": pytest.approx(3.0), "b": pytest.approx(1e-8)}
    gt = spark.createDataFrame([("a", 9.0, 2.5, 0.0, 1.0), ("b", 5.0, 5.0, 5.0, 1.0)], "cloud_id string, x double, y double, z double, label double")
    hit = L.align_coordinates(grid.unionByName(lone), gt).where("defect").collect()
    assert sorted((r.cloud_id, r.point_id) for r in hit) == [("a", 9), ("b", 0)]


def test_unusable_vector_gives_no_label(spark):
    p = points(spark, range(4))
    odd = spark.createDataFrame([("a", 0, 2.5), ("a", 1, 99.0)], "cloud_id string, row long, value double")
    assert L.from_vector(p, odd).count() == 0


def test_cache_refuses_other_settings_and_repeats(spark, tmp_path):
    from pointweave.sources.sinks import read_cache, write_cache

    p = points(spark, range(4), x=1.0).selectExpr("*", "'fish' as category")
    write_cache(p, str(tmp_path / "c"), "one")
    assert read_cache(spark, str(tmp_path / "c"), "one").count() == 4
    with pytest.raises(ValueError):
        read_cache(spark, str(tmp_path / "c"), "two").select("x")
    write_cache(p.unionByName(p), str(tmp_path / "d"), "one")
    with pytest.raises(ValueError):
        read_cache(spark, str(tmp_path / "d"), "one")


def test_short_text_rows_are_an_error(spark, tmp_path):
    from pointweave.sources.formats import read_clouds

    (tmp_path / "a.xyz").write_text("1 2 3\n4 5\n")
    with pytest.raises(Exception, match="three finite columns"):
        read_clouds(spark, str(tmp_path)).collect()
