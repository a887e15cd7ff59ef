import numpy as np
import pandas as pd

from pointweave.session import cut


def cloud(spark, xyz, name="a", ids=None):
    xyz = np.asarray(xyz, dtype=float)
    ids = np.arange(len(xyz)) if ids is None else ids
    return cut(spark.createDataFrame(pd.DataFrame({"cloud_id": name, "point_id": ids, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})))


def edges(spark, pairs, name="a"):
    rows = [(name, int(a), int(b), 1.0) for a, b in pairs] + [(name, int(b), int(a), 1.0) for a, b in pairs]
    return cut(spark.createDataFrame(rows, "cloud_id string, src long, dst long, dist double"))


def points(spark, ids, name="a", **cols):
    return cut(spark.createDataFrame(pd.DataFrame({"cloud_id": name, "point_id": list(ids), **cols})))


def brute_knn(xyz, k):
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    return [np.lexsort((np.arange(len(xyz)), row))[:k].tolist() for row in d2]
