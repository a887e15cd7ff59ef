"""Smallest eigenpairs of a cloud's normalised Laplacian, and heat-kernel signatures.

Chebyshev-filtered subspace iteration for all clouds at once. A cloud of bounded
size is one block and goes through a filter in its task, or is solved there to the end
where it is not small (see :mod:`pointweave.operators.krylov`); the vectors of a larger one
are spread over row blocks, where a filter step is one exchange of
vector rows between blocks. Orthogonalisation and Ritz values come from Gram
sums that Spark adds up, and only matrices of the subspace's width meet in one
task. Everything after the eigenpairs is Catalyst.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators import krylov, rowblocks as B
from pointweave.session import cut, discard

#: steps of a filter at most, how much it may favour the smallest value (so that Gram sums keep their digits), and rounds at most
DEGREE, FAVOUR, ROUNDS = 40, 1e6, 80
#: a cloud is done when the vectors before its last filter had residuals below this; the filter then cuts them much further
TOLERANCE = 1e-5
#: the first filter, on random vectors: steps, and what it damps
FIRST_DEGREE, FIRST_HIGH = 8, 1.0
#: rows of a cloud that one block holds at most, and the bytes of its vectors at most; larger clouds are spread over blocks
WHOLE_ROWS, WHOLE_BYTES = 1 << 18, 3 << 28
#: vectors that a cloud solved in its task holds beside those of a subspace, about, and rows from which on it is solved there
BASES, KRYLOV_ROWS = 3, 8192
#: vectors that go through the filter at once, points that leave at once
PANEL, POINTS = 16, 4096
#: first place of the terms that are sums of squared residuals
RESIDUAL = -1


def _width(n: int, k: int) -> int:
    return min(n, k + max(10, k // 5))


def _filter(k: int):
    """A block's turn: rotate its vectors as ordered, go through the filter as far as messages allow, then hold its Gram terms."""

    def turn(own: dict, messages: dict[int, np.ndarray], order) -> Iterator[tuple[int, int, bytes]]:
        if order is not None:
            vectors = own["vectors"] @ order["turn"]
            if order["done"]:
                own = {"block": own["block"], "result": {"ids": own["ids"], "values": order["values"], "vectors": vectors}}
            else:
                own.update(vectors=vectors, ritz=order["values"], degree=order["degree"], high=order["high"], step=0, residual=None)
        elif "vectors" not in own and "result" not in own:
            rng = np.random.default_rng([zlib.crc32(own["cloud"].encode()), own["block"]])
            start = rng.standard_normal((len(own["ids"]), _width(own["n"], k)))
            own.update(vectors=start, ritz=None, degree=FIRST_DEGREE, high=FIRST_HIGH, step=0, residual=None)
        if "result" in own or own["step"] > own["degree"]:
            yield B.keep(own)
            return
        half, mid = (2.0 - own["high"]) / 2.0, (2.0 + own["high"]) / 2.0
        if not own["halo"]:
            _filter_alone(own, half, mid)
            yield B.keep(own)
            return
        while messages:
            x = own["vectors"]
            y = B.product(own, x, messages)
            if own["step"] == 0 and own["ritz"] is not None:
                own["residual"] = ((y - x * own["ritz"]) ** 2).sum(axis=0)
            own["step"] += 1
            if own["step"] > own["degree"]:
                own.update(before=None, gram=x.T @ x, energy=x.T @ y)
                yield B.keep(own)
                return
            shifted = (y - mid * x) / half
            own["before"], own["vectors"] = x, shifted if own["step"] == 1 else 2.0 * shifted - own["before"]
            messages = {}
        yield from B.send(own, own["vectors"])
        yield B.keep(own)

    return turn


def _filter_alone(own: dict, half: float, mid: float) -> None:
    """The whole filter where nothing is exchanged, on a few vectors at once, so that only those need room for a step."""
    x, ritz, times = own["vectors"], own["ritz"], B.products_alone(own)
    panels = [slice(at, at + PANEL) for at in range(0, x.shape[1], PANEL)]
    residual, energy = None if ritz is None else np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
    for some in panels:
        before, now = None, np.ascontiguousarray(x[:, some])
        for step in range(own["degree"]):
            y = times(now)
            if step == 0 and ritz is not None:
                residual[some] = ((y - now * ritz[some]) ** 2).sum(axis=0)
            shifted = (y - mid * now) / half
            before, now = now, shifted if step == 0 else 2.0 * shifted - before
        x[:, some] = now
    for some in panels:
        energy[:, some] = x.T @ times(np.ascontiguousarray(x[:, some]))
    own.update(step=own["degree"] + 1, residual=residual, gram=x.T @ x, energy=energy)


def _give(own: dict) -> Iterator[tuple]:
    if "result" in own:
        yield B.whole(B.RESULT, own["result"])
        return
    gram, energy = own.pop("gram"), own.pop("energy")
    i, j = np.triu_indices(len(gram))
    yield B.TERM, None, i, j, gram[i, j], energy[i, j]
    if own["residual"] is not None:
        n = len(own["residual"])
        yield B.TERM, None, np.full(n, RESIDUAL), np.arange(n), own["residual"], np.zeros(n)
    yield B.whole(B.STATE, own)


def _ritz(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ritz values of one cloud from its summed Gram terms, and what its blocks do next."""
    k, i, j = int(pdf["k"].iloc[0]), pdf["i"].to_numpy(), pdf["j"].to_numpy()
    gram, own = np.zeros((2, pdf["j"].max() + 1, pdf["j"].max() + 1)), i >= 0
    for m, c in zip(gram, ("g", "h")):
        m[i[own], j[own]] = pdf[c].to_numpy()[own]
        m[j[own], i[own]] = pdf[c].to_numpy()[own]
    scale = 1.0 / np.sqrt(np.maximum(np.diag(gram[0]), 1e-300))
    sizes, axes = np.linalg.eigh(gram[0] * scale[:, None] * scale)
    alive = sizes > 1e-13 * sizes[-1]
    basis = scale[:, None] * axes[:, alive] / np.sqrt(sizes[alive])
    if basis.shape[1] < k:
        raise ArithmeticError(f"the vectors of cloud {pdf['cloud_id'].iloc[0]} lost their independence")
    values, turn = np.linalg.eigh(basis.T @ gram[1] @ basis)
    squares = pdf["g"].to_numpy()[i == RESIDUAL][np.argsort(j[i == RESIDUAL])][:k]
    worst = float(np.sqrt(np.maximum(squares, 0.0)).max(initial=0.0)) if (i == RESIDUAL).any() else math.inf
    done = worst <= TOLERANCE
    high = float(min(max(values[-1], 1e-6), 1.9))
    degree = max(2, min(DEGREE, int(math.acosh(FAVOUR) / math.acosh((2.0 + high) / (2.0 - high)))))
    kept = slice(k) if done else slice(None)
    told = {"turn": (basis @ turn)[:, kept], "values": np.clip(values[kept], 0.0, 2.0), "done": done, "degree": degree, "high": high}
    return pd.DataFrame({"cloud_id": [pdf["cloud_id"].iloc[0]], "component": [0], "data": [B.freeze(told)], "worst": [worst], "degree": [degree]})


EIGENPAIRS = "cloud_id string, point_id long, lambdas array<double>, phi array<double>"


def _pairs(cloud: str, ids: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    n, k = vectors.shape
    lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * k, np.ascontiguousarray(x).ravel()) for x in (np.tile(values, (n, 1)), vectors)]
    return pa.RecordBatch.from_arrays([pa.array([cloud] * n), pa.array(ids), *lists], names=["cloud_id", "point_id", "lambdas", "phi"])


def _point_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cloud, data in zip(*(batch.column(c).to_pylist() for c in range(2))):
            found = B.thaw(data)
            for at in range(0, len(found["ids"]), POINTS):
                yield _pairs(cloud, found["ids"][at : at + POINTS], found["values"], found["vectors"][at : at + POINTS])


def _alone(k: int):
    """The pairs of every cloud that is one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = B.thaw(batch.column(0)[r].as_py())
                cloud, ids = block["cloud"], block["ids"]
                row = np.repeat(block["row"], np.diff(np.append(block["starts"], len(block["col"]))))
                matrix = krylov.Matrix(row, block["col"], block["value"], len(ids))
                values, pieces = krylov.smallest(matrix, min(k, len(ids) - 1), zlib.crc32(cloud.encode()))
                ids = ids[matrix.order]
                at = 0
                for vectors in pieces:
                    yield _pairs(cloud, ids[at : at + len(vectors)], values, vectors)
                    at += len(vectors)

    return run


def smallest_eigenpairs(laplacian: DataFrame, k: int = 100, points: DataFrame | None = None, block_rows: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """(cloud_id, point_id, lambdas, phi): the ``k`` smallest eigenvalues of the cloud (one fewer than its points at most) and this point's eigenvector entries.

    ``laplacian`` is symmetric with a diagonal in every row and a spectrum in
    [0, 2]. ``points`` (with x, y, z) lets blocks be pieces of space, so that
    they exchange little; without it they are ranges of ids. Raises where a
    cloud doesn't settle within ``rounds``.
    """
    component = F.lit(0).cast("long").alias("component")
    entries = cut(laplacian.select("cloud_id", component, "src", "dst", "value"), "entries")
    if points is None:
        ordered = entries.select("cloud_id", "component", F.col("src").alias("point_id"), F.col("src").alias("at")).distinct()
    else:
        ordered = B.space_order(points).select("cloud_id", component, "point_id", "at")
    whole = min(WHOLE_ROWS, WHOLE_BYTES // (8 * BASES * _width(WHOLE_ROWS, k)))
    most = F.when(F.col("n") <= whole, whole).otherwise(B.BLOCK_ROWS)
    table = B.build_blocks(entries, cut(B.row_places(cut(ordered, "ordered"), block_rows or most), "places"))
    blocks = cut(table.select(*B.KEY, "block", "blocks", "n", F.least(F.col("n") - 1, F.lit(k)).cast("int").alias("k")), "block_list")
    alone = (F.col("blocks") == 1) & (F.col("n") > KRYLOV_ROWS)
    single = blocks.where(alone).count()
    blocks, done = blocks.where(~alone).drop("n"), []
    if single:
        # one cloud a task
        large = table.where(alone).repartitionByRange(single, "cloud_id").select("data")
        done.append(cut(large.mapInArrow(_alone(k), EIGENPAIRS), "eigenpairs"))
    table = table.where(~alone)
    several, number = blocks.agg(F.max("blocks"), F.count(F.lit(1))).first()
    if not number:
        return done[0] if done else laplacian.sparkSession.createDataFrame([], EIGENPAIRS)
    wanted = blocks.groupBy(*B.KEY).agg(F.first("k").alias("k"))
    rows, products, small, old = B.state(table), FIRST_DEGREE + 1, [], []
    for _ in range(rounds):
        out = B.release(B.chain(rows, blocks, _filter(k), products if several > 1 else 0, B.task_count(number)), _give)
        counts = {name: F.count(F.when(F.col("kind") == kind, 1)) for name, kind in (("going", B.STATE), ("ready", B.RESULT))}
        out = cut(out, "round", **counts)
        discard(*old)
        if out.seen["ready"]:
            small.append(out.where(F.col("kind") == B.RESULT).select("cloud_id", "data"))
        old = [] if out.seen["ready"] else [out]
        if not out.seen["going"]:
            break
        sums = out.where(F.col("kind") == B.TERM).groupBy(*B.KEY, "i", "j").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        solved = sums.join(wanted, B.KEY).groupBy(*B.KEY).applyInPandas(_ritz, "cloud_id string, component long, data binary, worst double, degree int")
        told = cut(solved, "told", degree=F.max("degree"), worst=F.max("worst"))
        products = told.seen["degree"] + 1
        rows = B.state(out.where(F.col("kind") == B.STATE)).unionByName(B.orders(blocks, told))
    else:
        raise ArithmeticError(f"the {k} smallest eigenvalues did not settle in {rounds} rounds: residual {told.seen['worst']:.3g}")
    found = small[0]
    for more in small[1:]:
        found = found.unionByName(more)
    done.append(cut(found.mapInArrow(_point_rows, EIGENPAIRS), "eigenpairs"))
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def heat_signatures(pairs: DataFrame, scales: int = 3, eps: float = 1e-6) -> DataFrame:
    """(cloud_id, point_id, hks): sum of exp(-lambda t) phi^2 at log-spaced times.

    Times run from 4 ln 10 / lambda_max to 4 ln 10 / lambda_2, the smallest eigenvalue above ``eps``.
    """
    span = 4.0 * math.log(10.0)
    top = F.greatest(F.array_max("lambdas"), F.lit(eps))
    live = F.filter("lambdas", lambda v: v > eps)
    second = F.greatest(F.coalesce(F.array_min(live), F.get("lambdas", F.lit(1)), F.get("lambdas", F.lit(0))), F.lit(eps))
    out = pairs.withColumn("t0", F.lit(span) / top).withColumn("t1", F.lit(span) / second)
    out = out.withColumn("lo", F.greatest(F.least("t0", "t1"), F.lit(eps)))
    out = out.withColumn("hi", F.greatest(F.greatest("t0", "t1"), F.col("lo") * (1.0 + 1e-12)))
    powers = []
    for i in range(scales):
        share = i / (scales - 1) if scales > 1 else 0.0
        t = F.greatest(F.pow(F.lit(10.0), F.log10("lo") + (F.log10("hi") - F.log10("lo")) * share), F.lit(eps))
        powers.append(t.alias(f"time{i}"))
    out = out.select("cloud_id", "point_id", "lambdas", "phi", *powers)
    def signature(i):
        terms = F.zip_with("lambdas", "phi", lambda lam, p: F.exp(-lam * F.col(f"time{i}")) * p * p)
        return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term).alias(f"hks{i}")

    signs = [signature(i) for i in range(scales)]
    return out.select("cloud_id", "point_id", *signs)
