"""Whitened leading components of integer vectors, found by contour integration (FEAST).

The fit list holds each distinct vector once. Its number, sums and products are added up exactly, as whole numbers: every partition
multiplies its vectors and Spark adds up the partitions' sums as decimals, so the covariance (n * products - sums * sums) / n**2
is that of centred vectors without any rounding before the one division. What reaches the driver is d * (d + 1) numbers for d dimensions.

Inertia counts (the signs of the pivots of a symmetric indefinite factorisation of V - s) tell how many eigenvalues lie above any s. By bisection they
bracket the wanted eigenvalues and the next one; intervals are then cut in the gaps between them, eigenvalues of one cluster staying together.
For each interval a circle is laid through its ends; the shifted covariance is solved at the nodes of a Gauss-Legendre rule on it, one Spark task
for each node, and the weighted sum projects a block of vectors onto the interval's eigenvectors. Rayleigh-Ritz on the block gives eigenpairs; this is
repeated until their residuals reach double precision and the interval has as many as the inertia counts say, so none is missed.

Cases: rows with a null vector, or one with a null or non-finite entry, are left out. A shorter vector goes on with zeros. Repeated rows
and equal vectors count once in the fit list and each gets its result. A null id stays null. Directions without variance (up to rounding) are no
components, so one distinct vector, or an empty table, gives no rows. A deviation beyond a long's range is null. Only the id and the vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import one_thread, slim, small_batches, written
from ._vectors import integers, stacked

NODES, ROUNDS = 8, 20
#: A gap that parts two clusters, the width of a bracket and the least eigenvalue, as shares of the trace.
GAP, BRACKET, LEAST = 1e-2, 1e-5, 1e-13


def products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers, exact."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if most * most * len(x) < 1 << 53:
        own = x.astype(np.float64)
        return (own.T @ own).astype(np.int64).astype(object)
    own = x.astype(object)
    return own.T @ own


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number, sums and products of the vectors x of fit, exact."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        n, sums, own = 0, np.zeros(d, object), np.zeros((d, d), object)
        for part in parts:
            x = stacked(part["x"], d)
            n, sums, own = n + len(x), sums + x.astype(object).sum(0), own + products(x)
        if n:
            values = [n, *sums, *own[np.triu_indices(d)]]
            yield pd.DataFrame({"k": np.arange(len(values)), "v": [Decimal(int(v)) for v in values]})

    rows = fit.mapInPandas(partial, "k long, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = [int(r.v) for r in sorted(rows, key=lambda r: r.k)] or [0] * (1 + d + d * (d + 1) // 2)
    whole = np.zeros((d, d), object)
    whole[np.triu_indices(d)] = flat[1 + d :]
    return flat[0], flat[1 : 1 + d], np.where(np.tri(d, k=-1, dtype=bool), whole.T, whole)


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric v exceed shift: by Sylvester's law, the positive pivots of a factorisation of v - shift with pivots of one or two
    rows, each chosen as the largest there is."""
    a, count = v - shift * np.eye(len(v)), 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        i = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = np.unravel_index(off.argmax(), off.shape)
        if diagonal[i] == 0 and off[p, q] == 0:
            return count
        # the bound (1 + sqrt(17)) / 8 keeps what is left from growing
        pivot = [i] if diagonal[i] >= 0.6404 * off[p, q] else [int(p), int(q)]
        rest = [k for k in range(len(a)) if k not in pivot]
        own = a[np.ix_(pivot, pivot)]
        count += int(own[0, 0] > 0) if len(pivot) == 1 else 1  # a pivot of two rows has one eigenvalue of either sign
        left = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - left @ np.linalg.solve(own, left.T)
        a = (a + a.T) / 2
    return count


def next_bracket(v: np.ndarray, near: list[float]) -> None:
    """Adds the next smaller eigenvalue to near, the largest ones from the top down, to BRACKET of the trace, by inertia counts."""
    top = float(np.trace(v)) * (1 + 1e-9)
    lo, hi = -BRACKET * top, near[-1] + BRACKET * top if near else top
    while hi - lo > BRACKET * top:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(v, mid) > len(near) else (lo, mid)
    near.append((lo + hi) / 2)


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals from the top down, (from, to, eigenvalues in it), that hold at least the wanted eigenvalues; ends are in gaps."""
    trace, out = float(np.trace(v)), []
    upper, over, near = trace * (1 + 2 * BRACKET), 0, []
    # one more than wanted, and if the last wanted one is in a cluster, all of that
    while len(near) < len(v) and (len(near) <= wanted or near[-2] - near[-1] < GAP * near[0]):
        next_bracket(v, near)
    k = len(near) if len(near) == len(v) and (len(near) <= wanted or near[-2] - near[-1] < GAP * near[0]) else len(near) - 1
    first = 0
    for i in range(k):
        last = i == k - 1
        lower = (near[i] + near[i + 1]) / 2 if i + 1 < len(near) else near[i] - max(GAP * near[0], 4 * BRACKET * trace)
        if last or near[i] - near[i + 1] >= GAP * near[0]:
            n = above(v, lower)
            # an end as far from the eigenvalues as the other one, if no eigenvalue lies beyond it: the circle's middle projects best
            close = min(upper, near[first] + near[i] - lower + 2 * BRACKET * trace)
            if n > over:
                out.append((lower, close if above(v, close) == over else upper, n - over))
            upper, over, first = lower, n, i + 1
    return out


def projected(spark: SparkSession, v: np.ndarray, spans: list[tuple[float, float, int]], blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Each interval's block, projected onto the eigenvectors inside: the rule's sum of complex solves, a task for each node of each interval."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - x))  # the upper half circle; the lower gives the conjugate
    nodes = [(i, float(((a + b) / 2 + (b - a) / 2 * t).real), float(((b - a) / 2 * t).imag), float((y * (b - a) / 4 * t).real), float((y * (b - a) / 4 * t).imag)) for i, (a, b, _) in enumerate(spans) for t, y in zip(turn, w, strict=True)]
    shared = spark.sparkContext.broadcast((v, blocks))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        own, starts = shared.value
        for part in parts:
            for i, zr, zi, wr, wi in part.itertuples(index=False):
                q = np.linalg.solve((zr + 1j * zi) * np.eye(len(own)) - own, starts[i].astype(complex))
                yield pd.DataFrame({"i": [i], "q": [((wr + 1j * wi) * q).real.tobytes()]})

    out = [np.zeros_like(b) for b in blocks]
    frame = spark.createDataFrame(nodes, "i int, zr double, zi double, wr double, wi double").repartition(len(nodes))
    for r in sorted(frame.mapInPandas(solve, "i int, q binary").collect()):  # of nodes times the size of a block
        out[r.i] = out[r.i] + np.frombuffer(r.q).reshape(out[r.i].shape)
    return out


def leading(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of the covariance v, at most as many as wanted, and their eigenvectors as columns."""
    d, scale = len(v), float(np.trace(v))
    if not scale > 0:
        return np.zeros(0), np.zeros((d, 0))
    wanted, own = min(wanted, d, above(v, LEAST * scale)), v / scale
    spans, random = intervals(own, wanted), np.random.default_rng(1)
    blocks, found = [random.normal(size=(d, min(d, 2 * n + 4))) for _, _, n in spans], {}
    for _ in range(ROUNDS):
        open_spans = [i for i in range(len(spans)) if i not in found]
        if not open_spans:
            break
        for i, q in zip(open_spans, projected(spark, own, [spans[i] for i in open_spans], [blocks[i] for i in open_spans]), strict=True):
            basis = np.linalg.qr(q)[0]
            value, turn = np.linalg.eigh(basis.T @ own @ basis)
            vectors = basis @ turn
            lower, upper, n = spans[i]
            inside = (value > lower) & (value <= upper)
            residual = np.abs(own @ vectors - vectors * value).max(0)
            if inside.sum() == n and residual[inside].max() < 1e-15 * math.sqrt(d):
                found[i] = vectors[:, inside]
            blocks[i] = vectors
    if len(found) < len(spans):
        raise ArithmeticError("an interval has other eigenpairs than its inertia counts say")
    basis = np.linalg.qr(np.concatenate([found[i] for i in range(len(spans))], 1))[0]
    value, turn = np.linalg.eigh(basis.T @ own @ basis)
    order = np.argsort(-value, kind="stable")[:wanted]
    return value[order] * scale, (basis @ turn)[:, order]


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error for each row that takes part and each component."""
    spark = df.sparkSession
    small_batches(spark)
    rows = written(integers(slim(df, id=key, vector=vector), "id", "vector"), "vectors")
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
    fit = written(rows.select(padded.alias("x")).distinct(), "fit")
    n, sums, whole = moments(fit, d)
    value, vectors = np.zeros(0), np.zeros((d, 0))
    trace = 0
    if n:
        exact = n * whole - np.outer(np.array(sums, object), np.array(sums, object))
        trace = sum(exact[i, i] for i in range(d))
        value, vectors = leading(spark, np.array([[exact[i, j] / (n * n) for j in range(d)] for i in range(d)]).reshape(d, d), components)
    k = len(value)
    shared = spark.sparkContext.broadcast((n, sums, vectors / np.sqrt(value)))

    def project(x: np.ndarray) -> tuple[np.ndarray, list]:
        """Whitened values and exact deviations."""
        n, sums, turn = shared.value
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)), *(abs(s) // n + 1 for s in sums))
        kind = np.int64 if (2 * n * most) ** 2 * len(sums) < 1 << 63 else object
        off = n * x.astype(kind) - np.array(sums, kind)
        return (off / n).astype(np.float64) @ turn, [int(s) for s in (off * off).sum(1)]

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        for part in parts:
            w, far = project(stacked(part["x"], d))
            yield pd.DataFrame({"id": pd.array(part["id"], "Int64"), "deviation": pd.array([s if s < 1 << 63 else None for s in far], "Int64"), "w": list(w)})

    def columns(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        for part in parts:
            yield pd.DataFrame(project(stacked(part["x"], d))[0], columns=[f"w{i}" for i in range(k)])

    error = 0.0
    if k:
        cov = fit.mapInPandas(columns, ", ".join(f"w{i} double" for i in range(k)))
        got = cov.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i in range(k) for j in range(i, k)]).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(got, [(i, j) for i in range(k) for j in range(i, k)], strict=True))
    share = F.array(*[F.lit(float(e) / (trace / (n * n))) for e in value]) if k else F.array().cast("array<double>")
    source = rows.select("id", "x") if k else rows.select("id", "x").where("false")
    out = source.mapInPandas(each, "id long, deviation long, w array<double>").select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
