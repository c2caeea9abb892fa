"""Spectral embedding: the leading eigenvectors of the normalised graph by subspace iteration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import degree
from weftgraph.plans.lineage import discard, materialize
from weftgraph.plans.workers import map_in_arrow

#: Dimensions at most; triangles that one task of the tree puts together.
MOST_DIMENSIONS, BRANCH = 64, 32


def _rows(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def triangle(rows: np.ndarray, width: int) -> np.ndarray:
    """The triangle R of rows = Q R with its diagonal not below zero, which makes it the same whatever the rows' order."""
    r = np.zeros((width, width))
    found = np.linalg.qr(rows, mode="r")
    r[: len(found)] = found
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def tall_triangle(table: DataFrame, width: int, branch: int = BRANCH) -> np.ndarray:
    """R of the whole table's rows ``x``, arrays of ``width`` numbers, by a tree: each task sends the triangle of its own rows, then of BRANCH triangles, until one is left (Demmel et al., 2012)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                rows = _rows(batch, "x", width)
                r = triangle(rows if r is None else np.concatenate([r, rows]), width)
        if r is not None:
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(r), pa.list_(pa.float64()))})

    level, schema = map_in_arrow(table.select("x"), run, "x array<double>"), "x array<double>"
    left = table.rdd.getNumPartitions()
    while left > branch:
        left = -(-left // branch)
        level = map_in_arrow(level.repartition(left), run, schema)
    found = map_in_arrow(level.coalesce(1), run, schema).collect()
    return np.array([r["x"] for r in found]) if found else np.eye(width)


def _turned(table: DataFrame, by: np.ndarray) -> DataFrame:
    """(v, d, x) with every ``x`` multiplied by a small matrix."""
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, "x", width) @ by
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("d"), lists], names=["v", "d", "x"])

    return map_in_arrow(table.select("v", "d", "x"), run, "v bigint, d bigint, x array<double>")


def _products(table: DataFrame, a: str, b: str, width: int) -> np.ndarray:
    """The sum over all rows of outer products of ``a`` and ``b``."""
    cells = [F.sum(F.get(a, i) * F.get(b, j)) for i in range(width) for j in range(width)]
    row = table.agg(*[c.alias(f"c{n}") for n, c in enumerate(cells)]).first()
    return np.array(row, float).reshape(width, width)


def spectral_embedding(edges: DataFrame, dimensions: int, rounds: int = 60, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """(v, x): the eigenvectors of the ``dimensions`` largest eigenvalues of the normalised adjacency, an array for each vertex; and these eigenvalues, falling.

    ``edges``: (src, dst), symmetric, each direction once; null ends and loops
    take no part. A round multiplies by the graph, shifted so that no eigenvalue
    is below zero, and makes the columns orthonormal by a tree of small triangles;
    what is sent along an edge is one array. Columns are as exact as the gap to
    the next eigenvalue allows in ``rounds``; of equal eigenvalues any basis is
    found. Each column's entry farthest from zero is positive. More dimensions
    than vertices are cut to these; an empty graph has no rows. The result reads
    a table in the shared folder.
    """
    if not 1 <= dimensions <= MOST_DIMENSIONS:
        raise ValueError(f"1 to {MOST_DIMENSIONS} dimensions")
    one = materialize(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst"))
    d = degree(one)
    n = d.count()
    k = min(dimensions, n)
    uniform = lambda i: F.xxhash64("v", F.lit(seed), F.lit(i)).cast("double") / F.lit(float(1 << 63))
    now = materialize(d.select("v", F.col("degree").alias("d"), F.array(*[uniform(i) for i in range(k)]).cast("array<double>").alias("x")))
    if not n:
        return now.select("v", "x"), []

    def multiplied(table: DataFrame) -> DataFrame:
        """Half the sum of every row and of its neighbours', these divided by the roots of both degrees."""
        sent = one.join(table.select(F.col("v").alias("dst"), F.transform("x", lambda y: y / F.sqrt("d")).alias("y")), "dst")
        met = sent.groupBy(F.col("src").alias("v")).agg(*[F.sum(F.get("y", i)).alias(f"y{i}") for i in range(k)])
        both = table.join(met, "v")
        return both.select("v", "d", "x", F.array(*[(F.get("x", i) + F.col(f"y{i}") / F.sqrt("d")) / 2 for i in range(k)]).alias("z"))

    for _ in range(rounds):
        r = tall_triangle(now, k)
        wider = materialize(multiplied(_turned(now, np.linalg.pinv(r))).select("v", "d", F.col("z").alias("x")))
        discard(now)
        now = wider
    base = materialize(_turned(now, np.linalg.pinv(tall_triangle(now, k))))
    both = materialize(multiplied(base))
    values, turn = np.linalg.eigh((h := _products(both, "x", "z", k)) + h.T)  # twice the half: the shifted eigenvalue
    order = np.argsort(-values)
    far = _turned(base, turn[:, order]).agg(*[F.max_by(F.get("x", i), F.abs(F.get("x", i))).alias(f"c{i}") for i in range(k)]).first()
    out = materialize(_turned(base, turn[:, order] * np.sign(np.array(far, float))).select("v", "x"))
    for old in (one, now, base, both):
        discard(old)
    return out, [float(x) - 1 for x in values[order]]
