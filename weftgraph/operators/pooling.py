"""Soft pooling: a trained assignment of vertices to clusters by the modularity objective, and the pooled graph.

A vertex's features give its shares of k clusters through one linear layer and a
softmax; the layer is trained so that edges stay within clusters more than
degrees alone would have it, with a term against the collapse of all vertices
into one cluster (Tsitsulin et al., 2020). The layer is small and is sent with
every step; what comes back are sums: each task reads its own edges, with the
features of both ends beside them, and adds up its part of the objective's slope.
No step shuffles edges or vertices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.lineage import discard, materialize
from weftgraph.plans.workers import map_in_arrow

#: Features and clusters at most: the layer and its slope are sent with each step.
MOST_FEATURES, MOST_CLUSTERS = 1024, 256


@dataclass
class Layer:
    """Weights (features x clusters) and biases of an assignment, and the objective at each step of its training."""

    weight: np.ndarray
    bias: np.ndarray
    losses: list[float] = field(default_factory=list)

    def shares(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weight + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def through_softmax(s: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Slopes by what enters a softmax, from those by the shares ``s`` that leave it."""
    return s * (slope - (s * slope).sum(axis=1, keepdims=True))


def sums(layer: Layer, x: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """What the objective needs of all vertices: degrees times shares, and shares, added up."""
    s = layer.shares(x)
    return np.concatenate([degree @ s, s.sum(axis=0)])


def vertex_slope(layer: Layer, x: np.ndarray, degree: np.ndarray, total: np.ndarray, volume: float, n: int) -> np.ndarray:
    """The vertices' part of the slope: expected edges, and the term against collapse. ``total``: ``sums`` over all vertices; ``volume``: their degrees, added up."""
    k = len(layer.bias)
    s, of_degrees, of_shares = layer.shares(x), total[:k], total[k:]
    by_share = 2 * degree[:, None] * of_degrees / volume**2 + np.sqrt(k) / n * of_shares / np.linalg.norm(of_shares)
    z = through_softmax(s, by_share)
    return np.concatenate([(x.T @ z).ravel(), z.sum(axis=0), [0.0]])


def edge_slope(layer: Layer, a: np.ndarray, b: np.ndarray, weight: np.ndarray, volume: float) -> np.ndarray:
    """The edges' part of the slope, and at its end of the objective. Edges are directed, both directions are there."""
    s, t = layer.shares(a), layer.shares(b)
    z = through_softmax(s, -2 * weight[:, None] * t / volume)  # the other end's part is that of the edge back
    return np.concatenate([(a.T @ z).ravel(), z.sum(axis=0), [-(weight * (s * t).sum(axis=1)).sum() / volume]])


def objective(edge_part: float, total: np.ndarray, volume: float, n: int) -> float:
    k = len(total) // 2
    return float(edge_part + total[:k] @ total[:k] / volume**2 + np.sqrt(k) / n * np.linalg.norm(total[k:]) - 1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _added(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """``part`` of all batches, added up: per task in numpy, over tasks by position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = None
        for batch in batches:
            if batch.num_rows:
                one = part(batch)
                all_ = one if all_ is None else all_ + one
        if all_ is not None:
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(all_), dtype=np.int32), "x": all_})

    added = map_in_arrow(rows, run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(added))
    for r in added:
        out[r["at"]] = r["x"]
    return out


def training_tables(edges: DataFrame, feats: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(edges with the features of both ends: a, b, weight), (vertices with edges: v, x, degree), and how many features there are."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    known = feats.select("v", F.col("x").cast("array<double>").alias("x")).where("v is not null and x is not null").where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    most = known.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), "d").first()
    d = most["d"] if most else 0
    known = known.where(F.size("x") == d)
    usable = edges.where("src <> dst").select("src", "dst", w.alias("weight")).where("weight > 0")
    ends = usable.join(known.toDF("src", "a"), "src").join(known.toDF("dst", "b"), "dst")
    pairs = materialize(ends.select("src", "a", "b", "weight"))
    degrees = pairs.groupBy(F.col("src").alias("v")).agg(F.sum("weight").alias("degree"))
    return pairs, materialize(known.join(degrees, "v").select("v", "x", "degree")), d


def fit_pooling(edges: DataFrame, feats: DataFrame, clusters: int, steps: int = 60, rate: float = 0.1, seed: int = 0) -> Layer:
    """Train an assignment of the vertices of ``edges`` to ``clusters`` by their features.

    ``edges``: (src, dst) and optionally a weight, both directions of each.
    ``feats``: (v, x), an array of numbers; those that are null, hold null or
    non-finite numbers, or have another length than most take no part, nor do
    their edges, loops, null ends or weights not above zero. Each step reads all
    edges and vertices and moves the layer along the slope (Adam). Without an
    edge that takes part the layer stays as it was drawn. A vertex's edges count
    as often as they are given.
    """
    if not 1 <= clusters <= MOST_CLUSTERS:
        raise ValueError(f"1 to {MOST_CLUSTERS} clusters")
    pairs, vertices, d = training_tables(edges, feats)
    if d > MOST_FEATURES:
        raise ValueError(f"at most {MOST_FEATURES} features")
    r = np.random.default_rng(seed)
    layer = Layer(r.standard_normal((d, clusters)) / np.sqrt(max(d, 1)), np.zeros(clusters))
    row = vertices.agg(F.count("*").alias("n"), F.sum("degree").alias("volume")).first()
    n, volume = row["n"], row["volume"]
    m = v = np.zeros(d * clusters + clusters)
    for step in range(1, steps + 1 if n else 1):
        now = Layer(layer.weight, layer.bias)
        total = _added(vertices.select("x", "degree"), lambda b: sums(now, _matrix(b.column("x"), d), b.column("degree").to_numpy()))
        by_vertex = _added(vertices.select("x", "degree"), lambda b: vertex_slope(now, _matrix(b.column("x"), d), b.column("degree").to_numpy(), total, volume, n))
        by_edge = _added(pairs.select("a", "b", "weight"), lambda b: edge_slope(now, _matrix(b.column("a"), d), _matrix(b.column("b"), d), b.column("weight").to_numpy(), volume))
        layer.losses.append(objective(by_edge[-1], total, volume, n))
        slope = (by_vertex + by_edge)[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        moved = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        layer.weight = layer.weight - moved[: d * clusters].reshape(d, clusters)
        layer.bias = layer.bias - moved[d * clusters :]
    discard(pairs)
    discard(vertices)
    return layer


def assign(feats: DataFrame, layer: Layer) -> DataFrame:
    """(v, shares, cluster): every vertex's shares of the clusters and the largest, ties to the smaller. Features that the layer can't take give null shares and no cluster."""
    d, k = layer.weight.shape
    x = F.col("x").cast("array<double>")
    fine = (F.size(x) == d) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    rows = feats.select("v", F.when(fine, x).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.array(batch.column("x").is_valid())
            s = layer.shares(_matrix(batch.column("x"), d)) if ok.any() else np.zeros((0, k))
            at = np.zeros(len(ok), np.int64)
            at[ok] = s.argmax(axis=1)
            offsets = np.r_[0, np.cumsum(ok * k)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.ravel()), mask=pa.array(~ok))
            yield pa.RecordBatch.from_arrays([batch.column("v"), lists, pa.array(at, mask=~ok)], names=["v", "shares", "cluster"])

    return map_in_arrow(rows, run, f"v {feats.schema['v'].dataType.simpleString()}, shares array<double>, cluster bigint")


def pooled_edges(edges: DataFrame, feats: DataFrame, layer: Layer) -> DataFrame:
    """(src, dst, weight): the graph of the clusters, all pairs of them; an edge counts in each pair by the product of its ends' shares. The weights add up to those of the edges that take part; without any, there are no rows."""
    pairs, vertices, d = training_tables(edges, feats)
    k = len(layer.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                all_ += (layer.shares(_matrix(b.column("a"), d)) * b.column("weight").to_numpy()[:, None]).T @ layer.shares(_matrix(b.column("b"), d))
        if all_.any():
            src, dst = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_pydict({"src": src, "dst": dst, "weight": all_.ravel()})

    out = materialize(map_in_arrow(pairs.select("a", "b", "weight"), run, "src bigint, dst bigint, weight double").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    discard(pairs)
    discard(vertices)
    return out
