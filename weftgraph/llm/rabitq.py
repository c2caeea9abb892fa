"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to unit length and turned by one random rotation; the signs
are the code, and one scalar, the inner product of the turned vector with its
own code, corrects what rounding to signs has lost. Sign products with a query
divided by that scalar estimate the cosine without bias, within an error bound
that the same scalar gives (Gao and Long, 2024). Candidates whose upper bound
does not reach the k-th best score known so far are skipped; the others are
compared with the original vectors in double precision.

All vectors are indexed, each distinct one once. Queries are taken in blocks of
bounded size; each block is sent to all tasks and scans the index, so no pair of
rows is ever shuffled: what leaves a task are its few best for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import in_arrow, per_batch
from weftgraph.plans.lineage import discard, materialize, materialize_all

#: Error bound in standard deviations (the paper's value).
EPSILON = 1.9
#: Distinct query vectors sent to the tasks at once, and vectors of the sample from which first thresholds are taken.
QUERY_BLOCK, SEED_ROWS = 8192, 2048
#: Rows and queries estimated at once, and pairs compared exactly at once.
ROWS, QUERIES, PAIRS = 4096, 1024, 1 << 14


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random rotation of the dimension rounded up to a multiple of 64."""
    width = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return (q * np.sign(np.diag(r)))[:dim]


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, correction scalars) of unit vectors."""
    turned = unit @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(turn.shape[1])


def estimates(packed: np.ndarray, scalar: np.ndarray, turned_queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosines rows x queries, error bound of each row) from the packed bits."""
    width = turned_queries.shape[1]
    signs = np.unpackbits(packed, axis=1, count=width).astype(np.float32) * 2 - 1
    est = (signs @ turned_queries.T.astype(np.float32)) / (np.sqrt(width) * scalar[:, None]).astype(np.float32)
    bound = EPSILON * np.sqrt(np.maximum(1 - scalar**2, 0) / scalar**2 / max(width - 1, 1))
    return est, bound.astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; equal rows give equal results wherever they are."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Nearest:
    """The k best found so far for each query of a block: larger score first, then the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.q, self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, row: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        q, row, score, ident = (np.concatenate(x) for x in ((self.q, q), (self.row, row), (self.score, score), (self.id, ident)))
        order = np.lexsort((ident, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[place < self.k]
        full = place == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], score[order[full]])
        self.q, self.row, self.score, self.id = q[place < self.k], row[keep], score[keep], ident[keep]


def usable(df: DataFrame, dim: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, v array<double>): rows that take part. Left out: null ids, null vectors, other lengths, null or non-finite components, zero vectors."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) == dim)).where(fine).select(F.col(key).cast("bigint").alias("id"), v.cast("array<double>").alias("v"))


def dimension(df: DataFrame, vector: str = "embedding") -> int:
    """The most frequent length, the smaller on a tie; 0 if there is none. Vectors of other lengths are not compared."""
    row = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def build_index(rows: DataFrame, dim: int, k: int, seed: int = 5) -> DataFrame:
    """(rep, ids, v, code, scalar): one row for each distinct vector of ``rows`` (id, v).

    ``ids``: its k + 1 smallest ids, more can't be in any answer; ``rep``: the
    smallest. Copies are cut to those before the shuffle, so a vector that a
    third of all rows share costs a task no more than another.
    """
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    one = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    turn = rotation(dim, seed)

    def run(batch: pa.RecordBatch) -> dict:
        v = batch.column("v").flatten().to_numpy().reshape(-1, dim)
        packed, scalar = codes(v / np.sqrt((v * v).sum(1))[:, None], turn)
        return {"rep": batch.column("rep"), "ids": batch.column("ids"), "v": batch.column("v"), "code": [p.tobytes() for p in packed], "scalar": scalar}

    return per_batch(one.select(F.col("ids")[0].alias("rep"), "ids", "v"), run, "rep bigint, ids array<bigint>, v array<double>, code binary, scalar double")


def _search(index: DataFrame, queries: np.ndarray, reps: np.ndarray, floor: np.ndarray, dim: int, k: int, seed: int) -> tuple[DataFrame, Broadcast]:
    """The k best distinct vectors in each task for each query of one block: (query_rep, score, rep, ids); and what was sent to the tasks."""
    turn = rotation(dim, seed)
    sent = index.sparkSession.sparkContext.broadcast((queries, reps, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_all, q_reps, floor = sent.value
        turned = (q_all / np.sqrt((q_all * q_all).sum(1))[:, None]) @ turn
        best, kept, base = Nearest(len(q_all), k, floor), {}, 0
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                v = part.column("v").flatten().to_numpy().reshape(-1, dim)
                packed = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(v), -1)
                scalar, rep = part.column("scalar").to_numpy(), part.column("rep").to_numpy()
                for b in range(0, len(q_all), QUERIES):
                    est, bound = estimates(packed, scalar, turned[b : b + QUERIES])
                    r, q = np.nonzero(est + bound[:, None] >= best.floor[b : b + QUERIES][None, :].astype(np.float32) - 1e-6)
                    for c in range(0, len(r), PAIRS):
                        rows, qs = r[c : c + PAIRS], q[c : c + PAIRS] + b
                        score = cosines(q_all[qs], v[rows])
                        good = score >= best.floor[qs]
                        if good.any():
                            best.add(qs[good], base + rows[good], score[good], rep[rows[good]])
                alive = set(best.row.tolist())
                ids = part.column("ids")
                kept = {i: x for i, x in kept.items() if i in alive} | {i: ids[i - base].as_py() for i in alive if i >= base}
                base += len(v)
        if len(best.q):
            yield pa.RecordBatch.from_arrays([pa.array(q_reps[best.q]), pa.array(best.score), pa.array(best.id), pa.array([kept[i] for i in best.row.tolist()], pa.list_(pa.int64()))], names=["query_rep", "score", "rep", "ids"])

    return in_arrow(index, run, "query_rep bigint, score double, rep bigint, ids array<bigint>"), sent


def _matrix(rows: list, dim: int) -> np.ndarray:
    return np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dim)


def nearest(df: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding", key: str = "vec_id", seed: int = 5, query_block: int = QUERY_BLOCK, seed_rows: int = SEED_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row whose key is divisible by ``every``, among all other rows.

    Nearness is the cosine of the original vectors in double precision, ties to
    the smaller id. Rows that ``usable`` leaves out take no part; rows of the same
    key are one row if equal, and never each other's neighbours. Fewer than ``k``
    candidates give fewer rows, an empty table none.

    A fixed sample of at most ``seed_rows`` vectors gives each query a first
    threshold and its first answers, so that no query has fewer than it should;
    it only saves work, no vector is left out by it.
    """
    spark = df.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    dim = dimension(df, vector)
    rows = usable(df, max(dim, 1), vector, key)
    index = materialize(build_index(rows, max(dim, 1), k, seed))
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).distinct()
    by_vector = index.select("rep", "v").join(asked, "v").select(F.col("id").alias("query_id"), F.col("rep").alias("query_rep"), "v")
    by_vector = materialize(by_vector)
    distinct = by_vector.select("query_rep", "v").distinct()
    n = distinct.count()
    if not n:
        discard(index)
        discard(by_vector)
        return spark.createDataFrame([], schema)
    seeds = index.orderBy(F.xxhash64("rep"), "rep").limit(seed_rows).select("rep", "ids", "v").collect()
    sample = _matrix(seeds, dim)
    unit = sample / np.sqrt((sample * sample).sum(1))[:, None]
    blocks = -(-n // query_block)

    def answered() -> Iterator[DataFrame]:
        # blocks are dealt by hash: a third more room keeps each below twice the limit
        for i in range(blocks):
            some = distinct.where(F.pmod(F.xxhash64("query_rep", F.lit(1)), F.lit(blocks)) == i).collect()
            if not some:
                continue
            q = _matrix(some, dim)
            close = (q / np.sqrt((q * q).sum(1))[:, None]) @ unit.T
            near = np.argsort(-close, axis=1, kind="stable")[:, : k + 1]
            floor = close[np.arange(len(q)), near[:, -1]] - 1e-9 if near.shape[1] > k else np.full(len(q), -2.0)
            first = [(r["query_rep"], float(s), seeds[j]["rep"], seeds[j]["ids"]) for r, v, js in zip(some, q, near) for j, s in zip(js, cosines(np.broadcast_to(v, (len(js), dim)), sample[js]))]
            out, sent = _search(index, q, np.array([r["query_rep"] for r in some], np.int64), floor, dim, k + 1, seed)
            yield out.unionByName(spark.createDataFrame(first, out.schema)).dropDuplicates(["query_rep", "rep"])
            sent.destroy()

    found = materialize_all(answered())
    place = F.row_number().over(Window.partitionBy("query_rep").orderBy(F.desc("score"), "rep"))
    top = found.withColumn("place", place).where(F.col("place") <= k + 1)
    each = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id")))))
    answers = top.groupBy("query_rep").agg(F.array_sort(each).alias("near"))
    mine = by_vector.select("query_id", "query_rep").join(answers, "query_rep")
    mine = mine.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "x"))
    result = materialize(mine.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score")))
    for done in (index, by_vector, found):
        discard(done)
    return result


def op2_rabitq_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth embedding among all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
