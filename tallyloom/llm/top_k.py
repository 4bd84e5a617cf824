"""Exact top-k inner products through a pivot-distance index.

Vectors of integers are lifted to one length: x becomes (x, sqrt(R^2 - |x|^2))
with R the largest norm, a query (q, 0).  Then |q' - x'|^2 = |q|^2 + R^2 - 2 q.x, so
the largest inner products are the nearest neighbours and distances obey the
triangle inequality.  The key of a vector is its nearest pivot and its
distance from it; vectors of one pivot are cut into annuli by distance.  A query
first visits its nearest annuli, which gives it a k-th score to beat, and then
expands to every annulus whose bound |d(q, pivot) - d(x, pivot)| lets in a
higher or equal score.  All other annuli are passed over for good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch


@dataclass(frozen=True)
class TopK:
    """pivots: at least so many, more by the square root of the number of vectors, at most most_pivots; taken from at most sample vectors, chosen by hash.

    annuli: for each pivot.  rows: vectors in a block of an annulus.  With most_pivots * annuli cells the table of cells is small
    whatever the input.
    """

    k: int = 10
    scale: int = 1024
    pivots: int = 32
    most_pivots: int = 512
    annuli: int = 8
    rows: int = 2048
    queries: int = 512
    sample: int = 2000


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: by doubles where every partial sum is below 2^53, by unbounded integers where one may need over 63 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    limit = np.iinfo(np.int64).max
    return np.clip(a.astype(object) @ b.astype(object).T, -limit, limit).astype(np.int64)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector that is farthest from those before."""
    x = sample.astype(float)
    chosen = [int(np.argmax((x * x).sum(axis=1)))] if len(x) else []
    far = np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(np.argmax(far)))
    return sample[chosen]


def _lifted(x: np.ndarray, squared: float) -> np.ndarray:
    x = x.astype(float)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, squared - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(0.0, d))


def _keyed(pivots: np.ndarray, squared: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_lifted(_matrix(batch.column("v")), squared), pivots)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["vec_id", "v", "pivot", "distance"])

    return run


def _blocks(table: pa.Table) -> pa.Table:
    """One block of an annulus: its vectors as one row."""
    table = table.combine_chunks()
    v = _matrix(table.column("v").combine_chunks())
    ids = table.column("vec_id").to_numpy()
    return pa.table({"cell": table.column("cell").slice(0, 1), "block": table.column("block").slice(0, 1), "n": pa.array([len(ids)], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([v.tobytes()], pa.binary())})


def _visits(p: TopK, pivots: np.ndarray, squared: float, cells: dict[str, np.ndarray], again: bool):
    """(cell, query_id, v) of the cells that a query has to visit now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"))
            if not len(v):
                continue
            q = np.concatenate([v.astype(float), np.zeros((len(v), 1))], axis=1)
            d = _distances(q, pivots)[:, cells["pivot"]]
            bound = np.maximum(0.0, np.maximum(d - cells["high"], cells["low"] - d))  # no vector of the cell is nearer
            order = np.argsort(bound, axis=1, kind="stable")
            seen = np.cumsum(cells["n"][order], axis=1)
            first = np.zeros(bound.shape, dtype=bool)
            np.put_along_axis(first, order, seen - cells["n"][order] < p.k + 1, axis=1)  # the nearest that hold k others
            if again:
                kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(float)  # null: fewer than k so far
                most = ((q * q).sum(axis=1) + squared)[:, None] / 2 - bound**2 / 2  # no inner product is larger
                slack = 1e-9 * ((q * q).sum(axis=1) + squared)[:, None] + 1
                wanted = ~first & (np.isnan(kth)[:, None] | (most + slack >= kth[:, None]))
            else:
                wanted = first
            row, cell = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([pa.array(cells["cell"][cell]), batch.column("query_id").take(pa.array(row)), batch.column("v").take(pa.array(row))], names=["cell", "query_id", "v"])

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """Queries that visit one cell, as one row."""
    table = table.combine_chunks()
    v = _matrix(table.column("v").combine_chunks())
    return pa.table({"cell": table.column("cell").slice(0, 1), "query_ids": pa.array([table.column("query_id").to_numpy().tobytes()], pa.binary()), "queries": pa.array([v.tobytes()], pa.binary())})


def _scored(p: TopK, width: int):
    """The k best of each block for each of its visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x, query_ids, q = (np.frombuffer(batch.column(c)[row].as_py(), dtype=np.int64) for c in ("ids", "data", "query_ids", "queries"))
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x.reshape(-1, width)[order]
                score = _products(q.reshape(-1, width), x)
                own = query_ids[:, None] == ids[None, :]
                score = np.where(own, -np.iinfo(np.int64).max, score)
                best = np.argsort(-score, axis=1, kind="stable")[:, : p.k] if score.shape[1] <= 4 * p.k else _largest(score, p.k)
                at = np.repeat(np.arange(len(query_ids)), best.shape[1])
                best = best.ravel()
                keep = ~own[at, best]
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[at[keep]]), pa.array(ids[best[keep]]), pa.array(score[at, best][keep])], names=["query_id", "vec_id", "score"])

    return run


def _largest(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row; of equal ones, the first columns."""
    kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    above, equal = score > kth, score == kth
    equal &= np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | equal)[1].reshape(len(score), k)


def integer_vectors(table: DataFrame, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component; vectors that are null or have a null or non-finite component are left out, an empty one stays."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c * float(scale)).cast("long"))
    whole = table.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return whole.select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(table: DataFrame, params: TopK = TopK(), is_query: str = "vec_id % 100 = 0") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query with all other vectors.

    table(vec_id, embedding, ...): of rows that repeat a vec_id the one with the
    least vector counts, rows with a null vec_id none.  Shorter vectors, empty ones too, are filled
    up with zeros; a score beyond 64 bits is the nearest one that fits.  Ties go to the smaller vec_id.  Fewer than k others are all
    returned.  Further columns are ignored.
    """
    spark, p = table.sparkSession, params
    scratch = Scratch(spark, "topk")
    vectors = scratch.write(integer_vectors(table, p.scale), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    n, width, squared = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    width = max(1, width)
    vectors = vectors.select("vec_id", F.when(F.size("v") == width, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0).cast("long"), width - F.size("v")))).alias("v"))
    share = min(1.0, p.sample / n)
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(2 * p.sample).toPandas()["v"]
    sample = np.array([list(x) for x in sample], dtype=np.int64).reshape(-1, width) if len(sample) else np.zeros((1, width), dtype=np.int64)
    pivots = _lifted(choose_pivots(sample, min(max(p.pivots, round(n**0.5 / 32)), p.most_pivots)), squared)

    keyed = scratch.write(vectors.mapInArrow(_keyed(pivots, squared), "vec_id long, v array<long>, pivot int, distance double"), "keyed")
    fractions = [i / p.annuli for i in range(1, p.annuli)]
    edges = keyed.groupBy("pivot").agg(F.percentile_approx("distance", fractions, 1000).alias("edges"))  # one row a pivot
    annulus = F.size(F.filter("edges", lambda e: e < F.col("distance")))
    rings = keyed.join(F.broadcast(edges), "pivot").select("vec_id", "v", "pivot", "distance", (F.col("pivot") * p.annuli + annulus).cast("int").alias("cell"))
    cells = rings.groupBy("cell", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("cell").toPandas()  # pivots * annuli rows
    table_of_cells = {c: cells[c].to_numpy() for c in cells.columns}
    blocks_of = F.broadcast(spark.createDataFrame(cells[["cell", "n"]]).select(F.col("cell").cast("int"), F.ceil(F.col("n") / p.rows).alias("blocks")))
    index = rings.join(blocks_of, "cell").select("cell", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"))
    index = scratch.write(index.groupBy("cell", "block").applyInArrow(_blocks, "cell int, block long, n long, ids binary, data binary"), "index")

    def search(queries: DataFrame, again: bool) -> DataFrame:
        visits = queries.mapInArrow(_visits(p, pivots, squared, table_of_cells, again), "cell int, query_id long, v array<long>")
        salt = F.pmod(F.xxhash64("query_id"), F.lit(salts))
        visitors = visits.groupBy("cell", salt.alias("salt")).applyInArrow(_gathered, "cell int, query_ids binary, queries binary")
        # Each block of a cell is a key of its own, so that a large cell isn't one task's work.
        visitors = visitors.join(blocks_of, "cell").select("cell", "query_ids", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        found = visitors.join(index, ["cell", "block"]).mapInArrow(_scored(p, width), "query_id long, vec_id long, score long")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= p.k)

    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    salts = max(1, queries.count() // p.queries)
    near = scratch.write(search(queries, False).select("query_id", "vec_id", "score", "rank"), "near")
    kth = near.where(F.col("rank") == p.k).select("query_id", F.col("score").alias("kth"))
    far = search(queries.join(kth, "query_id", "left"), True).select("query_id", "vec_id", "score")
    both = near.select("query_id", "vec_id", "score").unionByName(far)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
