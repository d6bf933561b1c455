"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, normed and turned by one random rotation; a code keeps the signs, one bit for each
dimension, and two scalars: the length of the centred vector, and the inner product of the turned unit
vector with its code. Bits and scalars estimate the inner product with a query without bias, with an error
that exceeds EPSILON standard errors rarely; vectors whose upper bound reaches the k-th lower bound
are reranked by the original vectors in double precision.

Queries and vectors are dealt to blocks of bounded size by their hashes, and each pair of blocks is one
group of a cogroup: no cross join, no broadcast, nothing collected, and memory bounded by two blocks. Each
pair of blocks gives k rows for each query, which a window per query merges.

Defined cases: vectors that are null, zero or of another dimension than most, or that hold null or
non-finite components, take no part, neither do rows without an id; rows that share an id count once (the
smallest vector); with fewer than k candidates all are returned; equal scores go to the smaller id;
without queries or candidates there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

K = 20
QUERIES_EVERY = 20
EPSILON = 2.5
VECTOR_BLOCK, QUERY_BLOCK = 8192, 2048
SEED = 11
CODED = "vec_id long, vector binary, code binary, length double, fit double, on_centre double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & e.isNotNull())
        .where(F.coalesce(fine, F.lit(False)))
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
    )


def encode(vectors: DataFrame, dim: int, centre: list[float], seed: int = SEED) -> DataFrame:
    """One-bit codes and correction scalars of usable vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, c = rotation(dim, seed), np.array(centre)
        for batch in batches:
            if not len(batch):
                continue
            v = np.stack(batch["embedding"].to_numpy())
            moved = v - c
            length = np.sqrt((moved**2).sum(axis=1))
            turned = (moved / np.where(length > 0, length, 1)[:, None]) @ turn
            bits = turned >= 0
            fit = np.abs(turned).sum(axis=1) / np.sqrt(dim)
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"],
                    "vector": [x.tobytes() for x in v],
                    "code": [x.tobytes() for x in np.packbits(bits, axis=1)],
                    "length": length,
                    "fit": np.where(fit > 0, fit, 1.0),
                    "on_centre": v @ c,
                }
            )

    return vectors.mapInPandas(run, CODED)


def estimate(codes: np.ndarray, rows: pd.DataFrame, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by vectors) and their error bounds."""
    dim = queries.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    moved = queries - centre
    length, fit = rows["length"].to_numpy(), rows["fit"].to_numpy()
    on_code = ((moved @ turn).astype(np.float32) @ signs.T).astype(np.float64)
    # <o, q> = <o - c, q - c> + <o, c> + <q - c, c>
    estimated = on_code / fit * length + rows["on_centre"].to_numpy() + (moved @ centre)[:, None]
    spread = np.sqrt(np.maximum(0, 1 - fit**2)) / fit * length / np.sqrt(max(1, dim - 1))
    return estimated, epsilon * np.sqrt((moved**2).sum(axis=1))[:, None] * spread + 1e-9


def _copies(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def nearest(vectors: DataFrame, every: int = QUERIES_EVERY, k: int = K, epsilon: float = EPSILON, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose id is divisible by every."""
    fine = written(usable(vectors), "vectors")
    sizes = fine.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes
    fine = fine.where(F.size("embedding") == dim)
    centre = [round(x, 6) for x in fine.agg(*(F.avg(F.col("embedding")[i]) for i in range(dim))).first()]
    asking = F.col("vec_id") % every == 0
    n_queries = fine.where(asking).count()
    across, down = max(1, -(-n // vector_block)), max(1, -(-n_queries // query_block))
    coded = written(encode(fine, dim, centre, seed), "codes")
    left = coded.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(across)).alias("v")).withColumn("q", _copies(down))
    right = (
        coded.where(asking).select(F.col("vec_id").alias("query_id"), "vector", F.pmod(F.xxhash64("vec_id"), F.lit(down)).alias("q"))
        .withColumn("v", _copies(across))
    )

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(rows) or not len(asked):
            return empty
        unpack = lambda c, kind: np.frombuffer(b"".join(c), kind).reshape(len(c), -1)
        v, q, ids = unpack(rows["vector"], "<f8"), unpack(asked["vector"], "<f8"), rows["vec_id"].to_numpy()
        codes, turn, c = unpack(rows["code"], "u1"), rotation(dim, seed), np.array(centre)
        longest, out = np.sqrt((v**2).sum(axis=1).max()), []
        for at in range(0, len(q), 256):
            estimated, error = estimate(codes, rows, q[at : at + 256], c, turn, epsilon)
            products = q[at : at + 256] @ v.T
            slack = 1e-10 * np.sqrt((q[at : at + 256] ** 2).sum(axis=1)) * longest
            for i, own in enumerate(asked["query_id"].to_numpy()[at : at + 256]):
                low = np.where(ids == own, -np.inf, estimated[i] - error[i])
                level = -np.inf if len(low) <= k else np.partition(low, -k)[-k]
                chosen = np.where((estimated[i] + error[i] >= level) & (ids != own), products[i], -np.inf)
                # of the chosen, those near the k-th product or above it, whose products are then added in order, as any plain loop does
                last = np.partition(chosen, -k)[-k] - slack[i] if len(chosen) > k else -np.inf
                near = np.flatnonzero((chosen >= last) & (chosen > -np.inf))
                score = np.cumsum(v[near] * q[at + i], axis=1)[:, -1]
                best = np.lexsort((ids[near], -score))[:k]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(out, ignore_index=True) if out else empty

    found = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


#: The exact search for DuckDB.
NEAREST_SQL = """
with v as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.v, v.v) as score from v q join v on v.vec_id <> q.vec_id where q.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""
