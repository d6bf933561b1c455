"""Vectors by cells: centroids are learned on a bounded sample, every vector goes to its nearest cell, and a search
re-scores the vectors of the cells probed exactly."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import top_k
from .vectors import dot

MAX_CELLS, MAX_SAMPLE = 2048, 200_000


@dataclass
class CellIndex:
    rows: DataFrame  # vec_id, v, cell
    centroids: DataFrame  # cell, c: MAX_CELLS rows at most


def built(vectors: DataFrame, n_cells: int = MAX_CELLS, seed: int = 42, max_sample: int = MAX_SAMPLE) -> CellIndex:
    """vectors: vec_id, v. Null vectors and those with null or non-finite components are left out. Every other one is indexed; only the fit
    sees a sample of at most about max_sample, by a hash of the id."""
    fine = vectors.where(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    dense = fine.withColumn("features", array_to_vector(F.col("v").cast("array<double>")))
    n = dense.count()
    if not n:
        return CellIndex(fine.withColumn("cell", F.lit(0)), fine.sparkSession.createDataFrame([], "cell int, c array<double>"))
    parts = max(1, math.ceil(n / max_sample))
    sample = dense.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == 0) if parts > 1 else dense
    model = KMeans(k=max(1, min(n_cells, MAX_CELLS, n)), seed=seed, maxIter=10, featuresCol="features", predictionCol="cell").fit(sample)
    centroids = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return CellIndex(model.transform(dense).drop("features"), fine.sparkSession.createDataFrame(centroids, "cell int, c array<double>"))


def searched(index: CellIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """queries: query_id, q. The k largest inner products among the vectors of the probes cells whose centroids have the largest; not the query itself."""
    near = queries.crossJoin(F.broadcast(index.centroids)).withColumn("near", dot(F.col("q"), F.col("c")))
    probed = top_k(near, "query_id", [F.desc("near"), F.col("cell")], probes, "_r").select("query_id", "q", "cell")
    scored = probed.join(index.rows, "cell").where("query_id <> vec_id").select("query_id", "vec_id", dot(F.col("q"), F.col("v")).alias("score"))
    return top_k(scored, "query_id", [F.desc(F.round("score", 9)), F.col("vec_id")], k)
