"""Exact vector operators over arrays, by SQL functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .relational import top_k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths <= 1e-12, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def blocked_top_k(queries: DataFrame, vectors: DataFrame, k: int, vector_block: int = 8192, query_block: int = 2048) -> DataFrame:
    """queries: query_id, q. vectors: vec_id, v. The k largest inner products of each query with other vectors of its dimension.

    Both are dealt to blocks by their ids' hashes, and each pair of blocks is one group: neither may be broadcast, however
    many there are. Null vectors and those with null components take no part.
    """
    fine = lambda df, v: df.where(F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull())).withColumn(v, F.col(v).cast("array<double>")).withColumn("dim", F.size(v))
    queries, vectors = fine(queries.select("query_id", "q"), "q"), fine(vectors.select("vec_id", "v"), "v")
    across, down = max(1, -(-vectors.count() // vector_block)), max(1, -(-queries.count() // query_block))
    share = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("a", share("vec_id", across)).withColumn("b", every(down))
    right = queries.withColumn("b", share("query_id", down)).withColumn("a", every(across))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})]
        if len(rows) and len(asked):
            v, ids = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy()
            for own, q in zip(asked["query_id"], asked["q"], strict=True):
                score, other = v @ q, ids != own
                best = np.lexsort((ids[other], -np.round(score[other], 9)))[:k]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[other][best], "score": score[other][best]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    found = left.groupBy("dim", "a", "b").cogroup(right.groupBy("dim", "a", "b")).applyInPandas(search, "query_id long, vec_id long, score double")
    return top_k(found, "query_id", [F.desc(F.round("score", 9)), F.col("vec_id")], k)


def hashed_texts(rows: DataFrame, key: str, column: str, dim: int = 64) -> DataFrame:
    """key, at and value: what is not zero of a vector of each text, made without a model: how many of its character pairs fall into each of dim buckets by their
    md5, at unit length. Texts without characters have no rows."""
    grams = rows.select(key, F.explode(text.bigrams(F.col(column))).alias("_g"))
    at = F.conv(F.substring(F.md5(F.col("_g").cast("binary")), 1, 6), 16, 10).cast("long") % dim
    counts = grams.groupBy(key, at.alias("at")).agg(F.count("*").alias("_n"))
    length = F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(Window.partitionBy(key)).cast("double"))
    return counts.select(key, "at", (F.col("_n") / length).alias("value"))


def mean_vector(rows: DataFrame, group: str, vector: str, weight: Column | None = None) -> DataFrame:
    """Weighted means by position, as long rows: group, at, value. Weights below 0 count 0; where all of a group's are 0, all count alike."""
    if weight is not None:
        w = F.greatest(weight.cast("double"), F.lit(0.0))
        rows = rows.withColumn("_w", F.when(F.sum(w).over(Window.partitionBy(group)) <= 1e-12, F.lit(1.0)).otherwise(w))
    long = rows.select(group, (F.lit(1.0) if weight is None else F.col("_w")).alias("w"), F.posexplode(vector).alias("at", "x"))
    return long.groupBy(group, "at").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("value"))


def fused(text: Column, image: Column, share: float = 0.72) -> Column:
    """share of the text vector and the rest of the image's; the text's alone where there is no image."""
    return F.when(image.isNull(), text).otherwise(F.zip_with(text, image, lambda a, b: share * a + (1 - share) * b))
