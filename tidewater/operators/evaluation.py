"""Truth, evaluation frames and layered metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .relational import pessimistic, top_k
from .serving import relevance_grades
from .training import order_hash


def labels(features: DataFrame, user: str = "user") -> DataFrame:
    """One row of request, item, y and user for each pair, the largest label and the smallest user of repeated ones."""
    return features.groupBy("request", "item").agg(F.max("y").alias("y"), F.min(user).alias("user"))


def truth_frame(truth: DataFrame, labelled: DataFrame, k: int) -> DataFrame:
    """truth: request, items (array, best first). request, item, place (from 1, k at most), y (0 without a label) and user."""
    rows = truth.select("request", F.posexplode(F.slice("items", 1, k)).alias("at", "item")).select("request", "item", (F.col("at") + 1).alias("place"))
    return rows.join(labelled, ["request", "item"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def picked_groups(rows: DataFrame, n: int, user: int | None = None) -> DataFrame:
    """request, positives, best and place of the n requests with most positives, then the largest label, then the smallest id. rows: request, user, y.
    With a user, half of n are that user's requests, as far as there are, and the others come after."""
    stats = rows.groupBy("request").agg(F.count(F.when(F.col("y") > 0, 1)).alias("positives"), F.max("y").alias("best"), F.min("user").alias("user"))
    order = [F.desc("positives"), F.desc("best"), F.col("request")]
    if user is None:
        return _placed(stats.orderBy(*order).limit(n), order).drop("user")
    mine = F.col("user").eqNullSafe(F.lit(user))
    own = stats.where(mine).orderBy(*order).limit(n // 2).withColumn("_part", F.lit(0))
    rest = stats.where(~mine).orderBy(*order).limit(n).withColumn("_part", F.lit(1))
    return _placed(own.unionByName(rest).orderBy("_part", *order).limit(n), [F.col("_part"), *order]).drop("user", "_part")


def _placed(few: DataFrame, order: list[Column]) -> DataFrame:
    """few rows, no more than a report's, with their place."""
    return few.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def sampled_groups(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n requests in a random order that is always the same."""
    return rows.select("request").distinct().orderBy(order_hash(F.col("request"), seed), "request").limit(n)


def recall_frame(recalled: DataFrame, truth: DataFrame, groups: DataFrame) -> DataFrame:
    """recalled: request, item, rank, score. truth: request, item, y. What was recalled for groups with its labels (0 without), and positives that were
    not recalled, with a score below all others; positives: how many the request has."""
    inside = lambda df: df.join(groups.select("request"), "request", "left_semi")
    found, known = inside(top_k(recalled, ["request", "item"], [F.col("rank")], 1, "_r").drop("_r")), inside(truth.select("request", "item", "y"))
    n = known.groupBy("request").agg(F.count(F.when(F.col("y") > 0, 1)).alias("positives"))
    both = found.select("request", "item", "rank", "score").join(known, ["request", "item"], "full").withColumn("y", F.coalesce("y", F.lit(0.0)))
    filled = both.where("score is not null or y > 0").withColumn("score", pessimistic(both, "request", "score", "y"))
    return filled.join(n, "request", "left").withColumn("positives", F.coalesce("positives", F.lit(0)))


def full_recall(recalled: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (100, 300, 500, 1000)) -> DataFrame:
    """recalled: request, item, rank. truth: request, item, y. One row: for each k the mean recall and hit rate over the requests with positives, also those of
    which nothing was recalled, the mean reciprocal rank, and the median first hit (-1 without any)."""
    positives = truth.where("y > 0").select("request", "item").distinct()
    best = recalled.groupBy("request", "item").agg(F.min("rank").alias("rank"))
    hit = positives.join(best, ["request", "item"], "left")
    each = hit.groupBy("request").agg(
        F.min("rank").alias("first"), *(x for k in ks for x in ((F.count(F.when(F.col("rank") <= k, 1)) / F.count("*")).alias(f"r{k}"), F.max(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"h{k}")))
    )
    aggs = [x for k in ks for x in (F.avg(f"r{k}").alias(f"recall_{k}"), F.avg(f"h{k}").alias(f"hit_{k}"), F.avg(F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0)).alias(f"mrr_{k}"))]
    return each.agg(*aggs, F.coalesce(F.percentile("first", F.lit(0.5)), F.lit(-1.0)).alias("first_hit"), F.count("*").alias("n_requests"))


def recall_summary(recalled: DataFrame, labelled: DataFrame, ks: tuple[int, ...] = (10, 100), ndcg_at: tuple[int, ...] = (10, 50)) -> DataFrame:
    """One row of what was recalled and has a label: the share of requests with a positive among the first k, NDCG of graded labels, rows and requests."""
    joined = recalled.join(labelled.select("request", "item", "y"), ["request", "item"])
    placed = top_k(joined, "request", [F.col("rank"), F.col("item")], 1 << 30, "_at")
    hits = placed.groupBy("request").agg(*(F.max(F.when(F.col("_at") <= k, (F.col("y") > 0).cast("int")).otherwise(0)).alias(f"h{k}") for k in ks), F.count("*").alias("n"))
    out = hits.agg(*(F.avg(f"h{k}").alias(f"recall_{k}") for k in ks), F.sum("n").alias("n_rows"), F.count("*").alias("n_requests"))
    graded = relevance_grades(joined, "y")
    parts = [metrics.ndcg(graded, "request", "score", "grade", k).agg(F.avg("ndcg").alias(f"ndcg_{k}")) for k in ndcg_at]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, out)


def prerank_summary(scored: DataFrame, score: str, base: str, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """One row of scored (request, item, y, score, base): NDCG of graded labels, what the score gains over base at the first k, the median number of
    positives of a request, and requests."""
    graded = relevance_grades(scored, "y")
    mean = lambda s, k, name: metrics.ndcg(graded, "request", s, "grade", k).agg(F.avg("ndcg").alias(name))
    n = scored.groupBy("request").agg(F.count(F.when(F.col("y") > 0, 1)).alias("n"))
    out = n.agg(F.percentile("n", F.lit(0.5)).alias("median_positives"), F.count("*").alias("n_requests"))
    for df in [*(mean(score, k, f"ndcg_{k}") for k in ks), mean(base, ks[0], "_base")]:
        out = out.crossJoin(F.broadcast(df))
    return out.withColumn("gain", F.col(f"ndcg_{ks[0]}") - F.col("_base")).drop("_base")


def scored_bundle(scored: DataFrame, candidates: list[str], labelled: DataFrame, groups: DataFrame, k: int = 10) -> DataFrame:
    """One row: NDCG of graded labels, AUC, GAUC by user, rows and requests, by the first of candidates that scored has a column of. Labelled pairs of groups
    that were not scored count too, with scores below all others of their request."""
    score = next(c for c in candidates if c in scored.columns)
    inside = lambda df: df.join(groups.select("request"), "request", "left_semi")
    best = inside(scored).groupBy("request", "item").agg(F.max(score).alias("score"))
    both = best.join(inside(labelled).select("request", "item", "y", "user"), ["request", "item"], "full").withColumn("y", F.coalesce("y", F.lit(0.0)))
    owner = F.coalesce("user", F.max("user").over(Window.partitionBy("request")))
    filled = both.withColumns({"user": owner, "score": pessimistic(both, "request", "score", "y")})
    parts = [
        metrics.ndcg(relevance_grades(filled, "y"), "request", "score", "grade", k).agg(F.avg("ndcg").alias("ndcg")),
        metrics.auc(filled, "score", "y").select("auc"), metrics.gauc(filled, "user", "score", "y").select("gauc"),
    ]
    counts = filled.agg(F.count("*").alias("n_rows"), F.countDistinct("request").alias("n_requests"))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, counts)


def layered(stages: dict[str, tuple[DataFrame, list[str]]], labelled: DataFrame, splits: dict[str, DataFrame]) -> DataFrame:
    """scored_bundle of each stage and split, one row each. stages: name to (scored, candidates); splits: name to groups."""
    rows = [
        scored_bundle(scored, candidates, labelled, groups).select(F.lit(stage).alias("stage"), F.lit(split).alias("split"), "*")
        for stage, (scored, candidates) in stages.items() for split, groups in splits.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def tail_hits(recalled: DataFrame, preranked: DataFrame, groups: DataFrame, low: int = 101, high: int = 500, most: int = 100) -> DataFrame:
    """One row: the share of groups with a positive that was recalled between low and high and preranked up to most. preranked: request, item, preranking_rank, y."""
    met = preranked.join(recalled.select("request", "item", "rank"), ["request", "item"]).where(F.col("rank").between(low, high) & (F.col("preranking_rank") <= most))
    hit = met.groupBy("request").agg(F.max((F.col("y") > 0).cast("int")).alias("hit"))
    return groups.select("request").distinct().join(hit, "request", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("tail_hit"), F.count("*").alias("n_requests"))


def tiers(counts: DataFrame) -> DataFrame:
    """counts: request, user, results, behaviours. Adds both tiers (2 from 20 on, 1 from 10 on, else 0) and place, the order of examples."""
    tier = lambda c: F.when(F.col(c) >= 20, 2).when(F.col(c) >= 10, 1).otherwise(0)
    return counts.withColumns({"result_tier": tier("results"), "behaviour_tier": tier("behaviours")})


def examples(counts: DataFrame, n: int, user: int | None = None) -> DataFrame:
    """The first n requests for a report, of one user each: those with ten results and behaviours first, then the others, each by tiers and counts.
    With a user, one of that user's comes first."""
    order = [F.desc("result_tier"), F.desc("behaviour_tier"), F.desc("results"), F.desc("behaviours"), F.col("request")]
    marked = tiers(counts).withColumn("_full", ((F.col("results") >= 10) & (F.col("behaviours") >= 10)).cast("int"))
    one = top_k(marked, "user", [F.desc("_full"), *order], 1, "_r").drop("_r")
    first = F.when(F.col("user") == F.lit(user), 0).otherwise(1) if user is not None else F.lit(1)
    few = one.withColumn("_first", first).orderBy("_first", F.desc("_full"), *order).limit(n)
    return _placed(few, [F.col("_first"), F.desc("_full"), *order]).drop("_first", "_full")


def query_quality(preranked: DataFrame, k: int = 10) -> DataFrame:
    """preranked: request, item, preranking_score, exact, lexical. Exact hits and the mean lexical score of the first k of each request."""
    first = top_k(preranked, "request", [F.desc("preranking_score"), F.col("item")], k, "_r")
    return first.groupBy("request").agg(F.sum(F.coalesce("exact", F.lit(0))).alias("exact_hits"), F.avg(F.coalesce("lexical", F.lit(0.0))).alias("lexical_mean"))


def overlaps(a: DataFrame, b: DataFrame, k: int = 10, order: str = "rank") -> DataFrame:
    """How many items the first k of two stages share, for each request of a."""
    first = lambda df: top_k(df, "request", [F.col(order), F.col("item")], k, "_r").select("request", "item")
    left = first(a)
    shared = left.join(first(b), ["request", "item"]).groupBy("request").agg(F.count("*").alias("n"))
    return left.select("request").distinct().join(shared, "request", "left").select("request", F.coalesce("n", F.lit(0)).alias("overlap"))
