"""Route weights, final ranking, back-filling and query resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .relational import quantiles, top_k


def weighed(normed: DataFrame, priors: dict[str, float]) -> DataFrame:
    """normed: request, item, route, norm. Adds weight, by the quality of the scores of the row's route; the weights of a request's routes add up to their number. By windows
    alone, so rows dealt by request are neither read nor shuffled again."""
    w, route, c = Window.partitionBy("request"), Window.partitionBy("request", "route"), F.col
    rows = normed.withColumn("_r", F.row_number().over(route.orderBy(F.desc("norm"), "item"))).withColumn("_n", F.count("*").over(route))
    at = F.lit(0.9) * (c("_n") - 1)
    held = lambda x: F.max(F.when(c("_n") - c("_r") == x, c("norm"))).over(route)
    stats = rows.withColumns({
        "_top": F.max("norm").over(route), "_mean": F.avg("norm").over(route), "_mean50": F.avg(F.when(c("_r") <= 50, c("norm"))).over(route),
        "_low": held(F.floor(at)), "_high": held(F.ceil(at)),
    })
    p90 = F.when(c("_low") == c("_high"), c("_low")).otherwise((F.ceil(at) - at) * c("_low") + (at - F.floor(at)) * c("_high"))
    # Weights and thresholds.
    quality = (
        0.40 * c("_top") + 0.25 * F.when(c("_n") >= 5, p90).otherwise(c("_top")) + 0.20 * c("_mean50")
        + 0.10 * F.least(F.lit(1.0), c("_n") / 200) + 0.05 * F.greatest(F.lit(0.0), c("_top") - c("_mean"))
    )
    prior: Column = F.lit(1.0)
    for name, p in priors.items():
        prior = F.when(c("route") == name, p).otherwise(prior)
    raw = stats.withColumn("_raw", prior * F.greatest(F.lit(0.05), 0.5 + quality))
    first = lambda x: F.when(c("_r") == 1, x)
    return raw.withColumn("weight", c("_raw") / F.sum(first(c("_raw"))).over(w) * F.count(first(F.lit(1))).over(w)).select(*normed.columns, "weight")


def route_weights(normed: DataFrame, priors: dict[str, float]) -> DataFrame:
    """normed: request, item, route, norm. request, route and weight of each route."""
    return weighed(normed, priors).groupBy("request", "route").agg(F.max("weight").alias("weight"))


def relevance_grades(rows: DataFrame, label: str) -> DataFrame:
    """0 for labels that are not positive, else 1 to 5 by the quintile edges of the positives; equal edges count once."""
    edges = quantiles(rows.where(F.col(label) > 0).withColumn(label, F.col(label).cast("double")), label, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], "_edges")
    inner = F.array_distinct("_edges")
    # equal edges count once; the least and the largest are no inner edges
    grade = 1 + F.size(F.filter(F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))), lambda e: e <= F.col(label)))
    return rows.crossJoin(F.broadcast(edges)).withColumn("grade", F.when(F.col(label) > 0, grade).otherwise(0)).drop("_edges")


def search_final(rows: DataFrame) -> Column:
    """The final score of search: preranking, the adjusted deep score and lexical evidence."""
    c = F.col
    # Weights and thresholds.
    adjusted = (
        c("deep") + 0.18 * c("lexical") + 1.05 * c("exact") + 1.25 * c("cover") + 0.90 * c("strong")
        + 0.16 * (c("deep") - c("pre")) - 2.0 * c("hard") - 0.65 * c("weak")
    )
    return 0.72 * c("pre") + 0.28 * adjusted + 0.04 * c("lexical") + 0.08 * c("cover") + 0.12 * c("exact")


def diversified(ranked: DataFrame, seen: DataFrame, exposed: DataFrame, size: int = 20) -> DataFrame:
    """ranked: request, user, item, score. Items of the user's history lose 0.90. Exposed items go where at least
    min(size, all) others remain, else they lose 0.28."""
    marked = (
        ranked.join(seen.select("user", "item").distinct().withColumn("_seen", F.lit(1)), ["user", "item"], "left")
        .join(exposed.select("user", "item").distinct().withColumn("_shown", F.lit(1)), ["user", "item"], "left")
    )
    w = Window.partitionBy("request")
    fresh = F.sum(F.when(F.col("_shown").isNull(), 1).otherwise(0)).over(w)
    enough = fresh >= F.least(F.lit(size), F.count("*").over(w))
    score = F.col("score") - F.when(F.col("_seen").isNotNull(), 0.90).otherwise(0.0) - F.when(F.col("_shown").isNotNull(), 0.28).otherwise(0.0)
    kept = marked.withColumns({"_enough": enough, "final": score}).where("_shown is null or not _enough")
    return top_k(kept, "request", [F.desc(F.round("final", 9)), F.col("item")], 1 << 30).select("request", "item", "final", "rank")


def backfilled(ranked: DataFrame, pool: DataFrame, size: int) -> DataFrame:
    """ranked: request, item, score. Requests of fewer than size items get the pool's first items that they lack, below all of their scores.

    pool: item, place (from 0), no more than a page and so broadcast.
    """
    have = ranked.groupBy("request").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    offered = have.where(F.col("n") < size).crossJoin(F.broadcast(pool)).join(ranked.select("request", "item"), ["request", "item"], "left_anti")
    order = F.row_number().over(Window.partitionBy("request").orderBy("place")) - 1
    more = offered.withColumn("i", order).where(F.col("i") < size - F.col("n")).select("request", "item", (F.col("floor") - 1 - F.col("i") / 1000).alias("score"))
    return ranked.select("request", "item", "score", F.lit(0).alias("filled")).unionByName(more.withColumn("filled", F.lit(1)))


def preference_counts(history: DataFrame, key: str, k: int) -> DataFrame:
    """history: user, recency, and a key. The sum of 1 / (1 + recency), the first k of each user."""
    counts = history.groupBy("user", key).agg(F.sum(1 / (1 + F.col("recency"))).alias("weight"))
    return top_k(counts, "user", [F.desc(F.round("weight", 9)), F.col(key)], k)


def linkage_context(history: DataFrame, key: str, most_weighted: int = 8, most_counted: int = 6) -> DataFrame:
    """history: user, recency, key. user, weighted (the keys by the sum of 1 / (1 + recency)) and counted (by how often), each at most so many."""
    sums = history.groupBy("user", key).agg(F.sum(1 / (1 + F.col("recency"))).alias("_w"), F.count("*").alias("_n"))
    w = Window.partitionBy("user")
    placed = sums.withColumns({"_a": F.row_number().over(w.orderBy(F.desc(F.round("_w", 9)), key)), "_b": F.row_number().over(w.orderBy(F.desc("_n"), key))})
    listed = lambda at, most: F.transform(F.sort_array(F.collect_list(F.when(F.col(at) <= most, F.struct(at, key)))), lambda x: x[key])
    return placed.groupBy("user").agg(listed("_a", most_weighted).alias("weighted"), listed("_b", most_counted).alias("counted"))


def corrections(terms: DataFrame, unknown: DataFrame, least: float = 0.75, pool: int = 80) -> DataFrame:
    """terms: term, freq. unknown: term. The best of the first pool terms of its bucket, within one edit, if it scores enough. Known terms, those of at most
    two characters, and those of Latin letters and digits stay as they are and are not returned."""
    keyed = top_k(terms.withColumn("bucket", text.bucket_key(F.col("term"))), "bucket", [F.desc("freq"), F.desc(F.length("term")), F.col("term")], pool, "place")
    known = keyed.select(F.col("term").alias("known"), "freq", "bucket", "place")
    asked = unknown.where((F.length("term") > 2) & ~F.col("term").rlike("^[a-z0-9]+$")).join(terms.select("term"), "term", "left_anti")
    pairs = asked.select("term", text.bucket_key(F.col("term")).alias("bucket")).join(known, "bucket").where(F.abs(F.length("known") - F.length("term")) <= 1)
    edits = pairs.withColumn("edits", F.levenshtein("term", "known", 1)).where("edits >= 0")
    letters = lambda c: F.array_distinct(F.split(c, ""))
    a, b = letters(F.col("term")), letters(F.col("known"))
    # Weights and thresholds.
    score = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) + 0.05 * F.log1p("freq") - 0.35 * F.col("edits")
    scored = edits.withColumn("score", score).where(F.col("score") >= least)
    return top_k(scored, "term", [F.desc(F.round("score", 9)), F.col("place")], 1).select("term", "known", "score")


def pairwise_loss(rows: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """The pairwise logistic loss of each group, weighted by what a swap would change in NDCG. Groups are pages: a few items each."""
    placed = rows.withColumns({
        "_at": F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), "item")),
        "_best": F.row_number().over(Window.partitionBy(group).orderBy(F.desc(label), "item")),
    })
    gain = F.pow(2.0, F.col(label)) - 1
    cut = placed.select(group, score, label, gain.alias("_g"), (1 / F.log2(F.col("_at") + 1.0)).alias("_d"), (gain / F.log2(F.col("_best") + 1.0)).alias("_i"))
    ideal = cut.groupBy(group).agg(F.sum("_i").alias("_ideal"))
    a, b = cut.alias("a"), cut.alias("b")
    pairs = a.join(b, F.expr(f"a.{group} = b.{group} and a.{label} > b.{label}")).select(
        F.col(f"a.{group}").alias(group),
        (F.log1p(F.exp(-(F.col(f"a.{score}") - F.col(f"b.{score}")))) * F.abs((F.col("a._g") - F.col("b._g")) * (F.col("a._d") - F.col("b._d")))).alias("l"),
    )
    return pairs.groupBy(group).agg(F.sum("l").alias("l")).join(ideal, group).select(group, (F.col("l") / (F.col("_ideal") + 1e-9)).alias("loss"))


def neighbour_recall(history: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """history: user, src, recency. near: src, dst, score. Neighbours of what a user saw, less for older ones, more for those met often; not what was seen."""
    met = history.join(near, "src").join(history.select("user", F.col("src").alias("dst")).distinct(), ["user", "dst"], "left_anti")
    # Weights and thresholds.
    decayed = F.sum(F.col("score") / (1 + 0.35 * F.col("recency"))) + 0.035 * (F.count("*") - 1)
    return top_k(met.groupBy("user", "dst").agg(decayed.alias("score")), "user", [F.desc(F.round("score", 9)), F.col("dst")], k)


# What a suggestion is said to be: a correction, a completion, a related search.
HINTS = ("纠错建议", "热门补全", "相关搜索")
PINNED = 20.0


def suggestions(typed: DataFrame, counted: DataFrame, k: int) -> DataFrame:
    """typed: typed, distinct, normalised, and corrected, null where it stays. counted: query, n. The best queries that start with what was typed or its correction,
    hold it or share a term with it, with a hint each; a correction comes first.

    A query can only hold what was typed where it has its first four characters (all, of shorter ones), and shares a term only where it has the
    term: both are keys to join on, so no typed text meets the whole catalogue.
    """
    t, q, c = F.col("typed"), F.col("query"), F.col("meant")

    def keys(value: Column, grams: Column) -> Column:
        return F.array_distinct(F.concat(F.transform(text.seed_terms(value), lambda x: F.concat(F.lit("t"), x)), F.transform(grams, lambda x: F.concat(F.lit("g"), x))))

    corrected = F.col("corrected") if "corrected" in typed.columns else F.lit(None).cast("string")
    asked = typed.where(t != "").select("typed", F.coalesce(corrected, t).alias("meant"))
    both = lambda f: F.array_distinct(F.concat(f(t), f(c)))
    left = asked.select("typed", "meant", F.explode(both(lambda x: keys(F.trim(x), F.array(F.substring(x, 1, 4))))).alias("key"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length(q)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length(q) - i + 1)), lambda n: q.substr(i, n))))
    right = counted.where(q != "").select("query", "n", F.explode(keys(q, grams)).alias("key"))
    # Spark takes exploded rows to be as small as what they came from, and would broadcast them by that.
    pairs = left.join(right.hint("merge"), "key").select("typed", "meant", "query", "n").distinct()
    mine = text.seed_terms(F.trim(c))
    overlap = F.size(F.array_intersect(mine, text.seed_terms(q))) / F.greatest(F.size(mine), F.lit(1))
    starts, holds = F.startswith(q, t) | F.startswith(q, c), F.contains(q, t) | F.contains(q, c)
    scored = pairs.withColumns({"_s": starts, "_c": holds, "_o": overlap}).where("_s or _c or _o > 0")
    # Weights and thresholds.
    score = (
        F.when((q == t) | (q == c), 18.0).otherwise(0.0) + F.when(F.col("_s"), 9.0).otherwise(0.0) + F.when(F.col("_c"), 2.4).otherwise(0.0)
        + 5.8 * F.col("_o") + 0.45 * F.log1p("n") - 0.05 * F.abs(F.length(q) - F.length(c))
    )
    hint = F.when(q == c, HINTS[0]).when(F.col("_s"), HINTS[1]).otherwise(HINTS[2])
    found = scored.where((q != c) | (t == c)).select("typed", "query", score.alias("score"), F.col("n").alias("base"), hint.alias("hint"))
    pinned = asked.where(t != c).join(counted.withColumnRenamed("query", "meant"), "meant", "left").select(
        "typed", c.alias("query"), F.lit(PINNED).alias("score"), F.coalesce("n", F.lit(0)).alias("base"), F.lit(HINTS[0]).alias("hint")
    )
    return top_k(found.unionByName(pinned), "typed", [F.desc(F.round("score", 9)), F.desc("base"), F.length(q), q], k)


def lexical_gate(rows: DataFrame, enough: int) -> DataFrame:
    """rows: request, item, base, exact, cover, lexical, intent. Adjusted scores; only strong matches where a request has enough, else weaker ones with
    some evidence too."""
    c = F.col
    # Weights and thresholds.
    marked = rows.withColumns({
        "_strong": (c("exact") == 1) | (c("cover") >= 0.45) | (c("lexical") >= 1.25),
        "_weak": (c("exact") == 0) & (c("cover") < 0.34),
        "_hard": (c("exact") == 0) & (c("cover") < 0.20) & (c("lexical") < 0.80),
    })
    score = (
        c("base") + 1.55 * c("exact") + 0.32 * c("lexical") + 1.60 * c("cover") + 0.85 * c("_strong").cast("int") + 0.42 * c("intent")
        - 0.72 * c("_weak").cast("int") - 2.20 * c("_hard").cast("int")
    )
    n_strong = F.count(F.when(c("_strong"), 1)).over(Window.partitionBy("request"))
    kept = marked.withColumns({"score": score, "_n": n_strong}).where(c("_strong") | ((c("_n") < enough) & ((c("cover") >= 0.24) | (c("lexical") >= 0.90))))
    return top_k(kept, "request", [F.desc("_strong"), F.desc(F.round("score", 9)), F.col("item")], 1 << 30)


def feed(ranked: DataFrame, seen: DataFrame, items: DataFrame, page: int, size: int, excluded: DataFrame | None = None) -> DataFrame:
    """One page of each request: what the user has seen loses 0.90, excluded pairs (request, item) go, and items gives the cards' fields."""
    left = ranked if excluded is None else ranked.join(excluded.select("request", "item").distinct(), ["request", "item"], "left_anti")
    marked = left.join(seen.select("user", "item").distinct().withColumn("_seen", F.lit(1)), ["user", "item"], "left")
    final = marked.withColumn("final", F.col("score") - F.when(F.col("_seen").isNotNull(), 0.90).otherwise(0.0))
    placed = top_k(final, "request", [F.desc(F.round("final", 9)), F.col("item")], page * size, "place").where(F.col("place") > (page - 1) * size)
    return placed.join(items, "item", "left").select("request", "user", "item", "place", "final", *(c for c in items.columns if c != "item"))


def linkage_boosts(rows: DataFrame, keywords: Column, tags: Column, search: bool) -> Column:
    """What a candidate (title, content, tag_1.. columns) gains by the keywords (four at most) and tags of the user's other scene."""
    # Weights and thresholds.
    in_title, in_content, by_tag = (0.05, 0.02, 0.10) if search else (0.14, 0.06, 0.06)
    words = F.filter(F.transform(F.slice(keywords, 1, 4), lambda k: F.lower(F.trim(k))), lambda k: k != "")

    def held(column: str) -> Column:
        value = F.lower(F.coalesce(F.col(column), F.lit("")))
        return F.size(F.filter(words, lambda k: F.contains(value, k)))

    total = in_title * held("title") + in_content * held("content")
    for c in rows.columns:
        if c.startswith("tag_"):
            total = total + F.when(F.array_contains(tags, F.col(c)), by_tag).otherwise(0.0)
    return total


def padded_sequences(history: DataFrame, vectors: DataFrame, size: int, length: int) -> DataFrame:
    """history: user, vec_id, recency. vectors: vec_id, v (of length numbers). Each user's vectors, newest first, unknown ones dropped, size at most and then zeros."""
    known = history.join(vectors, "vec_id")
    first = top_k(known, "user", [F.col("recency"), F.col("vec_id")], size, "_r")
    found = first.groupBy("user").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "v"))), lambda x: x["v"]).alias("found"))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), length), F.lit(size) - F.size("found"))
    return history.select("user").distinct().join(found, "user", "left").withColumn("found", F.coalesce("found", F.array().cast("array<array<double>>"))).select(
        "user", F.size("found").alias("n"), F.concat("found", zeros).alias("sequence")
    )


def fitted_z_scores(rows: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / (sd + 1e-6) by the mean and population deviation of train alone; 0 where it has none to speak of."""
    stats = train.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = rows.crossJoin(F.broadcast(stats))
    scaled = {c: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) < 1e-6, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6)) for c in columns}
    return out.withColumns(scaled).drop(*stats.columns)
