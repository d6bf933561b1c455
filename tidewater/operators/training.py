"""Splits, negative sampling and the search for blend weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import auc, ndcg
from .relational import min_max, top_k


def order_hash(key: Column, seed: int = 42) -> Column:
    """A portable random order: the md5 of seed|key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def group_split(rows: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """The groups of rows with validation true for round(share * groups) of them, one at least and not all, by order_hash.

    No task orders all groups: hashes are counted by their first four digits (65,536 rows at most), and only the
    groups of the prefix in which the boundary lies are ranked. Fewer than two groups: none is for validation.
    """
    groups = rows.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_h", order_hash(F.col(group), seed))
    groups = groups.withColumn("_p", F.substring("_h", 1, 4))
    counts = groups.groupBy("_p").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    wanted = F.when(F.col("_all") < 2, 0).otherwise(F.greatest(F.lit(1), F.least(F.round(F.col("_all") * share), F.col("_all") - 1)))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    placed = counts.withColumn("_before", before).crossJoin(F.broadcast(total.select(wanted.alias("_wanted")))).withColumn("_left", F.col("_wanted") - F.col("_before"))
    marked = groups.join(placed.select("_p", "_n", "_left"), "_p")
    inside = F.col("_left").between(1, F.col("_n") - 1)
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_h", group))
    whole = marked.where(~inside).select(group, (F.col("_left") >= F.col("_n")).alias("validation"))
    return whole.unionByName(marked.where(inside).withColumn("_r", rank).select(group, (F.col("_r") <= F.col("_left")).alias("validation")))


def truth_list(details: Column, results: Column, limit: int = 200) -> Column:
    """The distinct items, at most limit, of a request's details (structs of position and item) by position, then item; without details, of its results."""
    ordered = lambda c: F.filter(F.transform(F.array_sort(c), lambda x: x["item"]), lambda i: i >= 0)
    return F.slice(F.array_distinct(F.when(F.size(details) > 0, ordered(details)).otherwise(ordered(results))), 1, limit)


def best_negatives(rows: DataFrame, group: str, label: str, rank: str, most: int) -> DataFrame:
    """All positives, and the most best-ranked negatives of each group."""
    place = F.row_number().over(Window.partitionBy(group, F.col(label) > 0).orderBy(rank, "item"))
    return rows.withColumn("_r", place).where((F.col(label) > 0) | (F.col("_r") <= most)).drop("_r")


def hard_and_easy(rows: DataFrame, group: str, label: str, rank: str, most: int, pool: int = 7, seed: int = 42) -> DataFrame:
    """most negatives of each group, one hard for two easy. Hard ones come from the pool best-ranked negatives, easy ones from the rest, both in a
    random order; what one kind lacks, the other gives. rows with kind: positive, hard, easy."""
    by_rank = F.row_number().over(Window.partitionBy(group, F.col(label) > 0).orderBy(rank, "item"))
    kind = F.when(F.col(label) > 0, "positive").when(by_rank <= pool, "hard").otherwise("easy")
    marked = rows.withColumn("kind", kind)
    each = Window.partitionBy(group, "kind").orderBy(order_hash(F.concat_ws("|", group, "item"), seed), "item")
    placed = marked.withColumn("_r", F.row_number().over(each))
    whole = Window.partitionBy(group)
    n_hard, n_easy = (F.count(F.when(F.col("kind") == k, 1)).over(whole) for k in ("hard", "easy"))
    placed = placed.withColumns({"_hard": n_hard, "_easy": n_easy})
    wish = F.lit(most // 3)
    easy = F.least(F.col("_easy"), most - F.least(wish, F.col("_hard")))
    hard = F.least(F.col("_hard"), most - easy)
    return placed.where((F.col("kind") == "positive") | ((F.col("kind") == "hard") & (F.col("_r") <= hard)) | ((F.col("kind") == "easy") & (F.col("_r") <= easy))).drop("_r", "_hard", "_easy")


def blend_weights(rows: DataFrame, group: str, a: str, b: str, label: str, steps: int = 21, k: int = 10) -> DataFrame:
    """The mean NDCG of (1 - w) a + w b, both scaled within their group, for each of steps weights from 0 to 1."""
    scaled = rows.withColumns({"_a": min_max(group, a, 0.0, 1e-6), "_b": min_max(group, b, 0.0, 1e-6)})
    grid = scaled.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    w = F.col("step") / (steps - 1)
    tried = grid.withColumns({"_s": F.round((1 - w) * F.col("_a") + w * F.col("_b"), 9), "_g": F.struct(group, "step")})
    each = ndcg(tried, "_g", "_s", label, k)
    return each.groupBy(F.col("_g.step").alias("step")).agg(F.avg("ndcg").alias("ndcg")).withColumn("weight", F.col("step") / (steps - 1))


def best_weight(rows: DataFrame, group: str, a: str, b: str, label: str, steps: int = 21, k: int = 10) -> DataFrame:
    """One row: the weight of the highest mean NDCG (to nine digits), then of the highest AUC, then the smallest, with both."""
    tried = blend_weights(rows, group, a, b, label, steps, k)
    top = tried.agg(F.max(F.round("ndcg", 9)).alias("_top"))
    best = tried.crossJoin(F.broadcast(top)).where(F.round("ndcg", 9) == F.col("_top")).select("step", "weight", "ndcg")
    scaled = rows.withColumns({"_a": min_max(group, a, 0.0, 1e-6), "_b": min_max(group, b, 0.0, 1e-6)})
    scored = scaled.crossJoin(F.broadcast(best.select("step", "weight"))).withColumn("_s", F.round((1 - F.col("weight")) * F.col("_a") + F.col("weight") * F.col("_b"), 9))
    areas = auc(scored, "_s", label, "step").select("step", "auc")
    return best.join(areas, "step").orderBy(F.desc(F.round("auc", 9)), "step").limit(1).select("weight", "ndcg", "auc")


def drawn(draws: DataFrame, items: DataFrame, slots: int | None = None) -> DataFrame:
    """draws: any columns and x in [0, 1). items: item, w. Each draw gets the item in whose stretch of the summed weights x lies, in order of item.

    Sums run over ranges of items first and then within them, so no task sums all items; a draw and an item meet in the
    slots of x that the item's stretch crosses, so the join is by equality. There are as many slots as items, unless told, so a draw meets few.
    """
    slots = slots or max(4096, items.count())
    ranged = items.withColumn("_p", F.pmod(F.floor(F.col("item") / 1024), F.lit(1 << 40)))
    parts = ranged.groupBy("_p").agg(F.sum("w").alias("_w"))
    before = F.sum("_w").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    total = parts.agg(F.sum("_w").alias("_all"))
    run = F.sum("w").over(Window.partitionBy("_p").orderBy("item").rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn("_run", run).join(parts.withColumn("_before", before).drop("_w"), "_p").crossJoin(F.broadcast(total))
    high = F.round((F.col("_before") + F.col("_run")) / F.col("_all"), 12)
    low = F.round((F.col("_before") + F.col("_run") - F.col("w")) / F.col("_all"), 12)
    ends = summed.select("item", low.alias("_low"), high.alias("_high"))
    crossed = ends.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_low") * slots), F.least(F.floor(F.col("_high") * slots), F.lit(slots - 1)))))
    met = draws.withColumn("_slot", F.floor(F.col("x") * slots)).join(crossed, "_slot").where((F.col("x") >= F.col("_low")) & (F.col("x") < F.col("_high")))
    return met.drop("_slot", "_low", "_high")


def session_split(rows: DataFrame, session: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with validation: whole sessions go to either side. The training side has floor(n * (1 - share)) sessions, one at least and not all; a single session is an error
    for who calls, so none is for validation here."""
    groups = rows.where(F.col(session).isNotNull()).select(session).distinct()
    placed = _ranked_by_hash(groups, session, seed)
    n = F.col("_all")
    cut = F.least(F.greatest(F.lit(1), F.floor(n * (1.0 - share))), F.greatest(n - 1, F.lit(1)))
    sides = placed.select(session, (F.col("_place") > cut).alias("validation"))
    return rows.join(sides, session)


def _ranked_by_hash(groups: DataFrame, key: str, seed: int) -> DataFrame:
    """groups with _place, from 1, in the order of their hashes, and _all. Counts by the first four digits stand in for one sort of all."""
    hashed = groups.withColumn("_h", order_hash(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, 4))
    counts = hashed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    total = counts.agg(F.sum("_n").alias("_all"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
    starts = counts.withColumn("_before", before).select("_p", "_before").crossJoin(F.broadcast(total))
    return hashed.withColumn("_r", inside).join(starts, "_p").withColumn("_place", F.col("_before") + F.col("_r")).drop("_h", "_p", "_r", "_before")


def exposed_negatives(rows: DataFrame) -> DataFrame:
    """request and items: what was shown and not clicked, each once, by id. rows: request, item, click."""
    return rows.where("click <= 0").groupBy("request").agg(F.sort_array(F.collect_set("item")).alias("items"))


def positive_sets(rows: DataFrame) -> DataFrame:
    """request and items: what was clicked or has a positive label, each once, by id."""
    return rows.where("click > 0 or y > 0").groupBy("request").agg(F.sort_array(F.collect_set("item")).alias("items"))


def with_external(rows: DataFrame, external: DataFrame, column: str = "hard_negatives") -> DataFrame:
    """rows with the hard negatives of external (request, or request and item, and the column; the first row of a key by the smallest list); where these are
    missing or empty the rows' own, else none."""
    keys = [k for k in ("request", "item") if k in external.columns]
    one = external.groupBy(*keys).agg(F.min(column).alias("_ext"))
    own = F.coalesce(F.col(column), F.array().cast("array<bigint>")) if column in rows.columns else F.array().cast("array<bigint>")
    return rows.join(one, keys, "left").withColumn(column, F.when(F.size("_ext") > 0, F.col("_ext")).otherwise(own)).drop("_ext")


def list_coverage(rows: DataFrame, column: str) -> DataFrame:
    """One row: the share of rows whose list is not empty, and the mean length."""
    n = F.greatest(F.size(F.col(column)), F.lit(0))
    return rows.agg(F.avg((n > 0).cast("double")).alias("coverage"), F.avg(n).alias("mean_length"), F.count("*").alias("n_rows"))


def negative_mode(rows: DataFrame, wanted: str, columns: tuple[str, ...] = ("hard_negatives", "hard_neg_note_idxs")) -> tuple[str, str | None]:
    """hard or easy, and the first of columns that rows have. auto and hard are hard where a list is not empty; hard falls back to easy."""
    found = next((c for c in columns if c in rows.columns), None)
    if wanted == "easy" or found is None:
        return "easy", found
    return ("easy" if rows.where(F.size(found) > 0).isEmpty() else "hard"), found


def negatives_drawn(rows: DataFrame, items: DataFrame, n: int = 3, kept: int = 10, shares: tuple[int, int] = (1, 2), column: str = "hard_negatives", seed: int = 42) -> DataFrame:
    """n negatives of each row (id and a list of hard negatives): of the first kept known hard ones as many as shares say, at least one, the rest by popularity.
    items: item, w. id, turn, item and kind. A row without hard ones has easy ones alone. Draws are hashes, so reruns agree."""
    known = rows.select("id", F.posexplode(F.slice(column, 1, kept)).alias("_at", "item")).join(items.select("item").distinct(), "item")
    hard = known.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "item"))), lambda x: x["item"]).alias("_hard"))
    n_hard = max(1, int(n * shares[0] / sum(shares) + 0.5))
    turns = rows.select("id").join(hard, "id", "left").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    digits = F.substring(order_hash(F.concat_ws("|", "id", "turn"), seed), 1, 13)
    drawn_at = turns.withColumn("x", F.conv(digits, 16, 10).cast("double") / float(16**13))
    is_hard = (F.coalesce(F.size("_hard"), F.lit(0)) > 0) & (F.col("turn") < n_hard)
    chosen = F.get("_hard", F.floor(F.col("x") * F.size("_hard")).cast("int"))
    hards = drawn_at.where(is_hard).select("id", "turn", chosen.alias("item"), F.lit("hard").alias("kind"))
    easy = drawn(drawn_at.where(~is_hard).select("id", "turn", "x"), items)
    return hards.unionByName(easy.select("id", "turn", "item", F.lit("easy").alias("kind")))


def item_meta(rows: DataFrame, columns: list[str], universe: DataFrame, order: str = "place") -> DataFrame:
    """One row for each item of rows and of universe (item): the columns of its first row by order, 0 for nulls and for items that rows lack."""
    first = top_k(rows, "item", [F.col(order)], 1, "_r").select("item", *columns)
    every = rows.select("item").unionByName(universe.select("item")).distinct()
    return every.join(first, "item", "left").select("item", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns))


def restricted(features: DataFrame, candidates: DataFrame) -> DataFrame:
    """Features of the pairs among candidates."""
    return features.join(candidates.select("request", "item"), ["request", "item"], "left_semi")


def candidate_frame(recalled: DataFrame, most: int) -> DataFrame:
    """The candidates up to a rank, of repeated ones the best rank."""
    return top_k(recalled.where(F.col("rank") <= most), ["request", "item"], [F.col("rank")], 1, "_r").drop("_r")


def group_sizes(rows: DataFrame, group: str = "request") -> DataFrame:
    """Rows of each group, in order of the group: what a ranker is told beside rows sorted by group."""
    return rows.groupBy(group).agg(F.count("*").alias("n"))


def vocabulary(values: DataFrame, column: str) -> DataFrame:
    """value and code, from 0, of the distinct values as text, in their order; nulls are one value, UNK. Numbered by ranges of the first two characters, so one
    task numbers a range and not all values."""
    each = values.select(F.coalesce(F.col(column).cast("string"), F.lit("UNK")).alias("value")).distinct().withColumn("_p", F.substring("value", 1, 2))
    counts = each.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("value"))
    return each.withColumn("_r", inside).join(counts.withColumn("_before", before).select("_p", "_before"), "_p").select("value", (F.col("_before") + F.col("_r") - 1).alias("code"))


def encoded(rows: DataFrame, vocabularies: dict[str, DataFrame]) -> DataFrame:
    """rows with a column <name>_enc for each vocabulary: the code of the column's value as text, 0 for null and unknown ones."""
    for name, codes in vocabularies.items():
        named = codes.select(F.col("value").alias(f"_{name}"), F.col("code").alias(f"{name}_enc"))
        rows = rows.join(named, F.col(name).cast("string") == F.col(f"_{name}"), "left").drop(f"_{name}").withColumn(f"{name}_enc", F.coalesce(f"{name}_enc", F.lit(0)))
    return rows


def vocabulary_sizes(vocabularies: dict[str, DataFrame]) -> DataFrame:
    """name and size, the largest code and one more, of each vocabulary that is not empty."""
    rows = [codes.agg(F.max("code").alias("m")).where("m is not null").select(F.lit(name).alias("name"), (F.col("m") + 1).alias("size")) for name, codes in vocabularies.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
