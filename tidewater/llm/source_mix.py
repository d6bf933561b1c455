"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources share target_share of all sizes by weight; none gets more than max_copies times
its own size, and what is above is shared anew by weight (solved at once: capped sources are those of
the smallest cap to weight ratio, found by a running sum over one row per source).
Copies: a source with target T and size S takes floor(T / S) whole copies of each document. The rest of
the target is filled by a sample of one more copy: document i has inclusion probability p_i in
proportion to the square root of its size (normed so that the expected words are the rest), a uniform
u_i from the md5 of its id, and rank u_i / (1 - u_i) over p_i / (1 - p_i). Documents are taken in order of
rank until the words are used up; the last is taken if that comes nearer to the target.

All sums are of integers, so reruns agree to the bit. A hot source is never ordered as a whole: ranks
fall into slices of about SLICE documents, slice sums locate the one in which the words run out, and
only that slice is ordered.

Defined cases: null texts have size 0 and, as all documents of size 0, take 0 words; null is a source
of its own, last in order; ties of rank go by id, then size, and rows alike in both are interchangeable;
without any words all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, words_column, written

SHARE_PERCENT = 150
MAX_COPIES = 2
WEIGHTS = (3, 1, 2)
SLICE = 4_096


def mix_targets(by_source: DataFrame, percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES, weights=WEIGHTS) -> DataFrame:
    """by_source: source, source_size. Adds target. One row per source passes through one task."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    rows = by_source.withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("cap", max_copies * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * percent / 100
    rows = rows.withColumn(
        "level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    ).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    water = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(whole)["level"]
    return rows.withColumn(
        "target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(water * F.col("weight"))
    ).select("source", "source_size", "target")


def uniform(id_col: Column, seed: int) -> Column:
    """Strictly between 0 and 1, from 52 bits of the md5 of the id and the seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def pareto_mix(sized: DataFrame, targets: DataFrame, seed: int = 17, carried: tuple[str, ...] = ()) -> DataFrame:
    """sized: doc_id, source, size and what is carried (a written table: it is read more than once). targets: of mix_targets."""
    gauge = F.floor(F.sqrt(F.col("size"))).cast("long")
    sums = sized.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("size") * gauge).alias("gauged")
    )
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = (
        targets.withColumnRenamed("source", "_s").join(sums, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
        .withColumn("copies", copies)
        .withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("slices", F.ceil(F.col("n_docs") / F.lit(SLICE)).cast("long"))
        .withColumnRenamed("source", "_s")
    )
    u = uniform(F.col("doc_id"), seed)
    p = F.least(F.lit(1 - 1e-9), F.col("budget") * gauge / F.col("gauged"))
    ranked = (
        sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("u", u)
        .withColumn("p", F.when((F.col("gauged") > 0) & (F.col("budget") > 0), p).otherwise(F.lit(0.0)))
        .withColumn("rank_key", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        # rank_key / (1 + rank_key) grows with rank_key and lies between 0 and 1
        .withColumn("slice", F.floor(F.col("rank_key") / (1 + F.col("rank_key")) * F.col("slices")).cast("long"))
    )
    sampled = ranked.where("rank_key is not null")
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        sampled.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
        .withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        .where("before < budget")
        .groupBy("source").agg(F.max(F.struct("slice", "before")).alias("m"))
        .select(F.col("source").alias("_s"), F.col("m.slice").alias("last_slice"), F.col("m.before").alias("before"))
    )
    placed = ranked.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    kept = ["doc_id", "source", "size", "source_size", "target", "copies", *carried]
    open_slice = F.coalesce((F.col("slice") == F.col("last_slice")) & (F.col("copies") < MAX_COPIES), F.lit(False))
    clear = placed.where(~open_slice).select(*kept, F.coalesce((F.col("slice") < F.col("last_slice")).cast("long"), F.lit(0)).alias("more"))
    # a struct, so that the rows are dealt anew: a join on source and a window on it would share one task for each source
    inside = Window.partitionBy(F.struct("source")).orderBy("rank_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    at_end = placed.where(open_slice).select(*kept, (ahead + F.col("size") / 2 <= F.col("budget")).cast("long").alias("more"))
    out = clear.unionByName(at_end)
    return out.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("copies") + F.when(F.col("copies") < MAX_COPIES, F.col("more")).otherwise(0))).alias("taken"),
        F.when(F.col("size") > 0, F.col("copies") + F.when(F.col("copies") < MAX_COPIES, F.col("more")).otherwise(0)).otherwise(0).alias("n_copies"),
        "source", *carried,
    )


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words_column("text")).cast("long").alias("size"))


def _mixed(sized: DataFrame, seed: int, carried: tuple[str, ...] = ()) -> DataFrame:
    targets = mix_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    return pareto_mix(sized, targets, seed, carried)


def source_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_copies and source of every document."""
    return _mixed(written(sizes(docs), "sizes"), seed)


def mixture(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs, whatever its columns, with each row as many times as the mix takes it. Rows are told apart by a number written beside them."""
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("doc")
    held = docs.select(whole, F.monotonically_increasing_id().alias("row"), F.size(words_column("text")).cast("long").alias("size"))
    held = written(held, "to-mix")
    sized = held.select("doc.doc_id", "doc.source", "size", "row")
    times = _mixed(sized, seed, ("row",)).where("n_copies > 0").select("row", F.col("n_copies").cast("int").alias("n"))
    return held.join(times, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


#: The same mix for DuckDB.
SOURCE_MIX_SQL = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
by_source as (
  select source, cast(sum(size) as bigint) as source_size, count(*) as n_docs,
         cast(sum(size * cast(floor(sqrt(size)) as bigint)) as bigint) as gauged,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight
  from sized group by source),
filled as (
  select *, 2 * source_size as cap,
         (sum(source_size) over () * 150 / 100.0
           - coalesce(sum(2 * source_size) over (order by 2.0 * source_size / weight, source nulls last
               rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by 2.0 * source_size / weight, source nulls last
               rows between current row and unbounded following) as level
  from by_source),
water as (
  select *, min(case when cap > level * weight then level end) over () as w from (
    select *, cap <= level * weight as capped from filled)),
targets as (
  select *, case when capped then cast(cap as double)
                 else first_value(case when not capped then level end ignore nulls)
                        over (order by cap::double / weight, source nulls last
                              rows between unbounded preceding and unbounded following) * weight end as target
  from water),
plan as (
  select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as bigint) as copies from targets),
budgeted as (select *, target - copies * source_size as budget from plan),
keyed as (
  select s.doc_id, s.size, b.*,
         (cast(cast('0x' || substr(md5(cast(s.doc_id as varchar) || ':17'), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0 as u,
         case when gauged > 0 and budget > 0
              then least(1 - 1e-9, budget * cast(floor(sqrt(s.size)) as bigint) / gauged) else 0 end as p
  from sized s join budgeted b on s.source is not distinct from b.source),
ranked as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as rank_key from keyed),
placed as (
  select *, coalesce(sum(case when rank_key is not null then size end) over (partition by source order by rank_key nulls last, doc_id, size
      rows between unbounded preceding and 1 preceding), 0) as ahead from ranked),
done as (
  select *, case when size = 0 then 0 else copies
           + case when copies < 2 and rank_key is not null and ahead + size / 2.0 <= budget then 1 else 0 end end as n
  from placed)
select doc_id, size, source_size, target, cast(size * n as bigint) as taken, cast(n as bigint) as n_copies from done
"""
