"""Truth frames, layered metrics, samples and training sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, recall, training
from ..operators.relational import min_max
from ..sources.roles import IMP, REQ, impressions, requests, table
from .features import LAB, labelled, query

LABELS = """lb as (select request, item, max(y) as y, min(user_id) as u from lab join req using (request) where position % 4 <> 3 group by 1, 2)"""


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of most impressions; the others have none."""
    return evaluation.labels(labelled(spark, d).where("position % 4 <> 3").join(requests(spark, d), "request"))


@query(f"""with {IMP}, {REQ}, {LAB}, {LABELS}, t as (select request, item, row_number() over (partition by request order by price desc, item) as place from imp)
select t.request, t.item, place, round(coalesce(y, 0), 6) as y, u as "user" from t left join lb using (request, item) where place <= 3""")
def truth_frames(spark: SparkSession, d: str) -> DataFrame:
    lists = impressions(spark, d).groupBy("request").agg(F.sort_array(F.collect_list(F.struct(-F.col("price"), "item"))).alias("s"))
    out = evaluation.truth_frame(lists.select("request", F.col("s.item").alias("items")), labels(spark, d), 3)
    return out.select("request", "item", F.col("place").cast("long").alias("place"), F.round("y", 6).alias("y"), "user")


PICKED = """gs as (select request, u, count(case when y > 0 then 1 end) as positives, max(y) as best from lb group by 1, 2)"""


@query(f"""with {IMP}, {REQ}, {LAB}, {LABELS}, {PICKED}, a as (select *, 0 as part from gs where u = 5 order by positives desc, best desc, request limit 15), b as (select *, 1 as part from gs where u <> 5 order by positives desc, best desc, request limit 30),
c as (select * from a union all select * from b) select request, positives, round(best, 6) as best, row_number() over (order by part, positives desc, best desc, request) as place from c qualify place <= 30""")
def picked_groups(spark: SparkSession, d: str) -> DataFrame:
    """Requests with most positives; up to half are one user's."""
    return evaluation.picked_groups(labels(spark, d), 30, 5).withColumn("best", F.round("best", 6))


@query(f"""with {IMP}, {REQ}, {LAB}, {LABELS}, sg as (select request from (select distinct request from imp) order by md5('42|' || request), request limit 100),
rc as (select request, item, row_number() over (partition by request order by page_time desc, item) as rank, price as score from imp where position % 2 = 1 and request in (select request from sg)),
fu as (select coalesce(rc.request, lb.request) as request, coalesce(rc.item, lb.item) as item, rank, score, coalesce(y, 0) as y from rc full join (select * from lb where request in (select request from sg)) lb on lb.request = rc.request and lb.item = rc.item),
fl as (select *, row_number() over (partition by request, score is null, y > 0 order by item) - 1 as i, min(score) over (partition by request) as f from fu)
select request, item, rank, round(coalesce(score, coalesce(f, 0) - case when y > 0 then 2 else 1 end - i / 1000), 6) as score, round(y, 6) as y, (select count(case when y > 0 then 1 end) from lb where lb.request = fl.request) as positives from fl where score is not null or y > 0""")
def recall_frames(spark: SparkSession, d: str) -> DataFrame:
    """A sample of requests: what was recalled with labels, and positives that were not, scored below."""
    rows = impressions(spark, d)
    found = rows.where("position % 2 = 1").select("request", "item", F.row_number().over(recall.Window.partitionBy("request").orderBy(F.desc("page_time"), "item")).alias("rank"), F.col("price").alias("score"))
    out = evaluation.recall_frame(found, labels(spark, d), evaluation.sampled_groups(rows, 100))
    return out.select("request", "item", "rank", F.round("score", 6).alias("score"), F.round("y", 6).alias("y"), "positives")


GRADE = """ed as (select quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e0 from {0} where y > 0), ei as (select list_sort(list_distinct(e0))[2:-2] as e from ed),
gr as (select {0}.*, case when y > 0 then 1 + len(list_filter(e, lambda v: v <= y)) else 0 end as grade from {0}, ei)"""


def _ndcg(name: str, score: str, k: int, rows: str = "gr") -> str:
    return f"""{name} as (select avg(n) as v from (select request, sum(case when a <= {k} then (pow(2, grade) - 1) / log2(a + 1) else 0 end) / (sum(case when b <= {k} then (pow(2, grade) - 1) / log2(b + 1) else 0 end) + 1e-9) as n from
  (select *, row_number() over (partition by request order by {score} desc, item) as a, row_number() over (partition by request order by grade desc, item) as b, count(*) over (partition by request) as c, max(grade) over (partition by request) as m from {rows}) where c > 1 and m > 0 group by 1))"""


@query(f"""with {IMP}, {REQ}, {LAB}, {LABELS}, jo as (select imp.request, imp.item, imp.position as rank, page_time as score, y from imp join lb using (request, item)), {GRADE.format('jo')}, {_ndcg('n10', 'score', 10)}, {_ndcg('n50', 'score', 50)},
h as (select request, max(case when r <= 2 then (y > 0)::int else 0 end) as a, max(case when r <= 100 then (y > 0)::int else 0 end) as b, count(*) as n from (select *, row_number() over (partition by request order by rank, item) as r from jo) group by 1)
select round(avg(a), 6) as recall_2, round(avg(b), 6) as recall_100, cast(sum(n) as bigint) as n_rows, count(*) as n_requests, round((select v from n10), 6) as ndcg_10, round((select v from n50), 6) as ndcg_50 from h""")
def recall_summaries(spark: SparkSession, d: str) -> DataFrame:
    found = impressions(spark, d).select("request", "item", F.col("position").alias("rank"), F.col("page_time").alias("score"))
    out = evaluation.recall_summary(found, labels(spark, d), (2, 100))
    return out.select(*(F.round(c, 6).alias(c) if c not in ("n_rows", "n_requests") else c for c in out.columns))


@query(f"""with {IMP}, {LAB}, {GRADE.format('lab')}, {_ndcg('n10', 'price', 10)}, {_ndcg('n50', 'price', 50)}, {_ndcg('b10', 'page_time', 10)}
select (select median(n) from (select count(case when y > 0 then 1 end) as n from lab group by request)) as median_positives, (select count(distinct request) from lab) as n_requests, round(n10.v, 6) as ndcg_10, round(n50.v, 6) as ndcg_50, round(n10.v - b10.v, 6) as gain from n10, n50, b10""")
def prerank_summaries(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.prerank_summary(labelled(spark, d), "price", "page_time")
    return out.select("median_positives", "n_requests", *(F.round(c, 6).alias(c) for c in ("ndcg_10", "ndcg_50", "gain")))


def _bundle(n: str, score: str, where: str, groups: str) -> str:
    s = f"""{n}s as (select request, item, max({score}) as s from imp where {where} and {groups} group by 1, 2), {n}f as (select coalesce(a.request, b.request) as request, coalesce(a.item, b.item) as item, s, coalesce(y, 0) as y, u from {n}s a full join (select * from lb where {groups}) b on a.request = b.request and a.item = b.item),
{n}m as (select request, item, y, coalesce(u, max(u) over (partition by request)) as u, coalesce(s, coalesce(min(s) over (partition by request), 0) - case when y > 0 then 2 else 1 end - (row_number() over (partition by request, s is null, y > 0 order by item) - 1) / 1000) as s from {n}f)"""
    g = GRADE.format(f"{n}m").replace("ed as", f"{n}ed as").replace("from ed", f"from {n}ed").replace("ei as", f"{n}ei as").replace(", ei)", f", {n}ei)").replace("gr as", f"{n}gr as")
    auc = f"""{n}c as (select s, sum((y > 0)::int) as p, sum((y <= 0)::int) as q from {n}m group by 1), {n}a as (select sum(p * (coalesce(b, 0) + q / 2)) / (sum(p) * sum(q)) as v from (select *, sum(q) over (order by s rows between unbounded preceding and 1 preceding) as b from {n}c)),
{n}u as (select u, s, sum((y > 0)::int) as p, sum((y <= 0)::int) as q from {n}m group by 1, 2), {n}g as (select sum(a * w) / sum(w) as v from (select u, sum(p * (coalesce(b, 0) + q / 2)) / (sum(p) * sum(q)) as a, sum(p + q) as w from (select *, sum(q) over (partition by u order by s rows between unbounded preceding and 1 preceding) as b from {n}u) group by 1 having sum(p) > 0 and sum(q) > 0))"""
    return f"{s}, {g}, {_ndcg(n + 'n', 's', 10, n + 'gr')}, {auc}"


SPLITS = {"train": "request % 3 <> 0", "test": "request % 3 = 0"}
STAGED = {"preranking": ("price", "position % 2 = 1"), "ranking": ("page_time", "position <= 3")}


@query(f"""with {IMP}, {REQ}, {LAB}, {LABELS}, {', '.join(_bundle(f'{a[0]}{b[1]}', score, where, groups) for a, (score, where) in STAGED.items() for b, groups in SPLITS.items())}
{' union all '.join(f"select '{a}' as stage, '{b}' as split, (select count(*) from {a[0]}{b[1]}m) as n_rows, (select count(distinct request) from {a[0]}{b[1]}m) as n_requests, round({a[0]}{b[1]}n.v, 6) as ndcg, round({a[0]}{b[1]}a.v, 6) as auc, round({a[0]}{b[1]}g.v, 6) as gauc from {a[0]}{b[1]}n, {a[0]}{b[1]}a, {a[0]}{b[1]}g" for a in STAGED for b in SPLITS)}""")
def layered_metrics(spark: SparkSession, d: str) -> DataFrame:
    """NDCG, AUC and GAUC of two stages on two splits, with labelled pairs that were not scored."""
    rows = impressions(spark, d)
    stages = {a: (rows.where(where).select("request", "item", F.col(score).alias("own")), ["deep", "own"]) for a, (score, where) in STAGED.items()}
    splits = {b: rows.where(groups).select("request").distinct() for b, groups in SPLITS.items()}
    out = evaluation.layered(stages, labels(spark, d), splits)
    return out.select("stage", "split", "n_rows", "n_requests", *(F.round(c, 6).alias(c) for c in ("ndcg", "auc", "gauc")))


@query(f"""with {IMP}, {LAB}, m as (select request, position as rank, row_number() over (partition by request order by page_time desc, item) as pre, y from lab), h as (select request, max((y > 0)::int) as h from m where rank between 3 and 7 and pre <= 3 and request % 2 = 0 group by 1)
select round(avg(coalesce(h, 0)), 6) as tail_hit, count(*) as n_requests from (select distinct request from imp) left join h using (request)""")
def tail_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    pre = rows.where("request % 2 = 0").select("request", "item", "y", F.row_number().over(recall.Window.partitionBy("request").orderBy(F.desc("page_time"), "item")).alias("preranking_rank"))
    return evaluation.tail_hits(rows.select("request", "item", F.col("position").alias("rank")), pre, rows, 3, 7, 3).withColumn("tail_hit", F.round("tail_hit", 6))


@query(f"""with {IMP}, a as (select *, row_number() over (partition by request order by price desc, item) as r from imp) select request, cast(sum(collect) as bigint) as exact_hits, round(avg("like" * 0.5), 6) as lexical_mean from a where r <= 3 group by 1""")
def query_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d).select("request", "item", F.col("price").alias("preranking_score"), F.col("collect").alias("exact"), (F.col("like") * 0.5).alias("lexical"))
    return evaluation.query_quality(rows, 3).withColumn("lexical_mean", F.round("lexical_mean", 6))


@query(f"""with {IMP}, a as (select request, item from imp where position <= 3), b as (select request, item from imp where position % 2 = 0 and request % 3 <> 0 qualify row_number() over (partition by request order by page_time desc, item) <= 3)
select request, count(b.item) as overlap from a left join b using (request, item) group by 1""")
def stage_overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d)
    order = recall.Window.partitionBy("request").orderBy(F.desc("page_time"), "item")
    other = rows.where("position % 2 = 0 and request % 3 <> 0").select("request", "item", F.row_number().over(order).alias("rank"))
    return evaluation.overlaps(rows.select("request", "item", F.col("position").alias("rank")), other, 3)


@query(f"""with {REQ}, g as (select s, row_number() over (order by md5('42|' || s), s) as r, count(*) over () as n from (select distinct request // 3 as s from req))
select request, s as session, r > least(greatest(1, floor(n * 0.8)), greatest(n - 1, 1)) as validation from req join g on s = request // 3""")
def session_split(spark: SparkSession, d: str) -> DataFrame:
    """Whole sessions of three requests on either side."""
    rows = requests(spark, d).select("request", F.floor(F.col("request") / 3).alias("session"))
    return training.session_split(rows, "session")


@query(f"""with {IMP}, {LAB}, a as (select request, list(item order by item) filter (click <= 0) as exposed, list(item order by item) filter (click > 0 or y > 0) as positive from lab group by 1) select * from a""")
def exposed_and_positive(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    every = rows.select("request").distinct()
    return every.join(training.exposed_negatives(rows).withColumnRenamed("items", "exposed"), "request", "left").join(training.positive_sets(rows).withColumnRenamed("items", "positive"), "request", "left")


EXTERNAL = """own as (select request, list(item order by position) filter (position <= 2) as l from imp group by 1), ex as (select request, case when request % 4 = 0 then [] else list(item order by position) filter (position = 3) end as l from imp where request % 3 = 0 group by 1)"""


@query(f"""with {IMP}, {EXTERNAL}, j as (select imp.request, imp.item, case when len(ex.l) > 0 then ex.l else coalesce(own.l, []) end as hard_negatives from imp left join own on own.request = imp.request and imp.request % 5 <> 0 left join ex on ex.request = imp.request)
select request, item, hard_negatives from j""")
def external_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Hard negatives mined elsewhere go before a request's own."""
    rows = impressions(spark, d)
    first = lambda where: rows.groupBy("request").agg(F.transform(F.sort_array(F.collect_list(F.when(where, F.struct("position", "item")))), lambda x: x["item"]).alias("hard_negatives"))
    own = first(F.col("position") <= 2).where("request % 5 <> 0")
    mined = first(F.col("position") == 3).where("request % 3 = 0").withColumn("hard_negatives", F.when(F.col("request") % 4 != 0, F.col("hard_negatives")).otherwise(F.array().cast("array<bigint>")))
    return training.with_external(rows.select("request", "item").join(own, "request", "left"), mined)


@query(f"""with {IMP}, t as (select request, item from imp where position = 2), p as (select request, item from imp where click > 0 union select * from t),
r as (select request, item, position as rank from imp qualify row_number() over (partition by request order by position, item) <= 8), k as (select r.* from r left join p using (request, item) where p.item is null),
l as (select request, list(item order by rank) as l from (select * from k qualify row_number() over (partition by request order by rank, item) <= 2) group by 1)
select round(avg(case when len(l) > 0 then 1.0 else 0 end), 6) as coverage, round(avg(coalesce(len(l), 0)), 6) as mean_length, count(*) as n_rows, case when max(len(l)) > 0 then 'hard' else 'easy' end as mode from (select distinct request from imp) left join l using (request)""")
def mined_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Hard negatives without positives and results of a teacher: how many requests have some, and the mode of negatives that follows."""
    rows = impressions(spark, d)
    mined = recall.hard_negatives(rows.select("request", "item", F.col("position").alias("rank")), rows.where("click > 0"), 2, teacher=rows.where("position = 2"))
    every = rows.select("request").distinct().join(mined.withColumnRenamed("items", "hard_negatives"), "request", "left")
    mode, _ = training.negative_mode(every, "auto")
    stats = training.list_coverage(every, "hard_negatives")
    return stats.select(F.round("coverage", 6).alias("coverage"), F.round("mean_length", 6).alias("mean_length"), "n_rows", F.lit(mode).alias("mode"))


@query(f"""with {IMP}, m as (select item, "like", collect, row_number() over (partition by item order by request, position) as r from imp where item % 7 <> 0)
select p_partkey as item, coalesce("like", 0) as "like", coalesce(nullif(collect, 0), 0) as collect from part left join m on m.item = p_partkey and r = 1""")
def item_meta(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each item, and zeros for items that have none."""
    rows = impressions(spark, d).where("item % 7 <> 0").select("item", "like", F.when(F.col("collect") != 0, F.col("collect")).alias("collect"), F.struct("request", "position").alias("place"))
    return training.item_meta(rows, ["like", "collect"], table(spark, d, "part").select(F.col("p_partkey").alias("item")))


@query(f"""with {IMP}, c as (select distinct request, item % 50 as item, position from imp where position <= 5), k as (select request, item, min(position) as rank from c group by 1, 2),
f as (select request, item, price from imp where (request, item) in (select (request, item) from k)), g as (select request, count(*) as n from imp group by 1)
select 'candidates' as what, count(*) as n, cast(sum(rank) as double) as total from k union all select 'features', count(*), round(sum(price), 2) from f union all select 'groups', count(*), cast(sum(n * n) as double) from g""")
def scoring_frames(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without repeats, features of them alone, and sizes of groups, as counts and sums."""
    rows = impressions(spark, d)
    kept = training.candidate_frame(rows.select("request", (F.col("item") % 50).alias("item"), F.col("position").alias("rank")), 5)
    own = training.restricted(rows.select("request", "item", "price"), kept)
    total = lambda df, what, value: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"), F.round(F.sum(value).cast("double"), 2).alias("total"))
    return total(kept, "candidates", F.col("rank")).unionByName(total(own, "features", F.col("price"))).unionByName(total(training.group_sizes(rows), "groups", F.col("n") * F.col("n")))


@query()
def drawn_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Three negatives of each request: one hard where there is any, the others by popularity. Draws are inverted sums of weights over hashes; tests hold them against
    a walk through the sums."""
    rows = impressions(spark, d)
    mined = recall.hard_negatives(rows.select("request", "item", F.col("position").alias("rank")), rows.where("click > 0"), 10)
    every = rows.select(F.col("request").alias("id")).distinct().join(mined.select(F.col("request").alias("id"), F.col("items").alias("hard_negatives")), "id", "left")
    shown = rows.groupBy("item").agg(F.count("*").alias("imp"))
    return training.negatives_drawn(every, recall.sampling(shown, universe=table(spark, d, "part").select(F.col("p_partkey").alias("item"))).withColumnRenamed("p", "w"))


@query(f"""with {IMP}, i as (select item, count(*) as imp from imp where item % 5 <> 0 group by 1), u as (select p_partkey as item, coalesce(imp, 0) as imp from part left join i on item = p_partkey), w as (select item, greatest(pow(imp + 1, 0.75), 1e-8) as w from u)
select item, round(w / sum(w) over (), 9) as p from w""")
def extended_sampling(spark: SparkSession, d: str) -> DataFrame:
    shown = impressions(spark, d).where("item % 5 <> 0").groupBy("item").agg(F.count("*").alias("imp"))
    return recall.sampling(shown, universe=table(spark, d, "part").select(F.col("p_partkey").alias("item"))).withColumn("p", F.round("p", 9))


@query(f"""with {IMP}, {LAB}, n as (select request, item, y, case when max(price) over w = min(price) over w then 0.0 else (price - min(price) over w) / (max(price) over w - min(price) over w + 1e-6) end as a,
 case when max(page_time) over w = min(page_time) over w then 0.0 else (page_time - min(page_time) over w) / (max(page_time) over w - min(page_time) over w + 1e-6) end as b from lab where request % 3 = 0 window w as (partition by request))
select request, item, round(0.65 * a + 0.35 * b, 6) as dien_score, row_number() over (partition by request order by round(0.65 * a + 0.35 * b, 9) desc, item) as ranking_rank from n""")
def deep_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the validation requests: both models scaled within a request and blended by a weight."""
    rows = labelled(spark, d).where("request % 3 = 0")
    blend = 0.65 * min_max("request", "price", 0.0, 1e-6) + 0.35 * min_max("request", "page_time", 0.0, 1e-6)
    scored = rows.withColumn("s", blend)
    place = F.row_number().over(recall.Window.partitionBy("request").orderBy(F.desc(F.round("s", 9)), "item"))
    return scored.select("request", "item", F.round("s", 6).alias("dien_score"), place.alias("ranking_rank"))
