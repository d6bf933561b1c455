"""Recall, fusion, ranking, vector and metric queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assembly, metrics, recall, vectors
from ..operators.relational import min_max, pessimistic, top_k
from ..sources.roles import IMP, REQ, impressions, requests, table
from ..sources.stored import dropped, shuffles_deleted, written
from .features import LAB, labelled, query

EDGE = f"""{IMP}, {REQ}, {LAB}, e0 as (select user_id as u, item as i, max(y) as s from lab join req using (request) group by all having max(y) > 0),
e1 as (select * from (select *, row_number() over (partition by u order by s desc, i) as r from e0) where r <= 300),
e as (select u, i, s from (select *, row_number() over (partition by i order by s desc, u) as q from e1) where q <= 500),
e3 as (select u, i, s from (select *, row_number() over (partition by i order by s desc, u) as q from e1) where q <= 300)"""
HIST = f"""his as (select * from (select user_id as u, item as i, row_number() over (partition by user_id order by ts desc, request desc, item) - 1 as rec
  from imp join req using (request) where click > 0) where rec < 20)"""


def graph(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).join(requests(spark, d), "request").select("user", "item", F.col("y").alias("label"))
    return recall.edges(rows)


@query(f"""with {EDGE}, n as (select u, count(*) as n from e1 group by 1),
p as (select a.u as u, b.u as v, a.i as i from e3 a join e3 b on a.i = b.i and a.u < b.u),
c as (select u, v from p group by 1, 2 having count(*) > 1),
o as (select c.u, c.v, 1 / sqrt(x.n) / sqrt(y.n) / (1.0 + (select count(*) from e1 f join e1 g on f.i = g.i where f.u = c.u and g.u = c.v)) as w from c join n x on x.u = c.u join n y on y.u = c.v),
s as (select p.i as src, q.i as dst, sum(o.w) as score from p join p q on p.u = q.u and p.v = q.v and p.i <> q.i join o on o.u = p.u and o.v = p.v group by 1, 2),
m as (select a.i as src, b.i as dst, count(*) as c from e3 a join e1 b on a.u = b.u and a.i <> b.i group by 1, 2 having count(*) >= 2 qualify row_number() over (partition by a.i order by count(*) desc, b.i) <= 600)
select src, dst, round(score, 6) as score from (select *, row_number() over (partition by src order by round(score, 9) desc, dst) as r from s join m using (src, dst)) where r <= 120""")
def swing_index(spark: SparkSession, d: str) -> DataFrame:
    return recall.swing(graph(spark, d)).select("src", "dst", F.round("score", 6).alias("score"))


USERCF = f"""{EDGE}, n as (select i, 1 / ln(1 + count(*)) as idf from e group by 1), x as (select u, i, s, idf from e join n using (i)),
m as (select u, sqrt(sum(s * s * idf)) as norm from x group by 1),
t as (select a.u as u, b.u as v, sum(a.s * b.s * a.idf) as dot from x a join x b on a.i = b.i and a.u <> b.u group by 1, 2),
z as (select t.u, t.v, dot / (m.norm * k.norm) as score from t join m on m.u = t.u join m k on k.u = t.v),
uu as (select u, v, score from (select *, row_number() over (partition by u order by round(score, 9) desc, v) as r from z) where r <= 120)"""


@query(f'with {USERCF} select u as "user", v as other, round(score, 6) as score from uu')
def usercf_index(spark: SparkSession, d: str) -> DataFrame:
    return recall.usercf(recall.trimmed(graph(spark, d), 300, 500), 120).select("user", "other", F.round("score", 6).alias("score"))


@query(f"""with {USERCF}, f as (select uu.u, e.i, sum(uu.score * e.s) as score from uu join e on e.u = uu.v group by 1, 2)
select u as "user", i as item, round(score, 6) as score from (select *, row_number() over (partition by u order by round(score, 9) desc, i) as r from f) where r <= 320""")
def usercf_recall(spark: SparkSession, d: str) -> DataFrame:
    with shuffles_deleted(spark):
        edges = written(graph(spark, d), "edges")
        g = written(recall.trimmed(edges, 300, 500), "trimmed")
        dropped(edges)
        found = recall.usercf_recall(g, 120, 320, 6)
    dropped(g)
    return found


def history(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d).where("click > 0").join(requests(spark, d), "request")
    return rows.select("user", "item", recall.recency([F.desc("ts"), F.desc("request"), F.col("item")]).alias("recency")).where("recency < 20")


#: What a user clicked in earlier requests, the newest twenty for each request, 0 the newest.
BEFORE = """ck as (select user_id as u, request, item, row_number() over (partition by user_id order by ts, request, item) as n from imp join req using (request) where click > 0),
rq as (select user_id as u, request, coalesce((select count(*) from ck join req r2 on r2.request = ck.request where ck.u = req.user_id and (r2.ts, r2.request) < (req.ts, req.request)), 0) as had from req),
bef as (select rq.u, rq.request, ck.item, had - n as rec from rq join ck on ck.u = rq.u and ck.n <= had and ck.n > had - 20)"""


def clicks_before(spark: SparkSession, d: str, most: int = 20) -> DataFrame:
    """user, request, item and recency of what the user clicked before each request, and block, one for each 64 requests in a row of a user. Clicks are counted in order
    of time, so a request knows which numbers it wants, and a join by user and number finds them."""
    req = requests(spark, d)
    clicked = impressions(spark, d).where("click > 0").join(req, "request").select("user", "ts", "request", "item")
    each = req.join(clicked.groupBy("request").agg(F.count("*").alias("_c")), "request", "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    order = Window.partitionBy("user").orderBy("ts", "request")
    had = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    block = F.floor((F.row_number().over(order) - 1) / 64)
    wanted = each.select("user", "request", had.alias("had"), block.alias("block")).where("had > 0")
    wanted = wanted.withColumn("n", F.explode(F.sequence(F.greatest(F.col("had") - most + 1, F.lit(1)), F.col("had"))))
    numbered = clicked.select("user", "item", F.row_number().over(Window.partitionBy("user").orderBy("ts", "request", "item")).cast("long").alias("n"))
    return wanted.join(numbered, ["user", "n"]).select("user", "request", "item", (F.col("had") - F.col("n")).alias("recency"), "block")


@query(f"""with {IMP}, {REQ}, {LAB}, {BEFORE}, t as (select bef.item as src, lab.item as dst, sum((1 + least(2.5, 0.22 * y)) * case when rec < 3 then 1.18 else 1 end / (1 + 0.32 * rec)) as score
  from bef join lab using (request) where y > 0 and bef.item <> lab.item group by 1, 2)
select src, dst, round(score, 6) as score from (select *, row_number() over (partition by src order by round(score, 9) desc, dst) as r from t) where r <= 200""")
def sequence_transitions(spark: SparkSession, d: str) -> DataFrame:
    steps = clicks_before(spark, d).join(labelled(spark, d).select("request", F.col("item").alias("dst"), "y"), "request").withColumnRenamed("item", "src")
    return recall.sequence_transitions(steps).select("src", "dst", F.round("score", 6).alias("score"))


@query(f"""with {IMP}, {REQ}, {LAB}, {BEFORE}, t as (select bef.item as src, lab.item as dst, sum((1 + least(2.5, 0.22 * y)) * case when rec < 3 then 1.18 else 1 end / (1 + 0.32 * rec)) as score
  from bef join lab using (request) where y > 0 and bef.item <> lab.item group by 1, 2),
i as (select src, dst, score from t qualify row_number() over (partition by src order by round(score, 9) desc, dst) <= 200),
f as (select request, dst, sum(score / (1 + rec)) as s from bef join i on src = bef.item group by 1, 2)
select request, dst as item, round(s, 6) as score from f qualify row_number() over (partition by request order by round(s, 9) desc, dst) <= 30""")
def transition_recall(spark: SparkSession, d: str) -> DataFrame:
    """Items that follow what was clicked before, over an index of transitions; items of the history are not left out."""
    with shuffles_deleted(spark):
        before = written(clicks_before(spark, d), "before")
        steps = before.join(labelled(spark, d).select("request", F.col("item").alias("dst"), "y"), "request").withColumnRenamed("item", "src")
        found = recall.block_recall(before, recall.sequence_transitions(steps), 30)
    dropped(before)
    return found.select("request", F.col("found").alias("item"), F.round("score", 6).alias("score"))


@query(f"""with {IMP}, i as (select item, 1.0 * sum("like") + 1.2 * sum(collect) + 0.8 * sum(comment) + 0.2 * count(*) as score from imp group by 1)
select item, round(score, 6) as score from i order by round(score, 9) desc, item limit 200""")
def hot_recall(spark: SparkSession, d: str) -> DataFrame:
    items = impressions(spark, d).groupBy("item").agg(F.sum("like").alias("like"), F.sum("collect").alias("collect"), F.sum("comment").alias("comment"), F.count("*").alias("imp"))
    return recall.hot_items(items, 200).select("item", F.round("score", 6).alias("score"))


ROUTES = f"""{IMP}, rt as (select request, item, 'ann' as route, price as score from imp where position % 3 <> 0 union all
  select request, item, 'swing', page_time from imp where position % 2 = 1)"""


def routes(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d)
    a = rows.where("position % 3 <> 0").select("request", "item", F.lit("ann").alias("route"), F.col("price").alias("score"))
    return a.unionByName(rows.where("position % 2 = 1").select("request", "item", F.lit("swing").alias("route"), F.col("page_time").alias("score")))


@query(f"""with {ROUTES}, n as (select *, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as norm
  from rt window w as (partition by request, route)),
b as (select request, item, sum(case when route = 'ann' then 1.0 else 0.82 end * norm) + case when count(*) > 1 then 0.16 else 0 end as score from n group by 1, 2)
select request, item, round(score, 6) as score, r as rank from (select *, row_number() over (partition by request order by round(score, 9) desc, item) as r from b where score > 0) where r <= 10""")
def route_blend(spark: SparkSession, d: str) -> DataFrame:
    n = recall.normed(routes(spark, d)).select("request", "item", "route", F.col("norm").alias("score"))
    out = recall.blended(n.where("route = 'ann'"), n.where("route = 'swing'"), 1.0, 0.82, 0.16, 10)
    return out.select("request", "item", F.round("score", 6).alias("score"), "rank")


@query(f"""with {ROUTES}, k as (select *, row_number() over (partition by request, route order by score desc, item) as r from rt)
select request, item, round(0.7 / (60 + coalesce(min(case when route = 'ann' then r end), 10000)) + 0.3 / (60 + coalesce(min(case when route = 'swing' then r end), 10000)), 9) as score from k group by 1, 2""")
def route_rrf(spark: SparkSession, d: str) -> DataFrame:
    ranked = routes(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("request", "route").orderBy(F.desc("score"), "item")))
    return recall.reciprocal_ranks(ranked, {"ann": 0.7, "swing": 0.3}).withColumn("score", F.round("score", 9))


@query(f"""with {IMP}, r as (select request, item, row_number() over (partition by request order by position) as q from imp where click = 0)
select request, list(item order by q) as items from r where q <= 24 group by 1""")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d)
    return recall.hard_negatives(rows.select("request", "item", F.col("position").alias("rank")), rows.where("click > 0"), 24)


NDCG = f"""{IMP}, {LAB}, g as (select *, count(*) over (partition by request) as n, max(y) over (partition by request) as m from lab),
o as (select *, row_number() over (partition by request order by price desc, item) as a, row_number() over (partition by request order by y desc, item) as b from g where n > 1 and m > 0),
nd as (select request, sum(case when a <= 10 then (pow(2, y) - 1) / log2(a + 1) else 0 end) / (sum(case when b <= 10 then (pow(2, y) - 1) / log2(b + 1) else 0 end) + 1e-9) as ndcg from o group by 1)"""


@query(f"with {NDCG} select request, round(ndcg, 6) as ndcg from nd")
def ndcg_by_request(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ndcg(labelled(spark, d), "request", "price", "y", 10).select("request", F.round("ndcg", 6).alias("ndcg"))




@query(f"""with {IMP}, {REQ}, x as (select user_id as u, click, page_time from imp join req using (request)), s as (select u, page_time as v, sum(click) as p, sum(1 - click) as n from x group by all),
w as (select u, p, n, p * (coalesce(sum(n) over (partition by u order by v rows between unbounded preceding and 1 preceding), 0) + n / 2) as w from s),
a as (select u, sum(p) as p, sum(n) as n, sum(w) as w from w group by 1)
select u as "user", cast(p + n as bigint) as n_rows, cast(p as bigint) as n_positive, round(case when p > 0 and n > 0 then w / (p * n) else 0.5 end, 6) as auc from a""")
def auc_by_user(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d).join(requests(spark, d), "request")
    return metrics.auc(rows, "page_time", "click", "user").withColumn("auc", F.round("auc", 6))


@query(f"""with {IMP}, {REQ}, x as (select user_id as u, click, page_time from imp join req using (request)), s as (select u, page_time as v, sum(click) as p, sum(1 - click) as n from x group by all),
w as (select u, p, n, p * (coalesce(sum(n) over (partition by u order by v rows between unbounded preceding and 1 preceding), 0) + n / 2) as w from s),
a as (select u, sum(p) as p, sum(n) as n, sum(w) as w from w group by 1 having sum(p) > 0 and sum(n) > 0)
select round(sum(w / (p * n) * (p + n)) / sum(p + n), 6) as gauc, count(*) as n_users from a""")
def gauc_weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d).join(requests(spark, d), "request")
    return metrics.gauc(rows, "user", "page_time", "click").select(F.round("gauc", 6).alias("gauc"), "n_users")


@query(f"""with {IMP}, o as (select request, click as y, row_number() over (partition by request order by page_time desc, item) as a from imp),
c as (select *, sum(y) over (partition by request order by a rows unbounded preceding) as s from o),
g as (select request, sum(y) as p, sum(case when a <= 3 then y else 0 end) as h, min(case when y = 1 and a <= 3 then a end) as f, sum(case when a <= 3 and y = 1 then s / a else 0 end) as q from c group by 1 having sum(y) > 0)
select request, round(h / p, 6) as recall, round(h / 3, 6) as precision, case when h > 0 then 1 else 0 end as hit, round(coalesce(1 / f, 0), 6) as mrr, round(case when h > 0 then q / h end, 6) as ap from g""")
def hits_at_3(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.hits(impressions(spark, d), "request", "page_time", "click", 3)
    return r.select("request", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "hit", F.round("reciprocal", 6).alias("mrr"), F.round("average_precision", 6).alias("ap"))


PRE = f"""pr as (select request, item, position, click, "like", 0.5 * l + 0.5 * x as gbdt, greatest(coalesce(case when position % 3 <> 0 then price / 99991 end, 0), coalesce(case when position % 2 = 1 then page_time / 50 end, 0)) as dssm,
  collect * 0.06 + share * 0.14 as boost from (select *, case when max(price) over w = min(price) over w then 0.0 else (price - min(price) over w) / (max(price) over w - min(price) over w + 1e-6) end as l,
 case when max(page_time) over w = min(page_time) over w then 0.0 else (page_time - min(page_time) over w) / (max(page_time) over w - min(page_time) over w + 1e-6) end as x from imp window w as (partition by request)))"""


def prerank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Impressions as candidates: scores of two boosted models, a vector score that some lack, and a linkage boost."""
    rows = impressions(spark, d).withColumns({"lgb": min_max("request", "price", 0.0, 1e-6), "xgb": min_max("request", "page_time", 0.0, 1e-6)})
    scored = rows.withColumns({
        "gbdt_score": assembly.ensemble(["lgb", "xgb"]), "score_ann": F.when(F.col("position") % 3 != 0, F.col("price") / 99991),
        "recall_score": F.when(F.col("position") % 2 == 1, F.col("page_time") / 50), "linkage_boost": F.col("collect") * 0.06 + F.col("share") * 0.14,
    })
    return scored.withColumns({"dssm_score": assembly.vector_score(), "rank": F.col("position")})


@query(f"""with {IMP}, {PRE} select request, item, round(0.8 * gbdt + 0.2 * dssm + 0.18 * boost, 6) as prerank_score, row_number() over (partition by request order by round(0.8 * gbdt + 0.2 * dssm + 0.18 * boost, 9) desc, position, item) as prerank from pr qualify prerank <= 4""")
def prerank(spark: SparkSession, d: str) -> DataFrame:
    first = assembly.preranked(prerank_candidates(spark, d), 4, linkage="linkage_boost")
    return first.select("request", "item", F.round("preranking_score", 6).alias("prerank_score"), F.col("preranking_rank").alias("prerank"))


@query(f"""with {IMP}, x as (select request, item, click, case when position % 2 = 1 then price end as s from imp),
r as (select *, row_number() over (partition by request, s is null, click > 0 order by item) - 1 as i, min(s) over (partition by request) as f from x)
select request, item, round(coalesce(s, coalesce(f, 0) - case when click > 0 then 2.0 else 1.0 end - i / 1000), 6) as score from r""")
def missing_score_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d).withColumn("s", F.when(F.col("position") % 2 == 1, F.col("price")))
    return rows.select("request", "item", F.round(pessimistic(rows, "request", "s", "click"), 6).alias("score"))


@query("""with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id, list_dot_product(cast(q as double[]), cast(embedding as double[])) as score from q, embeddings where vec_id <> query_id)
select query_id, vec_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as r from s) where r <= 10""")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, searched in blocks."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return vectors.blocked_top_k(v.where("vec_id % 50 = 0").toDF("query_id", "q"), v, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("""with x as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as "at" from embeddings) select label, "at", round(avg(x), 6) + 0.0 as value from x group by 1, 2""")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mean_vector(table(spark, d, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 6) + 0.0)
