"""Vector recall, fused routes and the drivers that merge them, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import history as hist
from ..operators import recall, routes, vectors
from ..operators.relational import top_k
from ..sources.roles import IMP, REQ, impressions, requests, table
from ..sources.stored import dropped, shuffles_deleted, written
from .features import LAB, labelled, query
from .merging import SAID, SHAPED, said
from .ranking import BEFORE, clicks_before, graph
from .search import seeds

#: So many lists, about, are sent to the blocks of a share of the histories.
LISTS_A_SHARE = 500_000
#: Few requests' worth of vectors: every fiftieth request asks, over all vectors.
EMB = "em as (select vec_id, cast(embedding as double[]) as v from embeddings), nv as (select count(*) as nv from em)"
#: The history of a request as vectors, newest 0.
HV = f"""{BEFORE}, hv as (select request, item % nv as vec_id, min(rec) as rec from bef, nv where request % 50 = 0 group by 1, 2)"""
SCALE = "sqrt(list_dot_product({0}, {0}))"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def history_vectors(spark: SparkSession, d: str) -> DataFrame:
    """request, vec_id and recency of what was clicked before each fiftieth request."""
    n = embeddings(spark, d).agg(F.count("*").alias("n"))
    rows = clicks_before(spark, d).where("request % 50 = 0").crossJoin(F.broadcast(n))
    return rows.groupBy("request", (F.col("item") % F.col("n")).alias("vec_id")).agg(F.min("recency").alias("recency"))


def neighbours(spark: SparkSession, d: str, asked: DataFrame, k: int) -> DataFrame:
    """src, dst and score of the k nearest of the vectors asked for (vec_id)."""
    v = embeddings(spark, d)
    q = v.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").toDF("query_id", "q")
    return vectors.blocked_top_k(q, v, k).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "score")


def asking(spark: SparkSession, d: str, queries: DataFrame, k: int) -> DataFrame:
    """request, item and score of the k nearest vectors of each request's vector q. Requests get ids that no vector has, so none is left out as its own."""
    found = vectors.blocked_top_k(queries.select((-1 - F.col("request")).alias("query_id"), "q"), embeddings(spark, d), k)
    return found.select((-1 - F.col("query_id")).alias("request"), F.col("vec_id").alias("item"), "score")


@query(f"""with {IMP}, {REQ}, {LAB}, {BEFORE}, e0 as (select user_id as u, item as i, max(y) as s from lab join req using (request) group by all having max(y) > 0),
pr as (select u, list(i order by s desc, i)[1:20] as l from e0 group by 1), hh as (select request, list(item order by rec desc) as l from bef where request % 3 = 0 group by 1)
select request, user_id as "user", coalesce(hh.l, pr.l, []) as items from req left join hh using (request) left join pr on pr.u = user_id""")
def resolved_histories(spark: SparkSession, d: str) -> DataFrame:
    """A third of the requests have a history of their own; the others get what their user prefers."""
    own = clicks_before(spark, d).where("request % 3 = 0").groupBy("request").agg(F.sort_array(F.collect_list(F.struct("recency", "item")), asc=False).alias("s"))
    rows = requests(spark, d).join(own.select("request", F.col("s.item").alias("history")), "request", "left")
    return hist.resolved(rows, graph(spark, d))


@query(f"""with {EMB} select vec_id, list_transform(v, lambda x: round(x / greatest({SCALE.format('v')}, 1e-12), 6) + 0.0) as unit from em""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).select("vec_id", F.transform(vectors.unit(F.col("v")), lambda x: F.round(x, 6) + 0.0).alias("unit"))


MEAN = f"""mn as (select request, list(x order by p) as h, max(n) as n from (select request, p, avg(x) as x, count(*) as n from (select request, unnest(v) as x, generate_subscripts(v, 1) as p from hv join em using (vec_id)) group by 1, 2) group by 1),
rv as (select request, v as q from req, nv, em where request % 50 = 0 and request % 100 = 0 and vec_id = request % nv),
bl as (select coalesce(rv.request, mn.request) as request, rv.q, mn.h, n, case when n >= 8 then 0.96 when n >= 4 then 0.88 when n >= 2 then 0.76 else 0.62 end as w from rv full join mn on mn.request = rv.request),
bs as (select request, list_transform(range(1, 65), lambda i: case when q is null then h[i] / {SCALE.format('h')} when h is null then q[i] / {SCALE.format('q')} else (1 - w) * q[i] / {SCALE.format('q')} + w * h[i] / {SCALE.format('h')} end) as b from bl),
bq as (select request, list_transform(b, lambda x: x / greatest({SCALE.format('b')}, 1e-12)) as q from bs)"""


def blended_queries(spark: SparkSession, d: str) -> DataFrame:
    """request and q: vectors of some requests blended with the mean of the history, or the one that is there."""
    e = embeddings(spark, d)
    n = e.agg(F.count("*").alias("n"))
    rows = requests(spark, d).where("request % 100 = 0").crossJoin(F.broadcast(n)).select("request", (F.col("request") % F.col("n")).alias("vec_id"))
    return hist.blended_vectors(rows.join(e, "vec_id").select("request", "v"), hist.means(history_vectors(spark, d), e), "rec")


@query(f"""with {IMP}, {REQ}, {EMB}, {HV}, {MEAN} select request, vec_id as item, round(list_dot_product(q, v), 6) as score from bq, em qualify row_number() over (partition by request order by round(list_dot_product(q, v), 9) desc, vec_id) <= 10""")
def blended_recall(spark: SparkSession, d: str) -> DataFrame:
    return asking(spark, d, blended_queries(spark, d), 10).withColumn("score", F.round("score", 6))


NEAR = """nb as (select a.vec_id as src, b.vec_id as dst, list_dot_product(a.v, b.v) as s from em a, em b where a.vec_id <> b.vec_id and a.vec_id in (select vec_id from hv) qualify row_number() over (partition by a.vec_id order by round(list_dot_product(a.v, b.v), 9) desc, b.vec_id) <= 20),
near1 as (select request, dst as item, sum(s / (1 + rec)) as s from hv join nb on src = hv.vec_id where (request, dst) not in (select (request, vec_id) from hv) group by 1, 2),
near2 as (select request, dst as item, sum(s / (1 + 0.35 * rec)) + 0.035 * (count(*) - 1) as s from hv join nb on src = hv.vec_id where (request, dst) not in (select (request, vec_id) from hv) group by 1, 2)"""


@query(f"""with {IMP}, {REQ}, {EMB}, {HV}, {NEAR} select request, item, round(s, 6) as score from near1 qualify row_number() over (partition by request order by round(s, 9) desc, item) <= 12""")
def item_history_recall(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of each item of the history, less for older ones; not the history itself."""
    h = history_vectors(spark, d)
    return hist.near_items(h.withColumnRenamed("vec_id", "item"), neighbours(spark, d, h, 20), 12).select("request", "item", F.round("score", 6).alias("score"))


SEEDED = """sd as (select request, vec_id as item, (10 - rec) / 7.0 as s from hv), ws as (select *, case when sum(greatest(s, 0)) over (partition by request) <= 1e-12 then 1.0 else greatest(s, 0) end as w
  from (select * from sd qualify row_number() over (partition by request order by round(s, 9) desc, item) <= 8)),
ce as (select request, list(x order by p) as c from (select request, p, sum(w * x) / sum(w) as x from (select request, w, unnest(v) as x, generate_subscripts(v, 1) as p from ws join em on vec_id = item) group by 1, 2) group by 1),
cq as (select request, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-12)) as q from ce),
cr as (select request, vec_id as item, list_dot_product(q, v) as s from cq, em qualify row_number() over (partition by request order by round(list_dot_product(q, v), 9) desc, vec_id) <= 20)"""


@query(f"""with {IMP}, {REQ}, {EMB}, {HV}, {SEEDED} select request, item, round(s, 6) as score from cr where (request, item) not in (select (request, item) from ws)""")
def seed_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the weighted mean of seeds, some of which weigh nothing; not the seeds."""
    seeded = history_vectors(spark, d).select("request", F.col("vec_id").alias("item"), ((10 - F.col("recency")) / 7.0).alias("score"))
    centroids = hist.seed_centroids(seeded, embeddings(spark, d).withColumnRenamed("vec_id", "item"), 8)
    first = top_k(seeded, "request", [F.desc(F.round("score", 9)), F.col("item")], 8, "_r").select("request", "item")
    return asking(spark, d, centroids, 20).join(first, ["request", "item"], "left_anti").withColumn("score", F.round("score", 6))


@query(f"""with {IMP}, {REQ}, {EMB}, {HV}, {NEAR}, {MEAN}, mq as (select request, list_transform(h, lambda x: x / greatest({SCALE.format('h')}, 1e-12)) as q from mn),
mr as (select request, vec_id as item, list_dot_product(q, v) as s from mq, em qualify row_number() over (partition by request order by round(list_dot_product(q, v), 9) desc, vec_id) <= 30),
ni as (select * from near2 qualify row_number() over (partition by request order by round(s, 9) desc, item) <= 30),
u as (select request, item, sum(s) as s from (select * from ni union all select request, item, 0.62 * s from mr) group by 1, 2)
select request, item, round(s, 6) as score, row_number() over (partition by request order by round(s, 9) desc, item) as rank from u qualify rank <= 15""")
def history_route(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the history's items, more for those met often, and of its mean."""
    h, e = history_vectors(spark, d), embeddings(spark, d)
    by_item = hist.near_items(h.withColumnRenamed("vec_id", "item"), neighbours(spark, d, h, 20), 30, 0.35, 0.035)
    by_mean = asking(spark, d, hist.means(h, e).select("request", vectors.unit(F.col("v")).alias("q")), 30)
    return hist.two_sources(by_item, by_mean, 15).select("request", "item", F.round("score", 6).alias("score"), "rank")


TWO = """ma as (select request, item, price / 1000 as s from imp where position % 3 <> 0), qa as (select request, item, page_time as s from imp where position % 2 = 1),
a as (select *, row_number() over (partition by request order by round(s, 9) desc, item) as r from ma), b as (select *, row_number() over (partition by request order by round(s, 9) desc, item) as r from qa where request in (select request from ma)),
du as (select coalesce(a.request, b.request) as request, coalesce(a.item, b.item) as item, 0.7 / (60 + coalesce(a.r, 10000)) + 0.3 / (60 + coalesce(b.r, 10000)) as s, greatest(coalesce(a.s, 0), coalesce(b.s, 0)) as ann
  from a full join b on a.request = b.request and a.item = b.item)"""


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = impressions(spark, d)
    return rows.where("position % 3 <> 0").select("request", "item", (F.col("price") / 1000).alias("score")), rows.where("position % 2 = 1").select("request", "item", F.col("page_time").alias("score"))


@query(f"""with {IMP}, {TWO} select request, item, round(s, 9) as score, round(ann, 6) as ann, row_number() over (partition by request order by round(s, 12) desc, item) as rank from du qualify rank <= 8""")
def dual_ranking(spark: SparkSession, d: str) -> DataFrame:
    main, other = _two(spark, d)
    return hist.two_rankings(main, other, 8).select("request", "item", F.round("score", 9).alias("score"), F.round("ann", 6).alias("ann"), "rank")


@query(f"""with {IMP}, {TWO}, f as (select *, row_number() over (partition by request order by round(s, 9) desc, item) as r from du), t as (select f.*, row_number() over (partition by f.request order by round(case when position % 5 <> 0 then collect + share * 0.5 else 0 end, 9) desc, r) as tr from f join imp using (request, item))
select request, item, round(ann, 6) as ann, round(0.75 / (60 + r) + 0.25 / (60 + tr), 9) as score, row_number() over (partition by request order by round(0.75 / (60 + r) + 0.25 / (60 + tr), 12) desc, r) as rank from t qualify rank <= 6""")
def text_reranking(spark: SparkSession, d: str) -> DataFrame:
    """Live vector recall: two rankings fused, then re-ranked by scores of texts, which some items lack."""
    main, other = _two(spark, d)
    fused = hist.two_rankings(main, other, 1 << 30)
    said_of = impressions(spark, d).where("position % 5 <> 0").select("request", "item", (F.col("collect") + F.col("share") * 0.5).alias("score"))
    out = hist.text_reranked(fused.select("request", "item", "score", "ann"), said_of, 6).drop("ann").join(fused.select("request", "item", "ann"), ["request", "item"])
    return out.select("request", "item", F.round("ann", 6).alias("ann"), F.round("score", 9).alias("score"), "rank")


@query(f"""with {IMP}, {REQ}, {EMB}, {HV}, {MEAN}, c as (select hv.request, vec_id as item, case when {SCALE.format('q')} * {SCALE.format('v')} <= 1e-12 then 0 else list_dot_product(q, v) / ({SCALE.format('q')} * {SCALE.format('v')}) end as s from hv join em using (vec_id) join bq on bq.request = hv.request)
select request, item, round(s, 6) as score from c where s > 0 qualify row_number() over (partition by request order by round(s, 9) desc, item) <= 5""")
def candidate_cosines(spark: SparkSession, d: str) -> DataFrame:
    pairs = history_vectors(spark, d).select("request", F.col("vec_id").alias("item"))
    found = hist.positive_cosines(blended_queries(spark, d), pairs, embeddings(spark, d).withColumnRenamed("vec_id", "item"), 5)
    return found.select("request", "item", F.round("score", 6).alias("score"))


@query("""with s as (select vec_id as request, case when vec_id % 40 = 7 then list_concat(embedding[1:63], ['nan'::float]) else embedding end as v from embeddings)
select request, list_transform(v, lambda x: round(cast(x as double), 6) + 0.0) as v from s where request % 40 <> 7""")
def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Stored request vectors, of which few are not finite."""
    e = table(spark, d, "embeddings")
    broken = F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))
    stored = e.select(F.col("vec_id").alias("request"), F.when(F.col("vec_id") % 40 == 7, broken).otherwise(F.col("embedding")).alias("v"))
    return hist.usable_vectors(stored, embeddings(spark, d)).select("request", F.transform("v", lambda x: F.round(x.cast("double"), 6) + 0.0).alias("v"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: round(cast(x as double), 6) + 0.0) as v from embeddings)
select k.p_partkey as key, coalesce(a.v, b.v, list_transform(range(64), lambda x: 0.0::double)) as v from part k left join e a on a.vec_id = p_partkey and p_partkey % 3 <> 0 left join e b on b.vec_id + 100 = p_partkey and p_partkey % 2 = 0""")
def vector_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """A stored vector, else an encoded one, else zeros. Stored vectors without a length count as missing."""
    e = embeddings(spark, d)
    stored = e.select(F.col("vec_id").alias("key"), F.when(F.col("vec_id") % 3 != 0, F.col("v")).otherwise(F.transform("v", lambda x: x * 0)).alias("v"))
    encoded = e.select((F.col("vec_id") + 100).alias("key"), "v").where("key % 2 = 0")
    out = hist.with_fallbacks(table(spark, d, "part").select(F.col("p_partkey").alias("key")), stored, encoded, dim=64)
    return out.select("key", F.transform("v", lambda x: F.round(x, 6) + 0.0).alias("v"))


SOURCES = """so as (select request, item, 'ann' as route, price as s from imp where position % 3 <> 0 union all select request, item, 'bm25', page_time from imp where position % 2 = 1 union all select request, item, 'dpr', collect + 2.0 * share from imp where position % 4 <> 1),
sn as (select *, case when max(s) over w - min(s) over w <= 1e-12 then 1.0 else (s - min(s) over w) / (max(s) over w - min(s) over w) end as n from so window w as (partition by request, route)),
sw as (select request, item, max(case when route = 'ann' then n end) as a, max(case when route = 'bm25' then n end) as b, max(case when route = 'dpr' then n end) as p from sn group by 1, 2)"""
SHAPE_OF = "case request % 4 when 0 then 'short' when 1 then 'long' when 2 then 'recommend' else 'default' end"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d)
    pick = lambda where, name, score: rows.where(where).select("request", "item", F.lit(name).alias("route"), score.cast("double").alias("score"))
    return pick("position % 3 <> 0", "ann", F.col("price")).unionByName(pick("position % 2 = 1", "bm25", F.col("page_time"))).unionByName(pick("position % 4 <> 1", "dpr", F.col("collect") + 2.0 * F.col("share")))


@query(f"""with {IMP}, {SOURCES}, wt as (select * from (values ('short', 0.12, 0.24, 0.64), ('long', 0.16, 0.52, 0.32), ('recommend', 0.20, 0.38, 0.42), ('default', 0.14, 0.34, 0.52)) v(shape, wa, wd, wb)),
f as (select request, item, wa * coalesce(a, 0) + wd * coalesce(p, 0) + wb * coalesce(b, 0) + case when b is not null and p is not null then 0.14 else 0 end + case when a is not null and b is not null then 0.08 else 0 end
  + case when a is not null and p is not null then 0.04 else 0 end + case when a is not null and b is not null and p is not null then 0.08 else 0 end as s from sw join wt on shape = {SHAPE_OF})
select request, item, round(s, 6) as score, row_number() over (partition by request order by round(s, 9) desc, item) as rank from f where s > 0 qualify rank <= 5""")
def source_fusion(spark: SparkSession, d: str) -> DataFrame:
    shapes = requests(spark, d).select("request", F.expr(SHAPE_OF).alias("shape"))
    return routes.search_sources(_sources(spark, d), shapes, 5).select("request", "item", F.round("score", 6).alias("score"), "rank")


CHAIN = """t0 as (select request, item, price / 99991 as s from imp where position % 2 = 1), t1 as (select request, item, page_time / 61 as s from imp where position % 3 <> 0), t2 as (select request, item, collect * 0.37 as s from imp where position <= 4),
t3 as (select request, item, share * 0.53 as s from imp where position >= 3), t4 as (select request, item, "like" * 0.71 as s from imp where position % 5 <> 0)"""


def _chain_parts() -> list[tuple[str, Column]]:
    c = F.col
    return [("position % 2 = 1", c("price") / 99991), ("position % 3 <> 0", c("page_time") / 61), ("position <= 4", c("collect") * 0.37), ("position >= 3", c("share") * 0.53), ("position % 5 <> 0", c("like") * 0.71)]


def _chain(spark: SparkSession, d: str) -> list[DataFrame]:
    rows = impressions(spark, d)
    return [rows.where(w).select("request", "item", s.alias("score")) for w, s in _chain_parts()]


def _chain_routes(spark: SparkSession, d: str, names: list[str], more: dict[str, str] = {}) -> DataFrame:  # noqa: B006 (read only)
    """The first parts of the chain as named routes in one table, from one reading of the impressions. more: a further condition of a route."""
    found = F.array(*(
        F.when(F.expr(w) & F.expr(more.get(name, "true")), F.struct(F.lit(name).alias("route"), s.cast("double").alias("score"))) for name, (w, s) in zip(names, _chain_parts(), strict=False)
    ))
    rows = impressions(spark, d).select("request", "item", F.explode(found).alias("_x")).where("_x is not null")
    return rows.select("request", "item", "_x.route", "_x.score")


def _step(name: str, first: str, second: str, weight: float, bonus: float, k: int = 5, one: float = 1.0) -> str:
    return f"""{name} as (select request, item, sum(s) + case when count(*) > 1 then {bonus} else 0 end as s from (select request, item, {one} * s as s from {first} union all select request, item, {weight} * s from {second}) group by 1, 2 having sum(s) + case when count(*) > 1 then {bonus} else 0 end > 0
  qualify row_number() over (partition by request order by round(sum(s) + case when count(*) > 1 then {bonus} else 0 end, 9) desc, item) <= {k})"""


@query(f"""with {IMP}, {CHAIN}, {_step('c1', 't0', 't1', 0.82, 0.16)}, {_step('c2', 'c1', 't2', 0.78, 0.14)}, {_step('c3', 'c2', 't3', 0.36, 0.10)}, {_step('c4', 'c3', 't4', 0.18, 0.04)} select request, item, round(s, 6) as score from c4""")
def sequence_route(spark: SparkSession, d: str) -> DataFrame:
    """Five routes, one after the other."""
    return routes.sequence_route(*_chain(spark, d), 5).withColumn("score", F.round("score", 6))


@query(f"""with {IMP}, {CHAIN}, g as (select * from t1 where request % 3 <> 0), {_step('c1', '(select * from t0 where request in (select request from g))', 'g', 0.94, 0.08, one=0.86)}
select request, item, round(s, 6) as score from (select * from c1 union all select * from t0 where request not in (select request from g))""")
def user_route(spark: SparkSession, d: str) -> DataFrame:
    """Similar users' items, blended with neighbours where a request has any."""
    a, b, *_ = _chain(spark, d)
    return routes.user_route(a, b.where("request % 3 <> 0"), 5).withColumn("score", F.round("score", 6))


@query(f"""with {IMP}, {CHAIN}, k as (select * from t0 where request % 4 <> 0), {_step('c1', 'k', '(select * from t1 where request in (select request from k))', 0.82, 0.16)}, {_step('c2', 'c1', '(select * from t3 where request in (select request from k))', 0.88, 0.14)},
live as (select * from c2 union all select * from t3 where request not in (select request from k)),
{_step('u1', 't2', 't4', 1.28, 0.12, one=0.72)}, {_step('u2', '(select * from u1 where request in (select request from live))', 'live', 0.94, 0.08, one=0.86)},
us as (select * from u2 union all select * from u1 where request not in (select request from live))
select 'sequence' as route, request, item, round(s, 6) as score from live union all select 'user', request, item, round(s, 6) from us""")
def live_routes(spark: SparkSession, d: str) -> DataFrame:
    """The routes of live requests; some have no transitions."""
    t0, t1, t2, t3, t4 = _chain(spark, d)
    live = routes.live_sequences(t0.where("request % 4 <> 0"), t1, t3, 5)
    users = routes.live_users(t2, t4, live, 5)
    out = live.select(F.lit("sequence").alias("route"), "request", "item", "score").unionByName(users.select(F.lit("user").alias("route"), "request", "item", "score"))
    return out.withColumn("score", F.round("score", 6))


@query(f"""with {IMP}, {CHAIN} select coalesce(t1.request, t0.request) as request, coalesce(t1.item, t0.item) as item, round(coalesce(t1.s, t0.s), 6) as score from t0 full join t1 on t0.request = t1.request and t0.item = t1.item""")
def overlaid_scores(spark: SparkSession, d: str) -> DataFrame:
    a, b, *_ = _chain(spark, d)
    return routes.overlaid(a, b).withColumn("score", F.round("score", 6))


@query(f"""with {IMP}, {SOURCES}, g as (select *, count(*) over (partition by request, route) as n from so) select request, item, route, round(s, 6) as score from g where n >= case route when 'bm25' then 2 when 'dpr' then 3 else 0 end and request in (select request from imp group by 1 having max(collect) > 0)""")
def gated_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes with enough candidates, of the requests that a flag is present in."""
    marked = routes.present(impressions(spark, d).withColumn("from_x", F.when(F.col("collect") > 0, F.col("collect"))), "from_x")
    kept = routes.gated(_sources(spark, d), {"bm25": 2, "dpr": 3})
    return kept.join(marked.select("request"), "request", "left_semi").select("request", "item", "route", F.round("score", 6).alias("score"))


@query(f"""with {IMP}, {REQ}, l as (select request, least(request % 12, 11) as n, request % 2 = 0 as v from req)
select request, case when n <= 2 and v then 0.48 when n >= 8 then 0.08 when n >= 4 then 0.12 else 0.18 end::double as ann, case when n <= 2 and v then 2.08 when n >= 8 then 2.82 when n >= 4 then 2.68 else 2.46 end::double as swing,
 case when n <= 2 and v then 1.82 when n >= 8 then 2.46 when n >= 4 then 2.34 else 2.24 end::double as usercf from l""")
def merge_weights(spark: SparkSession, d: str) -> DataFrame:
    found = routes.merge_weights((F.col("request") % 12).cast("int"), F.col("request") % 2 == 0)
    return requests(spark, d).select("request", *(w.alias(r) for r, w in found.items()))


COLD = """co as (select request, request % 5 = 0 as cold from req), hot as (select request, item, position as rank from imp where request % 3 <> 0 and position <= 3), rec as (select request, item % 40 as item, position as rank from imp where request % 4 = 0),
fe as (select request, item, position as place from imp),
r1 as (select request, item, min(rank) as rank, 'recall' as source from rec where request in (select request from co where not cold) group by 1, 2 qualify row_number() over (partition by request order by min(rank), item) <= 4),
r2 as (select request, item, min(rank) as rank, 'hot' as source from hot where request in (select request from co) and request not in (select request from r1) group by 1, 2),
r3 as (select request, item, min(place) as rank, 'features' as source from fe where request in (select request from co where not cold) and request not in (select request from r1) and request not in (select request from r2) group by 1, 2)"""


@query(f"""with {IMP}, {REQ}, {COLD} select * from r1 union all select * from r2 union all select * from r3""")
def recall_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """What was recalled, else hot items, else the request's own; cold requests get hot items alone."""
    rows = impressions(spark, d)
    cold = requests(spark, d).select("request", (F.col("request") % 5 == 0).alias("cold"))
    hot = rows.where("request % 3 <> 0 and position <= 3").select("request", "item", F.col("position").alias("rank"))
    found = rows.where("request % 4 = 0").select("request", (F.col("item") % 40).alias("item"), F.col("position").alias("rank"))
    return routes.orchestrated(cold, hot, found, rows.select("request", "item", F.col("position").alias("place")), 4)


def _driven(out: DataFrame) -> DataFrame:
    return out.withColumns({c: F.round(c, 6) for c in ("recall_score", "score_ann", "score_swing", "score_usercf")})


@query()
def offline_search_recall(spark: SparkSession, d: str) -> DataFrame:
    """The offline driver for a search: vector, dense and term retrieval by quotas. The order of the merge has no SQL; tests work it by hand."""
    asked = requests(spark, d).select("request", "user", (F.col("request") % 4).cast("int").alias("length"), (F.col("request") % 7 != 0).alias("has_vector"), F.expr(SHAPE_OF).alias("shape"))
    return _driven(routes.offline_of("search", asked, _chain_routes(spark, d, ["ann", "swing", "usercf"]), 6))


@query()
def offline_rec_recall(spark: SparkSession, d: str) -> DataFrame:
    """The offline driver for recommendations, from the indexes on: transitions, item neighbours and similar users of every request, merged in shares of
    the histories, one after the other. No SQL, as above."""
    out = []
    with shuffles_deleted(spark):
        before, edges = written(clicks_before(spark, d), "before"), written(graph(spark, d), "edges")
        steps = before.join(labelled(spark, d).select("request", F.col("item").alias("dst"), "y"), "request").withColumnRenamed("item", "src")
        steps, near = (written(recall.packed(index), "lists") for index in (recall.sequence_transitions(steps), recall.swing(edges)))
        g = written(recall.trimmed(edges, 300, 500), "trimmed")
        dropped(edges)
        theirs = recall.usercf_recall(g, 120, 40)
        similar = written(recall.packed(theirs.select(F.col("user").alias("src"), F.col("item").alias("dst"), "score")), "similar")
        dropped(g, theirs)
        lists = written(steps.join(near.toDF("src", "m", "other"), "src", "full"), "lists")
        asked = written(recall.in_blocks(before), "asked")
        dropped(before, steps, near)
        shares = 1 + asked.count() // LISTS_A_SHARE
        for i in range(shares):  # requests without a history have no rows, so a share of the histories is a share of all
            out.append(written(_driven(routes.rec_in_blocks(asked.where(recall.share_of(i, shares)), lists, similar, 40, 60)), "merged"))
        dropped(asked, lists, similar)
    return reduce(DataFrame.unionByName, out)


@query()
def online_recall(spark: SparkSession, d: str) -> DataFrame:
    """The online driver: small routes dropped, weights learned, merged by quotas and reciprocal ranks. No SQL, as above."""
    found = _chain_routes(spark, d, ["ann", "swing", "usercf", "semantic"], {"semantic": "request % 2 = 0"})
    return _driven(routes.online_of("rec", found, 6, {"swing": 2, "usercf": 2}))


@query(f"""with {SAID}, {SHAPED} select shape, count(*) as n, round(avg(len({seeds('q')})), 6) as terms from sh group by 1""")
def shape_counts(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("q"), F.length("q")
    cut = F.when(F.col("conv_id") % 3 == 0, F.substring("q", 1, 5)).when(F.col("conv_id") % 3 == 1, F.concat(F.substring("q", 1, 3), q.substr(F.greatest(n - 5, F.lit(1)), F.least(F.lit(6), n)))).otherwise(q)
    rows = said(spark, d).withColumn("q", cut)
    return rows.groupBy(routes.query_shape(F.col("q")).alias("shape")).agg(F.count("*").alias("n"), F.round(F.avg(F.size(text.seed_terms(F.col("q")))), 6).alias("terms"))


