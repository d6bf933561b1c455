"""Quota merging, vector blends, texts, deletions and page picks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import history as history_ops
from ..operators import evaluation, quota, recall, serving, vectors
from ..operators import routes as routing
from ..operators.relational import top_k, without
from ..sources.roles import BEH, IMP, REQ, behaviours, impressions, requests, table
from .features import query
from ..streaming.behaviour import deleted
from .ranking import HIST, ROUTES, history
from .search import nq, seeds

THREE = ROUTES.replace("rt as (", "rt as (select request, item, 'usercf' as route, cast(collect + 2 * share as double) as score from imp where position % 4 <> 1 union all ")
NORMED = f"""{THREE}, n as (select *, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as norm
  from rt window w as (partition by request, route))"""


def three_routes(spark: SparkSession, d: str) -> DataFrame:
    """routes and a third, from one reading of the impressions, so rows stay dealt by request."""
    c = F.col
    parts = [("ann", c("position") % 3 != 0, c("price")), ("swing", c("position") % 2 == 1, c("page_time")), ("usercf", c("position") % 4 != 1, c("collect") + 2 * c("share"))]
    found = F.array(*(F.when(held, F.struct(F.lit(name).alias("route"), score.cast("double").alias("score"))) for name, held, score in parts))
    rows = impressions(spark, d).select("request", "item", F.explode(found).alias("_x")).where("_x is not null")
    return rows.select("request", "item", "_x.route", "_x.score")


@query(f"""with {NORMED}, m as (select request, item, max(case when route = 'ann' then norm end) as a, max(case when route = 'swing' then norm end) as s, max(case when route = 'usercf' then norm end) as u from n group by 1, 2)
select request, item, (a is not null)::int + (s is not null)::int + (u is not null)::int as support,
 round(1.0 * coalesce(a, 0) + 0.8 * coalesce(s, 0) + 0.9 * coalesce(u, 0) + 0.10 * ((a is not null)::int + (s is not null)::int + (u is not null)::int - 1)
  + case when u is not null and s is not null then 0.12 else 0 end + case when a is not null and u is not null then 0.08 else 0 end + case when a is not null and s is not null then 0.05 else 0 end, 6) as score from m""")
def quota_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = quota.overlap_scores(recall.normed(three_routes(spark, d)), {"ann": 1.0, "swing": 0.8, "usercf": 0.9})
    return scored.withColumn("score", F.round("score", 6))


def three_normed(spark: SparkSession, d: str) -> DataFrame:
    return recall.normed(three_routes(spark, d)).select("request", "item", "route", "norm")


@query()
def quota_order(spark: SparkSession, d: str) -> DataFrame:
    """The offline merge with scores, flags and the route that emits. Its turns depend on one another, so there is no SQL; tests work them by hand."""
    policy = quota.offline_policy(quota.ORDER["search"], 1, 0.4, 5)
    out = quota.merged_by_scores(three_normed(spark, d), {"ann": 1.0, "swing": 0.8, "usercf": 0.9}, policy)
    return out.withColumn("recall_score", F.round("recall_score", 6))


@query()
def quota_rank_order(spark: SparkSession, d: str) -> DataFrame:
    """The online merge, by reciprocal ranks. No SQL, as above."""
    out = quota.merged_by_ranks(serving.weighed(three_normed(spark, d), {"swing": 0.8}), None, "rec", 6)
    return out.withColumn("recall_score", F.round("recall_score", 6))


@query(f"""with {IMP}, {REQ}, {HIST}, v as (select vec_id, embedding, (select count(*) from embeddings) as n from embeddings),
x as (select u, rec, count(*) over (partition by u) as len, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as "at" from his join v on vec_id = i % n),
w as (select *, case when len = 1 then 0.35 else 0.35 + 0.65 * (len - 1 - rec) / (len - 1) end as w from (select u, rec, x, "at", max(rec) over (partition by u) + 1 as len from x)),
g as (select u, "at", sum(x * w) / sum(w) as weighted, avg(x) as mean, max(x) as top, max(case when rec = 0 then x end) as last, avg(case when rec < 5 then x end) as recent from w group by 1, 2),
s as (select u, "at", 0.34 * weighted + 0.26 * recent + 0.18 * last + 0.14 * mean + 0.08 * top as v from g)
select u as "user", "at", round(v / greatest(sqrt(sum(v * v) over (partition by u)), 1e-12), 6) + 0.0 as value from s""")
def history_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    h = history(spark, d).crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("item") % F.col("n"))
    summaries = history_ops.summarised(h.select("user", "recency", "vec_id"), e.select("vec_id", F.col("embedding").alias("v")))
    return summaries.select("user", F.posexplode("v").alias("at", "x")).select("user", "at", (F.round("x", 6) + 0.0).alias("value"))


@query("""select vec_id, round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6) as norm, len(embedding) as dim from embeddings""")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("long").alias("dim"))


#: Each turn with a phrase of one of the intents, or two, by its conversation: the turns themselves hold none.
PHRASES = [phrases[0] for phrases in text.INTENTS.values()]
SAID = f"""said as (select conv_id, turn, {nq("text || ' ' || " + f"{PHRASES!r}[1 + conv_id % 6]" + " || case when turn % 3 = 0 then " + f"{PHRASES!r}[1 + (conv_id + turn) % 6]" + " else '' end")} as q from conversations where role = 'user')"""


def said(spark: SparkSession, d: str) -> DataFrame:
    phrases = F.array(*map(F.lit, PHRASES))
    at = lambda n: F.element_at(phrases, (n % 6 + 1).cast("int"))
    more = F.when(F.col("turn") % 3 == 0, at(F.col("conv_id") + F.col("turn"))).otherwise("")
    typed = F.concat(F.col("text"), F.lit(" "), at(F.col("conv_id")), more)
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", text.normalized(typed).alias("q"))


INTENT_LIST = "list_filter([" + ", ".join(f"case when {' or '.join(f'contains(q, {p!r})' for p in phrases)} then '{n}' end" for n, phrases in text.INTENTS.items()) + "], lambda x: x is not null)[1:3]"


@query(f"with {SAID} select conv_id, turn, {INTENT_LIST} as intents from said")
def query_intents(spark: SparkSession, d: str) -> DataFrame:
    return said(spark, d).select("conv_id", "turn", text.intents(F.col("q")).alias("intents"))


SHAPED = f"""sh as (select conv_id, turn, q, case when len(replace(q, ' ', '')) <= 6 or len({seeds('q')}) <= 2 then 'short' when len(replace(q, ' ', '')) >= 12 or list_has_any({INTENT_LIST}, ['tutorial', 'compare', 'review']) then 'long'
  when list_has_any({INTENT_LIST}, ['recommend', 'fashion']) then 'recommend' else 'default' end as shape from (select conv_id, turn, case when conv_id % 3 = 0 then substr(q, 1, 5) when conv_id % 3 = 1 then substr(q, 1, 3) || substr(q, len(q) - 5, 6) else q end as q from said))"""


@query(f"""with {SAID}, {SHAPED}, w as (select * from (values ('short', 0.12, 0.24, 0.64), ('long', 0.16, 0.52, 0.32), ('recommend', 0.20, 0.38, 0.42), ('default', 0.14, 0.34, 0.52)) v(shape, a, d, b))
select conv_id, turn, shape, round(a::double, 6) as ann, round(d::double, 6) as dpr, round(b::double, 6) as bm25 from sh join w using (shape)""")
def query_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The shape of each query, some of them cut short, with the weights of the sources."""
    q, n = F.col("q"), F.length("q")
    cut = F.when(F.col("conv_id") % 3 == 0, F.substring("q", 1, 5)).when(F.col("conv_id") % 3 == 1, F.concat(F.substring("q", 1, 3), q.substr(F.greatest(n - 5, F.lit(1)), F.least(F.lit(6), n)))).otherwise(q)
    rows = said(spark, d).withColumn("q", cut).withColumn("shape", routing.query_shape(F.col("q")))
    return rows.select("conv_id", "turn", "shape", *(F.round(w, 6).alias(s) for s, w in routing.shape_weights(F.col("shape")).items()))


@query(r"""with t as (select doc_id, trim(case when doc_id % 3 <> 0 then split_part(text, '.', 1) else '' end, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t,
  trim(case when doc_id % 5 <> 0 then text else '' end, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as c from documents)
select doc_id, md5(case when t <> '' and c <> '' then 'title：' || t || chr(10) || 'content：' || c when t <> '' then 'title：' || t else 'content：' || c end) as built from t""")
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """The md5 of each document's built text: its first sentence as title and its whole text as content, either blank at times."""
    title = F.when(F.col("doc_id") % 3 != 0, F.substring_index("text", ".", 1)).otherwise("")
    content = F.when(F.col("doc_id") % 5 != 0, F.col("text")).otherwise("")
    return table(spark, d, "documents").select("doc_id", F.md5(text.built(title, content)).alias("built"))


ASKED = """asked as (select distinct user_id as u, scene, note, case when note % 2 = 0 then max(ts) over (partition by user_id, scene, note) end as ts,
  case when note % 3 = 0 then min(request) over (partition by user_id, scene, note) end as request from beh where note is not null and user_id % 4 = 0)"""


@query(f"""with {BEH}, {ASKED}, m as (select a.u, a.scene, a.note, e.event_id, e.ts, a.ts is null or a.ts = e.ts as exact from asked a join beh e on e.user_id = a.u and e.scene = a.scene and e.note = a.note and (a.request is null or a.request = e.request)),
g as (select event_id, u, scene, note from m where exact qualify row_number() over (partition by u, scene, note order by ts desc, event_id desc) = 1),
l as (select distinct u, scene, note from m where event_id not in (select event_id from g))
select u as "user", scene, note, (u, scene, note) not in (select (u, scene, note) from l) as left_history,
 (select count(*) from beh where user_id = g.u and beh.scene = g.scene and beh.note = g.note and event_id <> g.event_id) as left_events from g""")
def behaviour_deletion(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the notes of which an event is deleted: its newest match, by time or request where these are given."""
    rows = behaviours(spark, d)
    known = rows.where("note is not null and user % 4 = 0").groupBy("user", "scene", "note").agg(F.max("ts").alias("_ts"), F.min("request").alias("_request"))
    asked = known.select("user", "scene", "note", F.when(F.col("note") % 2 == 0, F.col("_ts")).alias("ts"), F.when(F.col("note") % 3 == 0, F.col("_request")).alias("request"))
    kept, gone = deleted(rows, asked)
    pair = ["user", "scene", "note"]
    removed = without(rows, kept, ["event_id"]).select(*pair).distinct()
    left = removed.join(kept.groupBy(*pair).agg(F.count("*").alias("left_events")), pair, "left")
    marked = left.join(gone.withColumn("left_history", F.lit(True)), pair, "left")
    return marked.select(*pair, F.coalesce("left_history", F.lit(False)).alias("left_history"), F.coalesce("left_events", F.lit(0)).alias("left_events"))


@query(f"""with {IMP}, {REQ}, c as (select user_id as u, request, count(*) * 2 as results, cast(sum(page_time) as bigint) % 30 as behaviours from imp join req using (request) group by 1, 2),
t as (select *, case when results >= 20 then 2 when results >= 10 then 1 else 0 end as result_tier, case when behaviours >= 20 then 2 when behaviours >= 10 then 1 else 0 end as behaviour_tier, (results >= 10 and behaviours >= 10)::int as fine from c),
o as (select * from t qualify row_number() over (partition by u order by fine desc, result_tier desc, behaviour_tier desc, results desc, behaviours desc, request) = 1)
select u as "user", request, result_tier, behaviour_tier, row_number() over (order by case when u = 7 then 0 else 1 end, fine desc, result_tier desc, behaviour_tier desc, results desc, behaviours desc, request) as place from o qualify place <= 50""")
def diverse_picks(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty requests for a report, one for each user, user 7's first."""
    rows = impressions(spark, d).join(requests(spark, d), "request")
    counts = rows.groupBy("user", "request").agg((F.count("*") * 2).alias("results"), (F.sum("page_time").cast("long") % 30).alias("behaviours"))
    return evaluation.examples(counts, 50, 7).select("user", "request", "result_tier", "behaviour_tier", "place")


@query(f"""with {BEH}, x as (select scene, user_id as u, note, max(ts) as ts, max(event_id) as e from beh where note is not null group by 1, 2, 3),
r as (select *, row_number() over (partition by u order by ts desc, e desc) as r from x) select u as "user", scene, note, r as rank from r where r <= 10""")
def cross_scene_behaviours(spark: SparkSession, d: str) -> DataFrame:
    last = behaviours(spark, d).where("note is not null").groupBy("user", "scene", "note").agg(F.max("ts").alias("ts"), F.max("event_id").alias("e"))
    return top_k(last, "user", [F.desc("ts"), F.desc("e")], 10).select("user", "scene", "note", "rank")


@query(f"""with {IMP}, x as (select item, count(*) as n, sum(click) as c from imp group by 1)
select case when n >= 40 then 'head' when n >= 25 then 'middle' else 'tail' end as tier, count(*) as items, cast(sum(n) as bigint) as impressions, round(sum(c) / sum(n), 6) as ctr from x group by 1""")
def tier_coverage(spark: SparkSession, d: str) -> DataFrame:
    g = impressions(spark, d).groupBy("item").agg(F.count("*").alias("n"), F.sum("click").alias("c"))
    tier = F.when(F.col("n") >= 40, "head").when(F.col("n") >= 25, "middle").otherwise("tail").alias("tier")
    return g.groupBy(tier).agg(F.count("*").alias("items"), F.sum("n").alias("impressions"), F.round(F.sum("c") / F.sum("n"), 6).alias("ctr"))
