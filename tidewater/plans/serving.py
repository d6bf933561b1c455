"""Serving, export, query-understanding and further metric queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, metrics, recall, serving, vectors
from ..operators.relational import latest, min_max, top_k
from ..sources.roles import BEH, IMP, REQ, behaviours, impressions, requests, table
from ..streaming.behaviour import front_list
from .features import LAB, TOKEN, labelled, query
from .ranking import BEFORE, HIST, ROUTES, clicks_before, history, routes


@query(f"""with {ROUTES}, n as (select *, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as norm
  from rt window w as (partition by request, route)),
k as (select *, row_number() over (partition by request, route order by norm desc, item) as r from n),
s as (select request, route, max(norm) as top, count(*) as n, avg(norm) as mean, quantile_cont(norm, 0.9) as p90, avg(case when r <= 50 then norm end) as m50 from k group by 1, 2),
q as (select request, route, case route when 'swing' then 0.8 else 1.0 end * greatest(0.05, 0.5 + 0.40 * top + 0.25 * case when n >= 5 then p90 else top end + 0.20 * m50 + 0.10 * least(1.0, n / 200) + 0.05 * greatest(0, top - mean)) as raw from s)
select request, route, round(raw / sum(raw) over (partition by request) * count(*) over (partition by request), 6) as weight from q""")
def auto_route_weights(spark: SparkSession, d: str) -> DataFrame:
    return serving.route_weights(recall.normed(routes(spark, d)), {"swing": 0.8}).withColumn("weight", F.round("weight", 6))


@query(f"""with {IMP}, {LAB}, e as (select list_distinct(quantile_cont(y, [0.2, 0.4, 0.6, 0.8])) as ed from lab where y > 0)
select request, item, case when y > 0 then 1 + len(list_filter(ed, lambda v: v <= y)) else 0 end as grade from lab, e""")
def discretized_relevance(spark: SparkSession, d: str) -> DataFrame:
    return serving.relevance_grades(labelled(spark, d).withColumn("y", F.col("y").cast("double")), "y").select("request", "item", "grade")


@query(f"""with {IMP}, {LAB}, r as (select request, item, row_number() over (partition by request order by price desc, item) as rank from imp where position % 3 <> 0),
h as (select l.request, rank from lab l left join r using (request, item) where y > 0),
e as (select request, min(rank) as f, {', '.join(f'count(case when rank <= {k} then 1 end) / count(*) as r{k}, max(case when rank <= {k} then 1 else 0 end) as h{k}' for k in (1, 3, 100))} from h group by 1)
select {', '.join(f'round(avg(r{k}), 6) as recall_{k}, round(avg(h{k}), 6) as hit_{k}, round(avg(case when f <= {k} then 1 / f else 0 end), 6) as mrr_{k}' for k in (1, 3, 100))},
 coalesce(median(f), -1.0) as first_hit, count(*) as n_requests from e""")
def full_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall over all positives, also those that the route lacks."""
    order = Window.partitionBy("request").orderBy(F.desc("price"), "item")
    found = impressions(spark, d).where("position % 3 <> 0").withColumn("rank", F.row_number().over(order))
    out = evaluation.full_recall(found, labelled(spark, d), (1, 3, 100))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns if c not in ("first_hit", "n_requests")), "first_hit", "n_requests")


FINAL = f"""{IMP}, x as (select *, case when max(price) over w = min(price) over w then 0.0 else (price - min(price) over w) / (max(price) over w - min(price) over w + 1e-6) end as deep,
 case when max(page_time) over w = min(page_time) over w then 0.0 else (page_time - min(page_time) over w) / (max(page_time) over w - min(page_time) over w + 1e-6) end as pre from imp window w as (partition by request)),
y as (select *, "like" * 0.5 as lexical, collect as exact, comment * 0.25 as cover, share as strong, 1 - click as weak, case when click = 0 and "like" = 0 and collect = 0 then 1 else 0 end as hard from x),
fin as (select request, item, 0.72 * pre + 0.28 * (deep + 0.18 * lexical + 1.05 * exact + 1.25 * cover + 0.90 * strong + 0.16 * (deep - pre) - 2.0 * hard - 0.65 * weak) + 0.04 * lexical + 0.08 * cover + 0.12 * exact as score from y)"""


def final(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d).withColumns({"deep": min_max("request", "price", 0.0, 1e-6), "pre": min_max("request", "page_time", 0.0, 1e-6)})
    hard = F.when((F.col("click") == 0) & (F.col("like") == 0) & (F.col("collect") == 0), 1).otherwise(0)
    named = rows.withColumns({"lexical": F.col("like") * 0.5, "exact": F.col("collect"), "cover": F.col("comment") * 0.25, "strong": F.col("share"), "weak": 1 - F.col("click"), "hard": hard})
    return named.select("request", "item", serving.search_final(named).alias("score"))


@query(f"with {FINAL} select request, item, round(score, 6) as score, row_number() over (partition by request order by round(score, 9) desc, item) as rank from fin")
def search_final_rank(spark: SparkSession, d: str) -> DataFrame:
    return top_k(final(spark, d), "request", [F.desc(F.round("score", 9)), F.col("item")], 1 << 30).withColumn("score", F.round("score", 6))


@query(f"""with {FINAL}, {REQ}, {HIST}, r as (select fin.*, user_id as u from fin join req using (request)), sh as (select distinct user_id as u, item from imp join req using (request) where position = 1),
m as (select r.*, h.i is not null as seen, sh.item is not null as shown from r left join (select distinct u, i from his) h on h.u = r.u and h.i = r.item left join sh on sh.u = r.u and sh.item = r.item),
e as (select *, sum(case when shown then 0 else 1 end) over (partition by request) >= least(20, count(*) over (partition by request)) as enough from m),
f as (select request, item, score - case when seen then 0.90 else 0 end - case when shown then 0.28 else 0 end as s from e where not shown or not enough)
select request, item, round(s, 6) as final, row_number() over (partition by request order by round(s, 9) desc, item) as rank from f""")
def diversity_rerank(spark: SparkSession, d: str) -> DataFrame:
    req = requests(spark, d)
    ranked = final(spark, d).join(req, "request").select("request", "user", "item", "score")
    shown = impressions(spark, d).where("position = 1").join(req, "request").select("user", "item")
    return serving.diversified(ranked, history(spark, d), shown).withColumn("final", F.round("final", 6))


@query(f"""with {IMP}, i as (select item, 1.0 * sum("like") + 1.2 * sum(collect) + 0.8 * sum(comment) + 0.2 * count(*) as s from imp group by 1),
pool as (select item, row_number() over (order by round(s, 9) desc, item) - 1 as place from i qualify place < 20),
h as (select request, count(*) as n, min(price) as f from imp group by 1 having count(*) < 5),
o as (select h.*, pool.item, row_number() over (partition by h.request order by place) - 1 as k from h, pool where not exists (select 1 from imp where imp.request = h.request and imp.item = pool.item))
select request, item, round(price, 6) as score, 0 as filled from imp union all select request, item, round(f - 1 - k / 1000, 6), 1 from o where k < 5 - n""")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d)
    items = rows.groupBy("item").agg(F.sum("like").alias("like"), F.sum("collect").alias("collect"), F.sum("comment").alias("comment"), F.count("*").alias("imp"))
    hot = recall.hot_items(items, 20)
    pool = hot.select("item", (F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "item")) - 1).alias("place"))
    return serving.backfilled(rows.select("request", "item", F.col("price").alias("score")), pool, 5).withColumn("score", F.round("score", 6))


@query("""select c_custkey as "user", '{"name":"' || c_name || '","segment":"' || c_mktsegment || '","nation":' || c_nationkey || '}' as profile from customer""")
def profile_json(spark: SparkSession, d: str) -> DataFrame:
    named = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.to_json(named).alias("profile"))


@query(f"""with {REQ} select user_id as "user", list(request order by ts, request) as requests from req group by 1""")
def user_request_lists(spark: SparkSession, d: str) -> DataFrame:
    g = requests(spark, d).groupBy("user").agg(F.sort_array(F.collect_list(F.struct("ts", "request"))).alias("s"))
    return g.select("user", F.col("s.request").alias("requests"))


@query(f"""with {IMP}, {REQ}, {BEFORE.replace('had - 20', 'had - 60')}, l as (select u, request, list(item order by rec desc)[1:50] as items from bef group by 1, 2)
select l.u as "user", items from l join req using (request) qualify row_number() over (partition by l.u order by ts desc, request desc) = 1""")
def history_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The history of each user's latest request that has one, the first fifty of sixty."""
    before = clicks_before(spark, d, 60).groupBy("user", "request").agg(F.sort_array(F.collect_list(F.struct("recency", "item")), asc=False).alias("s"))
    last = latest(before.join(requests(spark, d).select("request", "ts"), "request"), "user", [F.desc("ts"), F.desc("request")])
    return last.select("user", F.slice(F.col("s.item"), 1, 50).alias("items"))


@query(f"""with {IMP}, {REQ}, {HIST}, w as (select u, p_brand as brand, sum(1 / (1 + rec)) as w from his join part on p_partkey = i group by 1, 2)
select u as "user", brand, round(w, 6) as weight, row_number() over (partition by u order by round(w, 9) desc, brand) as rank from w qualify rank <= 8""")
def brand_preferences(spark: SparkSession, d: str) -> DataFrame:
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"))
    return serving.preference_counts(history(spark, d).join(brand, "item"), "brand", 8).withColumn("weight", F.round("weight", 6))


#: Latin letters as Chinese characters, so that terms are cut and corrected by the rules for these.
LATIN, CHINESE = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(26))
TERMS = f"""w as (select unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from conversations where role = 'user'),
t as (select term, count(*) as freq from w where len(term) > 2 group by 1),
cw as (select unnest(regexp_extract_all(translate(lower(text), '{LATIN}', '{CHINESE}'), '{TOKEN}')) as term from conversations where role = 'user'),
ct as (select term, count(*) as freq from cw where len(term) > 2 group by 1)"""


def _terms(spark: SparkSession, d: str, chinese: bool = False) -> DataFrame:
    said = F.translate(F.lower("text"), LATIN, CHINESE) if chinese else F.col("text")
    words = table(spark, d, "conversations").where("role = 'user'").select(F.explode(text.tokens(said)).alias("term"))
    return words.where(F.length("term") > 2).groupBy("term").agg(F.count("*").alias("freq"))


@query(f"""with {TERMS}, k as (select term as known, freq, term[1:1] as b, row_number() over (partition by term[1:1] order by freq desc, len(term) desc, term) as place from ct where freq >= 2),
u as (select term from ct where freq < 2 and not regexp_full_match(term, '[a-z0-9]+')),
p as (select u.term, known, freq, place, levenshtein(translate(u.term, '{CHINESE}', '{LATIN}'), translate(known, '{CHINESE}', '{LATIN}')) as ed from u join k on u.term[1:1] = k.b and place <= 80 and abs(len(u.term) - len(known)) <= 1),
s as (select term, known, place, len(list_intersect(list_distinct(string_split(term, '')), list_distinct(string_split(known, '')))) / len(list_distinct(list_concat(string_split(term, ''), string_split(known, '')))) + 0.05 * ln(1 + freq) - 0.35 * ed as score from p where ed <= 1)
select term, known, round(score, 6) as score from s where score >= 0.75 qualify row_number() over (partition by term order by round(score, 9) desc, place) = 1""")
def term_corrections(spark: SparkSession, d: str) -> DataFrame:
    t = _terms(spark, d, chinese=True)
    return serving.corrections(t.where("freq >= 2"), t.where("freq < 2")).withColumn("score", F.round("score", 6))


@query(f"""with {TERMS}, b as (select term[1:2] as prefix, term, freq, row_number() over (partition by term[1:2] order by freq desc, term) as r from t)
select prefix, list(term order by r) as terms from b where r <= 10 group by 1""")
def prefix_suggestions(spark: SparkSession, d: str) -> DataFrame:
    t = top_k(_terms(spark, d).withColumn("prefix", F.substring("term", 1, 2)), "prefix", [F.desc("freq"), F.col("term")], 10, "r")
    g = t.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("r", "term"))).alias("s"))
    return g.select("prefix", F.col("s.term").alias("terms"))


@query(f"""with {IMP}, {LAB}, o as (select request, price / 10000 as s, y, pow(2, y) - 1 as g, 1 / log2(row_number() over (partition by request order by price desc, item) + 1) as d,
  (pow(2, y) - 1) / log2(row_number() over (partition by request order by y desc, item) + 1) as i from lab),
q as (select request, sum(i) as ideal from o group by 1),
l as (select a.request, sum(ln(1 + exp(-(a.s - b.s))) * abs((a.g - b.g) * (a.d - b.d))) as l from o a join o b on a.request = b.request and a.y > b.y group by 1)
select request, round(l / (ideal + 1e-9), 6) as loss from l join q using (request)""")
def lambda_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("s", F.col("price") / 10000)
    return serving.pairwise_loss(rows, "request", "s", "y").withColumn("loss", F.round("loss", 6))


@query(f"""with {IMP}, a as (select request, item, row_number() over (partition by request order by price desc, item) as x, row_number() over (partition by request order by page_time desc, item) as y from imp)
select request, count(*) as overlap from a where x <= 3 and y <= 3 group by 1""")
def stage_overlap(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("request")
    rows = impressions(spark, d).withColumns({"x": F.row_number().over(w.orderBy(F.desc("price"), "item")), "y": F.row_number().over(w.orderBy(F.desc("page_time"), "item"))})
    return rows.where("x <= 3 and y <= 3").groupBy("request").agg(F.count("*").alias("overlap"))


@query(f"""with {IMP}, i as (select item, 1 * sum("like") + 1.5 * sum(collect) + 2 * sum(comment) as s from imp group by 1), r as (select item, s, row_number() over (order by s desc, item desc) as r from i)
select item, round(s, 6) as score, r as place from r where r > 40 and r <= 60""")
def hot_pool_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the pool of popular items."""
    items = impressions(spark, d).groupBy("item").agg(*(F.sum(c).alias(c) for c in ("like", "collect", "comment")))
    return recall.hot_pool(items, 60).where("place > 40 and place <= 60").withColumn("score", F.round("score", 6))


@query(f"""with {BEH}, l as (select user_id as u, scene, note, max(ts) as ts, max(event_id) as e from beh where note is not null and action = 'view' group by 1, 2, 3),
r as (select *, row_number() over (partition by u order by ts desc, e desc, note) as r from (select u, note, max(ts) as ts, max(e) as e from l group by 1, 2))
select u as "user", list(note order by r) as notes from r where r <= 500 group by 1""")
def exposure_list(spark: SparkSession, d: str) -> DataFrame:
    return front_list(behaviours(spark, d).where("action = 'view'"), 500)


@query("""with m as (select label, list(x order by p) as c from (select label, p, avg(x) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as p from embeddings) group by 1, 2) group by 1)
select vec_id, round(list_cosine_similarity(cast(embedding as double[]), c), 6) as score from embeddings join m using (label)""")
def centroid_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    long = vectors.mean_vector(v, "label", "embedding")
    c = long.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("c"))
    return v.join(c, "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("c")), 6).alias("score"))


@query(f"""with {IMP}, {LAB}, c as (select page_time as v, sum(click) as p, sum(1 - click) as n from imp group by 1),
w as (select p, n, p * (coalesce(sum(n) over (order by v rows between unbounded preceding and 1 preceding), 0) + n / 2) as w from c),
a as (select sum(w) / (sum(p) * sum(n)) as auc from w)
select count(*) as n_rows, count(distinct request) as n_requests, round(max(auc), 6) as auc, round(avg(y), 6) as mean_label from lab, a""")
def metric_bundle(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    whole = rows.agg(F.count("*").alias("n_rows"), F.countDistinct("request").alias("n_requests"), F.round(F.avg("y"), 6).alias("mean_label"))
    return whole.crossJoin(F.broadcast(metrics.auc(rows, "page_time", "click").select(F.round("auc", 6).alias("auc"))))
