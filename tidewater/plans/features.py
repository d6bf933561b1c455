"""Feature, filter, join, aggregation and window queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing, scoring, text
from ..operators import relational as rel
from ..operators import training
from ..sources.roles import BEH, IMP, REQ, impressions, requests, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Tokens as DuckDB writes them.
TOKEN = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]+"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


YM = 'case when click = 0 then 0.0 else click + 2 * "like" + 3 * collect + 3 * comment + 3 * share + 0.2 * ln(1 + page_time) end'
LAB = f"lab as (select *, {YM} as y from imp)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return impressions(spark, d).withColumn("y", scoring.graded_label())


@query(f"""with {IMP}, {REQ}, {LAB},
it as (select item, count(*) as imp_num, sum(click) as click_num, sum("like") as like_num, sum(collect) as collect_num from imp group by 1)
select l.request, l.item, r.user_id as "user", p_brand as brand, c_mktsegment as segment, l.position,
 case when position <= 4 then 1 when position <= 8 then 2 when position <= 12 then 3 when position <= 20 then 4 when position <= 50 then 5
      when position <= 200 then 6 when position <= 300 then 7 when position <= 400 then 8 when position <= 500 then 9 else 10 end as pos_bucket,
 round(y, 6) as y_multi, round(click + 2 * "like" + 3 * collect + 3 * comment + 3 * share + 0.2 * ln(1 + page_time), 6) as interaction,
 round(click_num / imp_num, 6) as ctr, round(coalesce(like_num / nullif(click_num, 0), 0), 6) as like_rate,
 round(coalesce(collect_num / nullif(click_num, 0), 0), 6) as collect_rate
from lab l join req r using (request) left join it using (item) left join part on p_partkey = l.item left join customer on c_custkey = r.user_id""")
def features_wide(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    items = rows.groupBy("item").agg(
        F.count("*").alias("imp_num"), F.sum("click").alias("click_num"), F.sum("like").alias("like_num"), F.sum("collect").alias("collect_num")
    )
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"))
    user = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("segment"))
    wide = rows.join(requests(spark, d), "request").join(items, "item", "left").join(part, "item", "left").join(user, "user", "left")
    return wide.select(
        "request", "item", "user", "brand", "segment", "position", scoring.position_bucket().alias("pos_bucket"), F.round("y", 6).alias("y_multi"),
        F.round(scoring.interaction_score(), 6).alias("interaction"), F.round(scoring.safe_rate("click_num", "imp_num"), 6).alias("ctr"),
        F.round(scoring.safe_rate("like_num", "click_num"), 6).alias("like_rate"), F.round(scoring.safe_rate("collect_num", "click_num"), 6).alias("collect_rate"),
    )


@query(f"with {IMP} select request, list(item order by position) as items, count(*) as n from imp group by 1 order by 1")
def nested_log(spark: SparkSession, d: str) -> DataFrame:
    g = impressions(spark, d).groupBy("request").agg(F.sort_array(F.collect_list(F.struct("position", "item"))).alias("s"), F.count("*").alias("n"))
    return g.select("request", F.col("s.item").alias("items"), "n")


@query(f"with {IMP} select request, item, position, click from imp")
def flatten_log(spark: SparkSession, d: str) -> DataFrame:
    nested = impressions(spark, d).groupBy("request").agg(F.collect_list(F.struct("item", "position", "click")).alias("results"))
    return nested.select("request", F.inline("results"))


CODED = {"brand": "p_brand", "type": "p_type", "size": "p_size", "segment": "nullif(c_mktsegment, 'BUILDING')", "nation": "c_nationkey", "kind": "o_orderpriority", "status": "o_orderstatus"}
CODED_ROWS = f"""cr as (select request, item, {', '.join(f'cast({e} as varchar) as {n}' for n, e in CODED.items())} from imp join orders on o_orderkey = request
  left join part on p_partkey = item left join customer on c_custkey = o_custkey)"""


def coded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Impressions with seven categories; one of them is null at times."""
    part, user = table(spark, d, "part").withColumn("item", F.col("p_partkey")), table(spark, d, "customer").withColumn("o_custkey", F.col("c_custkey"))
    rows = impressions(spark, d).join(table(spark, d, "orders").withColumn("request", F.col("o_orderkey")), "request").join(part, "item", "left").join(user, "o_custkey", "left")
    return rows.select("request", "item", *(F.expr(e).alias(n) for n, e in CODED.items()))


@query(f"""with {IMP}, {CODED_ROWS}, {', '.join(f"v_{n} as (select v, row_number() over (order by v) - 1 as code from (select distinct coalesce({n}, 'UNK') as v from cr where request % 4 <> 0))" for n in CODED)}
select request, item, {', '.join(f'coalesce(v_{n}.code, 0) as {n}_enc' for n in CODED)} from cr {' '.join(f'left join v_{n} on v_{n}.v = cr.{n}' for n in CODED)}""")
def vocabulary_codes(spark: SparkSession, d: str) -> DataFrame:
    """Seven columns by vocabularies of the training rows; null and unknown values are 0."""
    rows = coded_rows(spark, d)
    codes = {n: training.vocabulary(rows.where("request % 4 <> 0"), n) for n in CODED}
    return training.encoded(rows, codes).select("request", "item", *(f"{n}_enc" for n in CODED))


@query(f"""with {IMP}, {CODED_ROWS} {' union all '.join(f"select '{n}' as name, count(distinct coalesce({n}, 'UNK')) as size from cr where request % 4 <> 0" for n in CODED)}""")
def vocabulary_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = coded_rows(spark, d).where("request % 4 <> 0")
    return training.vocabulary_sizes({n: training.vocabulary(rows, n) for n in CODED})


@query(f"""with {IMP}, {LAB}, g as (select *, count(*) over (partition by request) as n, max(y) over (partition by request) as m from lab)
select request, item, round(y, 6) as y from g where n > 1 and m > 0""")
def valid_group_filter(spark: SparkSession, d: str) -> DataFrame:
    return rel.valid_groups(labelled(spark, d), "request", "y").select("request", "item", F.round("y", 6).alias("y"))


@query(f"""with {REQ} select "user", request from (select user_id as "user", request, row_number() over (partition by user_id order by ts desc, request desc) as r from req) where r = 1""")
def latest_request(spark: SparkSession, d: str) -> DataFrame:
    return rel.latest(requests(spark, d), "user", [F.desc("ts"), F.desc("request")]).select("user", "request")


@query(f"""with {IMP} select request, item, position from imp where position <= 3 or click > 0""")
def top_or_positive(spark: SparkSession, d: str) -> DataFrame:
    return impressions(spark, d).where("position <= 3 or click > 0").select("request", "item", "position")


@query(f"""with {IMP} select request, item,
 round(case when count(*) over w <= 1 or coalesce(stddev_samp(price) over w, 0) = 0 then 0 else (price - avg(price) over w) / (stddev_samp(price) over w + 1e-9) end, 6) as z,
 round(case when max(price) over w = min(price) over w then 1.0 else (price - min(price) over w) / (max(price) over w - min(price) over w) end, 6) as mm
from imp window w as (partition by request)""")
def group_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d)
    return rows.select("request", "item", F.round(rel.z_score("request", "price"), 6).alias("z"), F.round(rel.min_max("request", "price", 1.0), 6).alias("mm"))


@query(f"""with {IMP} select i.request, i.item from imp i where not exists (select 1 from imp j where j.request = i.request and j.item = i.item and j.click > 0)""")
def negatives_anti_join(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d)
    return rel.without(rows, rows.where("click > 0"), ["request", "item"]).select("request", "item")


@query(f"""with {IMP}, s as (select request, item, max(price) as score from imp where position % 2 = 1 group by all), l as (select request, item, click from imp where position <= 4)
select coalesce(s.request, l.request) as request, coalesce(s.item, l.item) as item, round(score, 6) as score, click from s full join l on s.request = l.request and s.item = l.item""")
def scored_completion(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d)
    scored = rows.where("position % 2 = 1").select("request", "item", F.col("price").alias("score"))
    return rel.completed(scored, rows.where("position <= 4").select("request", "item", "click"), ["request", "item"], "score").withColumn("score", F.round("score", 6))


@query("""with c as (select c_custkey as "user", c_mktsegment as segment, c_acctbal as balance from customer), n as (select o_custkey as "user", count(*) as n_requests from orders group by 1)
select "user", segment, balance, coalesce(n_requests, 0) as n_requests from c left join n using ("user")""")
def login_catalogue(spark: SparkSession, d: str) -> DataFrame:
    n = requests(spark, d).groupBy("user").agg(F.count("*").alias("n_requests"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return c.join(n, "user", "left").withColumn("n_requests", F.coalesce("n_requests", F.lit(0)))


@query("""select c_custkey as "user", count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1 having count(o_orderkey) < 3""")
def cold_start_users(spark: SparkSession, d: str) -> DataFrame:
    return rel.cold_start(table(spark, d, "customer").select(F.col("c_custkey").alias("user")), requests(spark, d))


@query(f"""with {IMP}, m as (select item, ln(1 + count(*)) as x from imp group by 1), s as (select avg(x) as a, stddev_samp(x) as sd from m)
select item, round((x - a) / case when sd > 1e-6 then sd else 1 end, 6) as z from m, s""")
def counter_z_score(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d).groupBy("item").agg(F.count("*").alias("z"))
    return rel.standardised(rows, counters=["z"]).select("item", F.round("z", 6).alias("z"))


@query(f"""select conv_id, turn, regexp_extract_all(lower(text), '{TOKEN}') as tokens, len(regexp_extract_all(lower(text), '{TOKEN}')) as n from conversations where role = 'user'""")
def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", text.tokens(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens").cast("long"))


@query(f"""with t as (select unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from conversations where role = 'user')
select term, count(*) as freq, round(ln(1 + count(*)) + 0.15 * least(len(term), 6), 6) as weight from t where len(term) >= 2 group by 1""")
def term_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'").select(F.explode(text.tokens(F.col("text"))).alias("term"))
    g = rows.where(F.length("term") >= 2).groupBy("term").agg(F.count("*").alias("freq"))
    return g.withColumn("weight", F.round(F.log1p("freq") + 0.15 * F.least(F.length("term"), F.lit(6)), 6))


@query(f"""with n as (select distinct p_name as name, list_distinct(regexp_extract_all(lower(p_name), '{TOKEN}')) as t from part)
select a.name as title, b.name as other, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) as score from n a, n b where len(list_intersect(a.t, b.t)) > 0""")
def title_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Titles that share a token, by their tokens as sets. Each distinct title meets others through its tokens."""
    rows = table(spark, d, "part").select(F.col("p_name").alias("title")).distinct().withColumn("t", F.array_distinct(text.tokens(F.col("title"))))
    index = rows.select("title", "t", F.explode("t").alias("term"))
    met = index.join(index.toDF("other", "u", "term"), "term").select("title", "t", "other", "u").distinct()
    return met.select("title", "other", F.round(text.jaccard(F.col("t"), F.col("u")), 6).alias("score"))


@query("""with n as (select distinct p_name as name, p_name[1:1] as k from part)
select a.name as title, b.name as other, least(levenshtein(a.name, b.name), 6) as edits from n a join n b using (k)""")
def bounded_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits between titles of one first letter, up to five; six stands for more."""
    names = table(spark, d, "part").select(F.col("p_name").alias("title")).distinct().withColumn("k", F.substring("title", 1, 1))
    return names.join(names.toDF("other", "k"), "k").select("title", "other", text.bounded_edits(F.col("title"), F.col("other"), 5).cast("long").alias("edits"))


PRINTED = """s as (select request, string_agg('array([' || case when position = 2 then -item else item end || ', ' || (position / 8) || case when position % 2 = 0 then 'e-1' else '' end || '])', ', ' order by position) as t from imp group by 1)"""


@query(f"""with {IMP}, {PRINTED}, p as (select request, regexp_extract_all(t, 'array\\(\\[(-?\\d+), ([0-9.e-]+)\\]\\)', 1) as a, regexp_extract_all(t, 'array\\(\\[(-?\\d+), ([0-9.e-]+)\\]\\)', 2) as b from s),
x as (select request, generate_subscripts(a, 1) as i, cast(unnest(a) as bigint) as id, cast(unnest(b) as double) as score from p)
select request, id, round(score, 6) as score, place from (select *, row_number() over (partition by request order by i) as place from x where id >= 0) where place <= 3""")
def parsed_scored_lists(spark: SparkSession, d: str) -> DataFrame:
    """Printed lists of ids and scores; ids below 0 go before the first three are taken."""
    item = F.when(F.col("position") == 2, -F.col("item")).otherwise(F.col("item")).cast("string")
    score = F.concat((F.col("position") / 8).cast("string"), F.when(F.col("position") % 2 == 0, "e-1").otherwise(""))
    pair = F.concat(F.lit("array(["), item, F.lit(", "), score, F.lit("])"))
    g = impressions(spark, d).groupBy("request").agg(F.sort_array(F.collect_list(F.struct("position", pair.alias("p")))).alias("s"))
    found = g.select("request", F.posexplode(parsing.printed_scores(F.array_join("s.p", ", "), 3)).alias("at", "x"))
    return found.select("request", "x.id", F.round("x.score", 6).alias("score"), (F.col("at") + 1).cast("long").alias("place"))


@query(f"""with {BEH}, r as (select *, row_number() over (partition by user_id, scene, note, request order by ts desc, event_id desc) as r, count(*) over (partition by user_id, scene, note, request) as n from beh)
select user_id as "user", scene, note, request, event_id, n as n_events from r where r = 1""")
def behaviour_collapse(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.roles import behaviours
    from ..streaming.behaviour import collapsed

    return collapsed(behaviours(spark, d)).select("user", "scene", "note", "request", "event_id", "n_events")


@query(f"""with {BEH}, l as (select user_id as "user", note, max(ts) as ts, max(event_id) as e from beh where note is not null group by all),
r as (select *, row_number() over (partition by "user" order by ts desc, e desc) as r from l)
select "user", list(note order by r) as notes from r where r <= 50 group by 1""")
def history_front_list(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.roles import behaviours
    from ..streaming.behaviour import front_list

    return front_list(behaviours(spark, d), 50)


@query(f"""with recursive {BEH}, ev as (select event_id, user_id % 5 as u, scene, action, epoch_us(ts) // 100000 as us from beh),
nx as (select *, row_number() over (partition by u, scene, action order by us, event_id) as r from ev),
ok as (select * from nx where r = 1 union all
  select n.* from (select o.u, o.scene, o.action, min(m.r) as r from ok o join nx m on m.u = o.u and m.scene = o.scene and m.action = o.action and m.r > o.r and m.us - o.us >= 2000000 group by o.u, o.scene, o.action, o.r) f
  join nx n on n.u = f.u and n.scene = f.scene and n.action = f.action and n.r = f.r)
select event_id from ok""")
def behaviour_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events two seconds after the last accepted one of their key. Few users and a clock a hundred thousand times as fast bring repeats about."""
    from ..sources.roles import behaviours
    from ..streaming.behaviour import gap_deduplicated

    fast = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100000))
    rows = behaviours(spark, d).select("event_id", (F.col("user") % 5).alias("user"), "scene", "action", F.lit(1).alias("note"), F.lit(1).alias("request"), fast.alias("ts"))
    return gap_deduplicated(rows, 2).select("event_id")


@query(f"""with {BEH} select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H') as hour, scene, action, count(*) as n from beh group by all""")
def behaviour_windows(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.roles import behaviours
    from ..streaming.behaviour import windowed_counts

    rows = behaviours(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(rows, "1 hour").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "scene", "action", "n")


@query(f"""with {IMP}, i as (select item, count(*) as imp from imp group by 1), w as (select item, greatest(pow(imp + 1, 0.75), 1e-8) as w from i)
select item, round(w / sum(w) over (), 9) as p from w""")
def sampling_distribution(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.recall import sampling

    return sampling(impressions(spark, d).groupBy("item").agg(F.count("*").alias("imp"))).withColumn("p", F.round("p", 9))
