"""Query understanding over the user turns of conversations, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from ..operators.relational import top_k
from ..sources.roles import table
from .features import TOKEN, query


def distinct_list(expr: str) -> str:
    """SQL of a list whose repeats are gone, in order."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def seeds(q: str) -> str:
    parts = f"flatten(list_transform(regexp_extract_all({q}, '{TOKEN}'), lambda c: case when regexp_full_match(c, '[\\x{{4e00}}-\\x{{9fff}}]{{{{4,}}}}') then [c, c[1:2], c[-2:]] else [c] end))".replace("{{4,}}", "{4,}")
    return distinct_list(f"list_filter(list_concat({parts}, [replace({q}, ' ', '')]), lambda t: t <> '')")


def nq(q: str) -> str:
    """SQL of a normalised query."""
    q = f"lower(trim(regexp_replace(coalesce({q}, ''), '[\\x00-\\x1f\\x7f]', ' ', 'g')))"
    for a, b in (*text.ALIASES.items(),):
        q = f"replace({q}, '{a}', '{b}')"
    q = f"translate({q}, '{''.join(text.CHARACTERS)}', '{''.join(text.CHARACTERS.values())}')"
    for a, b in text.TIMES.items():
        q = f"replace({q}, '{a}', '{b}')"
    for _ in range(2):  # the digit between two commas belongs to both
        q = f"regexp_replace({q}, '(\\d),(\\d)', '\\1\\2', 'g')"
    for words, unit in text.UNITS:
        q = f"regexp_replace({q}, '(\\d+(?:\\.\\d+)?)\\s*(?:{words})', '\\1{unit}', 'g')"
    noise = text.NOISE.replace("'", "''")
    return f"rtrim(substr(trim(regexp_replace(regexp_replace({q}, '{noise}', ' ', 'g'), '\\s+', ' ', 'g')), 1, 100))"


def pairs(s: str) -> str:
    return f"case when len({s}) = 0 then [] when len({s}) <= 2 then [{s}] else list_distinct(list_transform(range(1, len({s})), lambda j: substr({s}, j, 2))) end"


def sets(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / greatest(1, len(list_distinct(list_concat({a}, {b}))))"


UQ = f"""uq as (select conv_id, turn, {nq('text')} as q from conversations where role = 'user'),
sq as (select conv_id, turn, q, array_to_string(string_split(q, ' ')[1:3], ' ') as query from uq),
cat as (select query, count(*) as n from sq where query <> '' group by 1)"""
TERM = f"""{UQ}, tf as (select term, sum(n) as freq from (select n, unnest({seeds('query')}) as term from cat) where len(term) >= 2 group by 1 having sum(n) >= 2 and not (sum(n) >= 200 and len(term) <= 2)),
bk as (select *, case when regexp_full_match(term, '[a-z0-9]+') then term[1:2] else term[1:1] end as bucket from tf),
br as (select *, row_number() over (partition by bucket order by freq desc, len(term) desc, term) as rank from bk)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """User turns: conv_id, turn, q (the normalised text), query (its first three words)."""
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", text.normalized(F.col("text")).alias("q"))
    return rows.withColumn("query", F.substring_index("q", " ", 3))


def counted(spark: SparkSession, d: str) -> DataFrame:
    return search.catalogue(turns(spark, d))


@query(f"with {UQ} select conv_id, turn, {seeds('q')} as terms from uq")
def query_seed_terms(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "turn", text.seed_terms(F.col("q")).alias("terms"))


@query(f"with {UQ} select query, n from cat")
def query_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d)


@query(f"with {TERM} select bucket, rank, term, cast(freq as bigint) as freq from br")
def term_buckets(spark: SparkSession, d: str) -> DataFrame:
    return search.buckets(search.term_scores(counted(spark, d))).select("bucket", "rank", "term", "freq")


MISSPELT = "ty as (select distinct query[1:3] || query[5:] as query from cat where len(query) >= 8)"


@query(f"""with {TERM}, {MISSPELT}, un as (select query, case when regexp_full_match(query, '[a-z0-9]+') then query[1:2] else query[1:1] end as bucket from ty where len(query) >= 3 and query not in (select query from cat)),
hd as (select query as candidate, row_number() over (order by n desc, len(query) desc, query) as place from cat qualify place <= 120),
po as (select un.query, br.term as candidate, 0 as part, br.rank as place from un join br using (bucket) union all select un.query, hd.candidate, 1, hd.place from un, hd),
fi as (select query, candidate, min(part * 1000000 + place) as pos from po where not regexp_full_match(query, '[a-z0-9]+') or regexp_full_match(candidate, '[\\x00-\\x7f]*') group by 1, 2),
ke as (select * from fi qualify row_number() over (partition by query order by pos, candidate) <= 180),
ed as (select *, levenshtein(query, candidate) as edits from ke where abs(len(query) - len(candidate)) <= 2),
sc as (select ed.*, 1.1 * {sets(seeds('ed.query'), seeds('ed.candidate'))} + 0.6 * {sets("list_distinct(string_split(ed.query, ''))", "list_distinct(string_split(ed.candidate, ''))")}
  + case when starts_with(candidate, ed.query) or starts_with(ed.query, candidate) then 0.1 else 0 end + 0.05 * ln(1 + coalesce(n, 0)) - 0.45 * edits as score
  from ed left join cat on cat.query = ed.candidate where edits <= case when len(ed.query) <= 6 then 1 else 2 end),
be as (select * from sc qualify row_number() over (partition by query order by round(score, 9) desc, pos, candidate) = 1)
select query, candidate as corrected, round(score, 6) as score from be where round(score, 9) >= 1.1""".replace("\\\\x", "\\x"))
def query_corrections(spark: SparkSession, d: str) -> DataFrame:
    c = counted(spark, d)
    typed = c.where(F.length("query") >= 8).select(F.concat(F.substring("query", 1, 3), F.expr("substr(query, 5)")).alias("query")).distinct()
    return search.corrected_queries(typed, c, search.term_scores(c)).withColumn("score", F.round("score", 6))


@query()
def segmented_queries(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's queries without their spaces, cut again by its terms. Dynamic programming has no SQL; tests hold it against brute force."""
    c = counted(spark, d)
    chunks = c.select(F.replace("query", F.lit(" "), F.lit("")).alias("chunk")).where("chunk <> ''").distinct()
    return search.segmented(chunks, search.term_scores(c))


@query(f"""with {UQ}, la as (select conv_id, max(turn) as turn from sq group by 1), a as (select sq.conv_id, sq.turn, query as asked from sq join la using (conv_id, turn)),
p as (select a.conv_id, a.asked, sq.turn as request, sq.q as target from a join sq on a.conv_id = sq.conv_id and sq.turn < a.turn),
s as (select *, case when asked = '' then 0 else case when contains(target, asked) then 4 else 0 end + 2.5 * len(list_intersect({pairs('asked')}, {pairs('target')})) / greatest(1, len({pairs('asked')})) end
  + 1.05 * len(list_intersect({seeds('asked')}, {seeds('target')})) / greatest(1, len({seeds('asked')})) as score from p)
select conv_id, asked, request, round(score, 6) as score from s qualify row_number() over (partition by conv_id, asked order by round(score, 9) desc, request) = 1""")
def matched_requests(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    last = top_k(t, "conv_id", [F.desc("turn")], 1).select(F.col("conv_id").alias("user"), F.col("turn").alias("at"), "query")
    past = t.select(F.col("conv_id").alias("user"), F.col("turn").alias("request"), F.col("q").alias("target"))
    earlier = past.join(last.select("user", "at"), "user").where("request < at").drop("at")
    found = search.best_requests(last.select("user", "query"), earlier)
    return found.select(F.col("user").alias("conv_id"), F.col("query").alias("asked"), "request", F.round("score", 6).alias("score"))
