"""Training exports, a trainable ranker, negative sampling and the offline stages as one run."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import finite
from ..operators import training
from ..operators.relational import top_k, valid_groups
from ..sources import files
from ..sources.roles import IMP, REQ, impressions, requests
from .features import LAB, features_wide, labelled, query
from .ranking import graph, hard_negatives, prerank, swing_index, usercf_index

FEATURES = ("position", "ctr", "like_rate", "collect_rate")


def ranker_scores(rows: DataFrame, train: DataFrame, label: str, columns: Iterable[str] = FEATURES, max_training: int = 200_000, seed: int = 42) -> DataFrame:
    """rows with gbdt, the prediction of boosted trees fitted on train: at most about max_training of its rows, whole requests by their hash.

    Missing and non-finite features count as 0.
    """
    names = list(columns)
    clean = lambda df: df.withColumns({c: finite(F.col(c).cast("double")) for c in names})
    n = train.count()
    keep = train.where(F.pmod(F.xxhash64("request"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_training / max(n, 1))))
    pack = VectorAssembler(inputCols=names, outputCol="_x")
    model = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="gbdt", maxIter=10, maxDepth=4, seed=seed).fit(pack.transform(clean(keep)).withColumn(label, F.col(label).cast("double")))
    return model.transform(pack.transform(clean(rows))).drop("_x")


@query()
def gbdt_scores(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees fitted on the training requests score every impression. Learned, so there is no SQL; tests hold it against the labels' mean."""
    rows = features_wide(spark, d)
    train = rows.join(training.group_split(requests(spark, d), "request").where("not validation").select("request"), "request")
    return ranker_scores(rows, train, "y_multi").select("request", "item", F.round("gbdt", 6).alias("gbdt"))


@query(f"""with {IMP}, {LAB}, r as (select *, row_number() over (partition by request order by page_time desc, item) as rk from lab),
k as (select * from r where rk <= 2 or click > 0), v as (select *, count(*) over (partition by request) as n, max(y) over (partition by request) as m from k)
select request, item, rk as rank, round(y, 6) as y from v where n > 1 and m > 0""")
def training_export(spark: SparkSession, d: str) -> DataFrame:
    ranked = top_k(labelled(spark, d), "request", [F.desc("page_time"), F.col("item")], 1 << 30)
    kept = ranked.where((F.col("rank") <= 2) | (F.col("click") > 0))
    return valid_groups(kept, "request", "y").select("request", "item", "rank", F.round("y", 6).alias("y"))


@query(f"""with {IMP}, {REQ}, c as (select item, pow(count(*) + 1, 0.75) as w from imp group by 1), q as (select item, sum(w) over (order by item) / sum(w) over () as hi, w / sum(w) over () as p from c),
u as (select request, k, (('0x' || substr(md5('42|' || request || '|' || k), 1, 8))::bigint) / 4294967296.0 as x from req, (select unnest(range(2)) as k))
select request, k, arg_min(item, hi) as item from u join q on x < round(hi, 12) and x >= round(hi, 12) - p - 1e-9 group by 1, 2""")
def popular_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Two items for each request, drawn in proportion to their impressions to the power 0.75, by the inverse of the distribution."""
    items = impressions(spark, d).groupBy("item").agg(F.pow(F.count("*") + 1.0, F.lit(0.75)).alias("w"))
    draws = requests(spark, d).select("request", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k"))
    x = F.conv(F.substring(training.order_hash(F.concat_ws("|", "request", "k")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return training.drawn(draws.withColumn("x", x), items).select("request", F.col("k").cast("long").alias("k"), "item")


#: The offline stages in order. Each writes one table; stages that are written already are read.
STAGES: list[tuple[str, Callable[[SparkSession, str], DataFrame]]] = [
    ("features", features_wide), ("graph", graph), ("swing", swing_index), ("usercf", usercf_index), ("hard_negatives", hard_negatives), ("prerank", prerank),
    ("training", training_export),
]


def run(spark: SparkSession, sf_dir: str, folder: str, only: Iterable[str] | None = None, again: bool = False) -> dict[str, DataFrame]:
    """The stages (or only those named), each written to folder/name unless a finished table is there."""
    names = set(only) if only is not None else {n for n, _ in STAGES}
    unknown = names - {n for n, _ in STAGES}
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}")
    return {n: files.stage_output(spark, f"{folder}/{n}", lambda f=f: f(spark, sf_dir), again) for n, f in STAGES if n in names}
