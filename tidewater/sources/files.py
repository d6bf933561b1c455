"""Parquet sinks that can be resumed, snapshots of metrics, and publishing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import finite


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _path(spark, path)
    return store.exists(where)


def stage_output(spark: SparkSession, path: str, build: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at path; if no finished write is there (or again), build() is written first. A broken write has no _SUCCESS and is replaced."""
    if again or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shards(df: DataFrame, key: str, path: str, n: int) -> None:
    """n sorted ranges of key, a file each; nearby keys are read from few files."""
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def published(spark: SparkSession, sources: dict[str, str], target: str) -> DataFrame:
    """Copies those tables that are there to target, on the file systems themselves. Returns name, source, copied."""
    rows = []
    for name, source in sources.items():
        there = exists(spark, source)
        if there:
            (a, fa), (b, fb) = _path(spark, source), _path(spark, f"{target}/{name}")
            fb.delete(b, True)
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, spark._jsc.hadoopConfiguration())
        rows.append((name, source, there))
    return spark.createDataFrame(rows, "name string, source string, copied boolean")


def metric_snapshot(metrics: DataFrame, path: str) -> None:
    """One JSON object a row; numbers that are null or not finite become 0."""
    numbers = [c for c, t in metrics.dtypes if t in ("double", "float")]
    metrics.withColumns({c: finite(F.col(c).cast("double")) for c in numbers}).write.mode("overwrite").json(path)


def metric_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What metric_snapshot wrote."""
    return spark.read.schema(schema).json(path)


def ranked_rows(spark: SparkSession, path: str, key: str, wanted: int, most: int, columns: list[str] | None = None, rank: tuple[str, ...] = ("rank",)) -> DataFrame:
    """The rows of one key, the first most by rank; the key's condition and the columns reach the scan."""
    rows = spark.read.parquet(path).where(F.col(key) == wanted)
    return (rows.select(*columns) if columns else rows).orderBy(*(F.asc_nulls_last(c) for c in rank)).limit(most)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The columns at path; no row is read."""
    return spark.read.parquet(path).columns


def request_key(columns: list[str]) -> str:
    """Which column names a request."""
    return next((c for c in ("request_idx", "search_idx") if c in columns), "session_idx")


def from_shards(shards: DataFrame, key: str, shard: str) -> DataFrame:
    """The row of the last shard that has the key. shard: a column that orders shards, as the name of a file does."""
    order = Window.partitionBy(key).orderBy(F.desc(shard))
    return shards.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def matrix(rows: DataFrame, key: str, vector: str, size: int, order: list[str]) -> DataFrame:
    """key and vector of the first row of each key by order, cut or filled with zeros to size numbers."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1")
    zeros = F.array_repeat(F.lit(0.0), size)
    return first.select(key, F.slice(F.concat(F.col(vector).cast("array<double>"), zeros), 1, size).alias(vector))


def vocabulary_json(codes: DataFrame) -> DataFrame:
    """One row: value and code of a vocabulary, a bounded table, as a JSON object."""
    return codes.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "code"))))).alias("vocabulary"))


def image_path(path: Column) -> Column:
    """A path below the folder of images: no blanks, leading slashes or folder name; null for one that leads out of the folder."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), "^/+", ""), "^image/", "")
    return F.when((clean != "") & ~clean.rlike(r"(^|/)\.\.(/|$)"), clean)


def existing_images(rows: DataFrame, key: str, paths: str, files: DataFrame) -> DataFrame:
    """rows with the images of paths (array) that files (path) has, in order. key tells rows apart."""
    each = rows.select(key, F.posexplode(paths).alias("_at", "_p")).select(key, "_at", image_path(F.col("_p")).alias("path")).where("path is not null")
    found = each.join(files.select("path").distinct(), "path", "left_semi")
    lists = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "path"))), lambda x: x["path"]).alias("images"))
    return rows.join(lists, key, "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def shown_items(items: DataFrame, title: str, images: str) -> DataFrame:
    """Items with a title and at least one image."""
    return items.where((F.coalesce(F.col(title), F.lit("")) != "") & (F.coalesce(F.col(images), F.lit(0)) > 0))


def coverage(items: DataFrame, images: str) -> DataFrame:
    """One row: items and the share that has an image."""
    return items.agg(F.count("*").alias("n_items"), F.avg((F.coalesce(F.col(images), F.lit(0)) > 0).cast("double")).alias("with_image"))


def listed_users(catalogue: DataFrame, limit: int = 20, offset: int = 0, seed: int | None = None) -> DataFrame:
    """A page of users (user, n_requests) with most requests first, or with a seed a random sample that is always the same; 1 to 200 of them."""
    n = max(1, min(200, limit))
    if seed is not None:
        return catalogue.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("user").cast("string"))), "user").limit(n)
    return catalogue.orderBy(F.desc("n_requests"), "user").offset(max(0, offset)).limit(n)
