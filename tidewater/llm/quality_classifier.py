"""Quality classifier: boosted trees over document statistics.

Statistics of whole texts are measured once and written; a bounded number of labelled rows trains the
forest on the driver (MAX_TRAINING rows, the smallest by the hash of their id); the forest, a few arrays,
scores all rows batch by batch. Only the text is an input of a score.

Rows are held out of training if crc32 of the id as text is divisible by 5.

Defined cases: null and empty texts have all-zero statistics and are scored like any other; labels that
are null, neither 0 nor 1, or of unknown documents are left out; with one class alone, or no labels, all
scores are the smoothed share of class 1 (0.5 without labels); repeated rows are scored each by itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Forest, fit
from .shared import ASCII_LOWER, WordHashes, arrow_mapped, table, window_hashes, written

MAX_TRAINING = 40_000
LEVEL = 0.3
_CLASSES = {
    "digit": b"0123456789",
    "upper": bytes(range(65, 91)),
    "mark": b".,;:?'\"()-",
    "exclaim": b"!",
    "symbol": b"#*$%&|<>",
    "other_symbol": b"@^_~`=+[]{}\\/",
    "other_bytes": bytes(range(128, 256)),
    "line": b"\n",
}
_MASKS = np.array([[b in of for b in range(256)] for of in _CLASSES.values()], dtype=np.int64)
_LOWER_LETTER, _LETTERS = re.compile(rb"[a-z]"), re.compile(rb"^[A-Za-z\x80-\xff]+[.,;:!?]?$")
NAMES = (
    [f"{k}_share" for k in _CLASSES]
    + ["log_bytes", "log_words", "log_lines", "mean_word", "sd_word", "longest_word", "short_words", "plain_words", "capital_words"]
    + ["distinct_words", "top_word", "distinct_pairs", "distinct_fives", "duplicate_lines", "words_a_line", "deflated"]
)


def statistics(text: str | None, known: WordHashes) -> np.ndarray:
    out = np.zeros(len(NAMES))
    data = (text or "").encode()
    words = data.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[: len(_CLASSES)] = _MASKS @ counts / len(data)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    hashes = known.of(data.translate(ASCII_LOWER).split())
    seen, times = np.unique(hashes, return_counts=True)
    distinct = lambda w: len(np.unique(window_hashes(hashes, w))) / (n - w + 1) if n >= w else 1.0
    plain = sum(1 for w in words if _LETTERS.match(w))
    out[len(_CLASSES) :] = [
        np.log1p(len(data)), np.log1p(n), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        (lengths <= 3).mean(), plain / n, sum(65 <= w[0] <= 90 for w in words) / n,
        len(seen) / n, times.max() / n, distinct(2), distinct(5), 1 - len(set(lines)) / len(lines), n / len(lines),
        len(zlib.compress(data, 1)) / len(data),
    ]
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array<double>) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        known = WordHashes()
        for batch in batches:
            yield [batch["doc_id"], [statistics(t, known) for t in batch["text"].to_pylist()]]

    return arrow_mapped(docs.select("doc_id", "text"), run, "doc_id long, stats array<double>")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, **how) -> Forest:
    """stats: of measured. labels: doc_id, label (0 or 1). The max_training rows of the smallest hashes reach the driver: each task would send as many, so
    rows are counted first, and those go whose hash is too large for them but once in a million million times."""
    known = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    known = known.where(~held_out()).withColumn("h", F.xxhash64("doc_id"))
    n = known.join(stats.select("doc_id"), "doc_id").count()
    share = (max_training + 7 * max_training**0.5 + 50) / max(n, 1)
    if share < 1:
        known = known.where(F.col("h") < int(share * 2**64) - 2**63)
    rows = stats.join(known, "doc_id").orderBy("h", "doc_id", "label").limit(max_training).select("stats", "label").toPandas()
    x = np.stack(rows["stats"].to_numpy()) if len(rows) else np.zeros((0, len(NAMES)))
    return fit(x, rows["label"].to_numpy(dtype=float), **how)


def scored(stats: DataFrame, forest: Forest, level: float = LEVEL) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            if len(batch):
                s = forest.score(batch["stats"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
                yield [batch["doc_id"], batch["held_out"], s, (s >= level).astype(np.int32)]

    rows = stats.select("doc_id", "stats", held_out().alias("held_out"))
    return arrow_mapped(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    stats = written(measured(docs), "statistics")
    return scored(stats, train(stats, labels, **how))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classify(table(spark, sf_dir, "documents"), labels)
