"""Reading the texts of some documents without shuffling the texts of all.

A Bloom filter of the wanted ids, a bitmap of at most 2 * MAX_IDS bytes, goes to the tasks that read
the documents; these measure what passes it. A few other documents pass too, so what is returned is joined
exactly, with the wanted ids, by whoever uses it. Beyond MAX_IDS wanted documents no filter is made: they are
joined with the documents by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mixed

MAX_IDS = 1 << 22
BITS_PER_ID, HASHES = 16, 4


def _bits(ids: np.ndarray, size: int) -> list[np.ndarray]:
    return [mixed(ids.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D * (i + 1) % (1 << 64))) % np.uint64(size) for i in range(HASHES)]


def bitmap(ids: DataFrame, n: int) -> np.ndarray:
    """The filter of the n ids in the column id, as 64-bit words."""
    size = max(1024, 1 << (BITS_PER_ID * n - 1).bit_length())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.concatenate(_bits(batch["id"].to_numpy(), size))
            mask = np.left_shift(np.uint64(1), bits % np.uint64(64)).view(np.int64)
            yield pd.DataFrame({"word": (bits // np.uint64(64)).astype(np.int64), "mask": mask})

    out = np.zeros(size // 64, np.uint64)
    for word, mask in ids.select("id").mapInPandas(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask")).toLocalIterator():
        out[word] = np.uint64(mask % (1 << 64))
    return out


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    fine = np.ones(len(ids), bool)
    for bits in _bits(ids, len(words) * 64):
        fine &= (words[(bits // np.uint64(64)).astype(np.int64)] >> (bits % np.uint64(64)) & np.uint64(1)).astype(bool)
    return fine


def measured_of(docs: DataFrame, ids: DataFrame, measure: Callable[[pd.DataFrame], pd.DataFrame], schema: str, max_ids: int = MAX_IDS) -> DataFrame:
    """measure(rows of doc_id and text) of the documents whose id is among ids (a written table, column id), and perhaps of a few others."""
    held = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    n = ids.count()
    if n > max_ids:
        held, shared = held.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), None
    else:
        shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if shared is not None:
                batch = batch[passes(shared.value, batch["doc_id"].to_numpy())]
            if len(batch):
                yield measure(batch)

    return held.mapInPandas(run, schema)
