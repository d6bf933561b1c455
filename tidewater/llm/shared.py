"""What the operators share: words and hashes, and the written tables of all Tidewater."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import arrow_mapped, dropped, made_tables, removed, shared_folder, shuffles_deleted, written  # noqa: F401 (the operators take them from here)

#: Lower-cases A-Z in UTF-8 bytes; other letters stay.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The white space that parts words; bytes.split() parts at the same six characters.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def turned(rows: list[tuple], width: int) -> list[list]:
    """The columns of rows, width of them also where there are no rows."""
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(width)]


def words_column(text: Column | str) -> Column:
    """The words of a text as an array, by SQL functions alone; null gives no words."""
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def bound(value: Column, body) -> Column:
    """body(value), with value computed once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """64-bit hashes of words as bytes, kept between texts; emptied when it grows beyond its limit."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of width words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * step + hashes[i : i + n]
        return mixed(out)
