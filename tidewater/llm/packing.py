"""Best-fit packing by hierarchical residual packing.

pieces() encodes documents and cuts the long ones; only lengths and checksums are kept. pack() deals
the pieces to groups of about GROUP items, packs each group by best fit in order of falling length,
lets nearly full bins go as sequences, and merges the other bins of several groups as items of the next
round, until one group is left or fewer than two bins wait. Bins so full that not even the emptiest bin fits
beside them go early; where that leaves nearly as many as before, only bins at most half full go on: a group
leaves one of these at most, so the rounds end soon and never for want of progress. Bins are numbered by round, group and place, so no numbers are handed out
centrally, and every round is written, so a lost executor repeats a round at most.

Memory: a group's items and capacity + 1 stacks, whatever the number of documents. Groups are dealt by
an item number that is written with the pieces, so copies, repeated ids and hot sources spread evenly,
and a repeated task packs alike.

Defined cases: null and empty texts give one piece of one token (the closing id 0); repeated rows are
packed each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_mapped, table, turned, written
from .tokens import encoder, public_vocabulary

CAPACITY = 2048
GROUP = 32_768
NEARLY_FULL = 0.99
END_ID = 0
PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all have capacity tokens, but for a shorter first."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, first if s == 0 and first else capacity) for s in starts]


def pieces(docs: DataFrame, vocabulary=None, capacity: int = CAPACITY) -> DataFrame:
    """docs: doc_id, text. One row for each piece, with a number (item) that differs from row to row."""
    how = vocabulary or public_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        enc = encoder(*how)
        item = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for at, text in enumerate(batch["text"].to_pylist()):
                ids = np.append(enc.ids(text), np.uint32(END_ID)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((item, at, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                    item += 1
            items, places, *others = turned(rows, 6)
            yield [items, batch["doc_id"].take(pa.array(places, pa.int64())), *others]

    return arrow_mapped(docs.select("doc_id", "text"), encode, PIECES)


def best_fit(lengths, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For each length, in the order given: its bin and its place there; how full each bin is.

    Bins stand in stacks by the room they have left; a bit for each stack that is not empty finds the
    smallest room that is large enough in a few machine words.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, offsets, fills = 0, [], [], []
    for n in lengths:
        at = rooms >> n
        if at:
            room = n + (at & -at).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += n
        if room > n:
            stacks[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, fills


def _round(items: DataFrame, level: int, groups: int, capacity: int) -> DataFrame:
    """items: item, length. Adds bin, offset and fill (of the bin)."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        bins, offsets, fills = best_fit(rows["length"].tolist(), capacity)
        bins = np.array(bins, dtype=np.int64)
        first = (level << 58) | (int(rows["part"].iloc[0]) << 24)
        return pd.DataFrame(
            {"item": rows["item"].to_numpy(), "bin": first + bins, "offset": np.array(offsets, np.int64), "fill": np.array(fills, np.int64)[bins]}
        )

    part = F.pmod(F.xxhash64(F.col("item"), F.lit(level)), F.lit(groups)).alias("part")
    return items.select("item", "length", part).groupBy("part").applyInPandas(pack, "item long, bin long, offset long, fill long")


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """items: item (unique) and length (1 to capacity), a written table. Returns item, sequence_id and offset."""
    whole = items.where(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity)
    n = rest.count()
    level, waiting, rounds = 1, rest, []
    while n:
        groups = -(-n // group)
        done = written(_round(waiting, level, groups, capacity), f"packing-{level}")
        rounds.append(done)
        open_bins = done.where((F.col("offset") == 0) & (F.col("fill") < int(nearly_full * capacity)))
        least = open_bins.agg(F.min("fill")).first()[0]
        if groups == 1 or least is None:
            break
        waiting = open_bins.where(F.col("fill") <= capacity - least).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        m = waiting.count()
        if m > 0.99 * n:  # few fit beside each other: from here on, the bins of which any two do
            waiting = waiting.where(F.col("length") <= capacity // 2)
            m = waiting.count()
        if m < 2:
            break
        n, level = m, level + 1
    if not rounds:
        return whole
    out = rounds[0].select("item", F.col("bin").alias("sequence_id"), "offset")
    for done in rounds[1:]:
        up = done.select(F.col("item").alias("sequence_id"), "bin", F.col("offset").alias("by"))
        out = out.join(up, "sequence_id", "left").select(
            "item", F.coalesce("bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")
        )
    return out.unionByName(whole)


def packed(docs: DataFrame, vocabulary=None, capacity: int = CAPACITY, **sizes) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs."""
    cuts = written(pieces(docs, vocabulary, capacity), "pieces")
    return cuts.join(pack(cuts.select("item", "length"), capacity, **sizes), "item").drop("item")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
