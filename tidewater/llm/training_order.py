"""Training-order materialisation: fixed-stride shards of token ids in a keyed random order.

Documents are encoded, closed by an id and cut into sequences of at most CONTEXT ids, whose number within
their task is written with them; a sum over tasks makes these numbers dense. A Feistel network, keyed and
cycle-walked to the number of sequences, permutes them: a sequence's slot is known without sorting or
storing an order, and any slot's sequence can be found by the inverse. Slots are dealt by range to
shards; a shard is a file in which row r starts at byte r times the stride, padded with the closing
id, so reading goes on from any slot with one seek.

Slots are dealt in PASSES ranges, one after the other, so that only a part of all sequences is in a shuffle
at a time, and what a range's shuffle leaves on disk goes before the next one. A task writes several shards, one
after the other, where there are more than MAX_TASKS in a range.

A shard is written under a name of its own and then renamed, and a shard that is there already is left
as it is: repeated and speculative tasks give the same files, and a run that broke off goes on. A mark in the
folder says of which sequences, in which order, its shards are; a folder of other shards is refused, or emptied
first with replace.

Defined cases: null and empty texts give one sequence of the closing id alone; repeated rows give
sequences each; an empty table gives no shards; shards of other documents, another key or other sizes in the
folder are an error.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import END_ID, cut
from .shared import arrow_mapped, dropped, mixed, shared_folder, shuffles_deleted, table, turned, written
from .tokens import encoder, public_vocabulary

CONTEXT = 512
SHARD_ROWS = 8192
ROUNDS = 6
KEY = 20240229
PASSES = 6
MAX_TASKS = 4096
MARK = "_order.json"
BITS = 36
#: How an id is stored. The public vocabularies have fewer than 65,536 ids.
ID = np.dtype("<u2")


def permuted(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slot of each index below n, or with inverse the index of each slot."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [mixed(np.array([key * ROUNDS + r], np.uint64))[0] for r in range(ROUNDS)]
    out = np.array(index, dtype=np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (mixed(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mixed(right ^ k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, vocabulary=None, context: int = CONTEXT) -> DataFrame:
    """item, doc_id, piece, length, ids_crc32 and ids (compressed) of every sequence of docs (doc_id, text)."""
    how = vocabulary or public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        enc, press = encoder(*how), zstandard.ZstdCompressor(level=3)
        item = TaskContext.get().partitionId() << BITS
        for batch in batches:
            rows = []
            for at, text in enumerate(batch["text"].to_pylist()):
                ids = np.append(enc.ids(text), np.uint32(END_ID)).astype("<u4")
                if ids.max() > np.iinfo(ID).max:
                    raise ValueError(f"id {ids.max()} does not fit in {ID.itemsize} bytes")
                for k, (start, n) in enumerate(cut(len(ids), context)):
                    data = ids[start : start + n].tobytes()
                    rows.append((item, at, k, n, zlib.crc32(data), press.compress(ids[start : start + n].astype(ID).tobytes())))
                    item += 1
            items, places, *others = turned(rows, 6)
            yield [items, batch["doc_id"].take(pa.array(places, pa.int64())), *others]

    return arrow_mapped(docs.select("doc_id", "text"), run, "item long, doc_id long, piece int, length long, ids_crc32 long, ids binary")


def numbered(items: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """items (a written table) with a slot each, and their number. One row per task of sequences() is summed in order."""
    part = F.shiftright("item", BITS)
    sums = items.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(sums.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    n = bases.agg(F.sum("n")).first()[0] or 0
    # the bases are broadcast: one row of two numbers for each task of sequences()
    dense = items.withColumn("part", part).join(F.broadcast(bases.select("part", "base")), "part").withColumn(
        "index", F.col("base") + F.col("item").bitwiseAND(F.lit((1 << BITS) - 1))
    )

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), n, key))

    # as one that may vary, it is computed once a row, not once more in a filter
    return dense.withColumn("slot", slot.asNondeterministic()("index")).drop("part", "base", "item", "index"), n


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path there. Spark's names for S3 are known too."""
    for spark_name in ("s3a://", "s3n://"):
        if folder.startswith(spark_name):
            folder = "s3://" + folder[len(spark_name) :]
    return fs.FileSystem.from_uri(folder)


def claim(folder: str, mark: dict, replace: bool = False) -> None:
    """Marks folder as that of mark's shards, or raises an error if it holds others; with replace these go."""
    store, root = store_of(folder)
    path = f"{root}/{MARK}"
    there = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    if any(f.base_name == MARK for f in there):
        with store.open_input_file(path) as f:
            if json.loads(f.read()) == mark:
                return
    if there:
        if not replace:
            raise FileExistsError(f"{folder} holds other files; name another folder, or replace them")
        store.delete_dir_contents(root)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(path) as f:
        f.write(json.dumps(mark).encode())


def materialise(ordered: DataFrame, n: int, folder: str, context: int = CONTEXT, shard_rows: int = SHARD_ROWS, passes: int = PASSES) -> DataFrame:
    """Writes ordered (with slots below n) as shards to folder. Returns where each sequence went, a written table for each pass."""
    shards = max(1, -(-n // shard_rows))
    each, done = -(-shards // passes), None
    for first in range(0, shards, each):
        with shuffles_deleted(ordered.sparkSession):
            part = written(_shards(ordered, first, min(each, shards - first), folder, context, shard_rows), "manifest")
        done = part if done is None else done.unionByName(part)
    return done


def _shards(ordered: DataFrame, first: int, n: int, folder: str, context: int, shard_rows: int, max_tasks: int = MAX_TASKS) -> DataFrame:
    """Writes n shards from the first on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        store, root = store_of(folder)
        unpress = zstandard.ZstdDecompressor()
        shard, out, temporary = None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temporary, shard_path(root, shard))

        store.create_dir(root, recursive=True)
        for batch in batches:
            for at, ids in zip(batch["shard"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if at != shard:
                    close()
                    shard, out = at, None
                    if store.get_file_info(shard_path(root, shard)).type == fs.FileType.NotFound:
                        temporary = f"{root}/.{shard:08d}-{uuid.uuid4().hex}"
                        out = store.open_output_stream(temporary)
                if out is not None:
                    row = np.full(context, END_ID, ID)
                    found = np.frombuffer(unpress.decompress(ids), ID)
                    row[: len(found)] = found
                    out.write(row.tobytes())
            rows = batch["slot"].to_numpy() % shard_rows
            yield [batch["doc_id"], batch["piece"], batch["slot"], batch["shard"], rows, rows * context * ID.itemsize, batch["length"], batch["ids_crc32"]]
        close()

    slots = ordered.withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("int")).where((F.col("shard") >= first) & (F.col("shard") < first + n))
    each = -(-n // max_tasks)
    ranged = slots.repartitionById(-(-n // each), F.floor((F.col("shard") - first) / each).cast("int")).sortWithinPartitions("slot")
    return arrow_mapped(ranged, run, "doc_id long, piece int, slot long, shard int, row long, byte_offset long, length long, ids_crc32 long")


def read(folder: str, slot: int, n: int, context: int = CONTEXT, shard_rows: int = SHARD_ROWS) -> Iterator[np.ndarray]:
    """The ids (padded) of n sequences from slot on, as far as there are shards."""
    store, root = store_of(folder)
    stride = context * ID.itemsize
    while n > 0:
        path = shard_path(root, slot // shard_rows)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return
        with store.open_input_file(path) as f:
            f.seek(slot % shard_rows * stride)
            data = f.read(min(n, shard_rows - slot % shard_rows) * stride)
        for at in range(0, len(data), stride):
            yield np.frombuffer(data[at : at + stride], ID)
        done = len(data) // stride
        if not done:
            return
        slot, n = slot + done, n - done


def training_order(
    docs: DataFrame, folder: str, vocabulary=None, key: int = KEY, context: int = CONTEXT, shard_rows: int = SHARD_ROWS, replace: bool = False
) -> DataFrame:
    """Writes docs (doc_id, text) as shards to folder. Returns where each sequence went."""
    items = written(sequences(docs, vocabulary, context), "sequences")
    ordered, n = numbered(items, key)
    content = items.agg(F.sum(F.xxhash64("item", "doc_id", "piece", "ids_crc32").cast("decimal(38,0)"))).first()[0]
    claim(folder, {"sequences": n, "content": str(content), "key": key, "context": context, "shard_rows": shard_rows}, replace)
    out = materialise(ordered, n, folder, context, shard_rows)
    dropped(items)
    return out


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tidewater/shards-{uuid.uuid4().hex}"
    return training_order(table(spark, sf_dir, "documents"), folder)
