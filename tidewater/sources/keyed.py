"""Rows for key-value stores: one per key and field, with JSON values, and how to write them to any store."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fields(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """key ("prefix:id"), field, value. A value is JSON; fields that are null have no row, and neither have rows without a key."""
    named = [F.struct(F.lit(c).alias("field"), F.element_at(F.regexp_extract_all(F.to_json(F.struct(F.col(c).alias("v"))), F.lit(r"(?s)^\{\"v\":(.*)\}$"), F.lit(1)), 1).alias("value")) for c in df.columns if c != key]
    long = df.where(F.col(key).isNotNull()).select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("key"), *(F.when(F.col(c).isNotNull(), s).alias(f"_{i}") for i, (c, s) in enumerate(zip([c for c in df.columns if c != key], named))))
    rows = long.select("key", F.explode(F.array(*(f"_{i}" for i in range(len(named))))).alias("f")).where("f is not null")
    return rows.select("key", "f.field", "f.value")


def put(rows: DataFrame, connect: Callable[[], Callable[[Iterable[tuple[str, str, str]]], None]], size: int = 1000) -> None:
    """Writes key, field and value by size rows at a time. connect runs once in each task and returns what writes a list of rows; writes must bear
    repetition, since a lost task runs again."""

    def run(part: Iterable) -> None:
        write, held = None, []
        for r in part:
            held.append((r["key"], r["field"], r["value"]))
            if len(held) >= size:
                write = write or connect()
                write(held)
                held = []
        if held:
            (write or connect())(held)

    rows.select("key", "field", "value").foreachPartition(run)


def put_stream(rows: DataFrame, connect: Callable, checkpoint: str):
    """The same for a stream, batch by batch."""
    return rows.writeStream.foreachBatch(lambda batch, _: put(batch, connect)).option("checkpointLocation", checkpoint).start()
