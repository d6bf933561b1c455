"""User behaviour: the batch forms of the keyed state, and the streaming form of the window that drops repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import top_k

KEY = ["user", "scene", "action", "note", "request"]
# Flags of feedback, and how much is kept of a user's behaviours, history and exposures.
FLAGS = ["click", "like", "collect", "comment", "share"]
BEHAVIOURS, HISTORY, EXPOSED = 60, 50, 500


def with_repeat_key(events: DataFrame) -> tuple[DataFrame, list[str]]:
    """events with all that tells a repeat from another event: KEY, the first 80 characters of the query, the flags, and tenths of seconds on the page. Columns
    that events lack count as empty or 0; null notes and requests are values like others."""
    of = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in events.columns else F.lit(default)
    parts = {"_query": F.substring(of("query", "").cast("string"), 1, 80), "_tenths": F.floor(of("page_time", 0.0).cast("double") * 10).cast("long")}
    parts |= {f"_{c}": of(c, 0).cast("int") for c in FLAGS}
    return events.withColumns(parts), [*KEY, *parts]


def collapsed(events: DataFrame) -> DataFrame:
    """The latest event of each user, scene, note and request, with how many there were."""
    w = Window.partitionBy("user", "scene", "note", "request")
    n = events.withColumn("n_events", F.count("*").over(w))
    return top_k(n, ["user", "scene", "note", "request"], [F.desc("ts"), F.desc("event_id")], 1, "_r").drop("_r")


def overlaid(events: DataFrame, fields: list[str], keys: list[str], keep: int | None = None) -> DataFrame:
    """One row for each of keys: of each field the last value that an event has, the newest ts, and place, newest first, at most keep for each user."""
    stamp = F.struct("ts", "event_id")
    rows = events.groupBy(*keys).agg(F.max("ts").alias("ts"), F.max("event_id").alias("_e"), *(F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(c) for c in fields))
    return top_k(rows, "user", [F.desc("ts"), F.desc("_e"), *(F.asc_nulls_last(k) for k in keys if k != "user")], keep or 1 << 30, "place").drop("_e")


def upserted(events: DataFrame, keep: int = BEHAVIOURS) -> DataFrame:
    """The list of each user and scene: the latest event of each note, request and query, the newest in front, at most keep."""
    query = F.coalesce(F.col("query"), F.lit("")) if "query" in events.columns else F.lit("")
    order = [F.desc("ts"), F.desc("event_id")]
    latest = top_k(events.withColumn("_query", query), ["user", "scene", "note", "request", "_query"], order, 1, "_r").drop("_r", "_query")
    return top_k(latest, ["user", "scene"], order, keep, "place")


def keeps_history(action: str = "action") -> Column:
    """Whether an event goes into the history: a click, or an engagement with some feedback."""
    feedback = F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in FLAGS[1:])) > 0
    return (F.col(action) == "click") | ((F.col(action) == "engage") & feedback)


def deleted(events: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked: user, scene, note, and ts and request, which may be null for any. The events without the newest match of each, and the pairs (user, scene, note)
    of which no event that fits is left: they leave the history. What is asked is told apart by its own columns, which every reading of it gives alike; numbers of rows would not be."""
    fits = lambda c: F.col(f"a.{c}").isNull() | (F.col(f"a.{c}") == F.col(f"e.{c}"))
    same = F.expr("a.user = e.user and a.scene = e.scene and a.note = e.note")
    named = asked.withColumn("_ask", F.struct("user", "scene", "note", "ts", "request"))
    met = events.alias("e").join(named.alias("a"), same & fits("request")).select("a._ask", F.col("e.user").alias("user"), "e.scene", "e.note", "e.event_id", "e.ts", fits("ts").alias("_exact"))
    gone = top_k(met.where("_exact"), "_ask", [F.desc("ts"), F.desc("event_id")], 1, "_r").select("event_id", "_ask")
    rest = met.join(gone.select("event_id").distinct(), "event_id", "left_anti").select("_ask").distinct()
    out = met.join(gone.select("_ask"), "_ask", "left_semi").join(rest, "_ask", "left_anti").select("user", "scene", "note").distinct()
    return events.join(gone.select("event_id").distinct(), "event_id", "left_anti"), out


def runtime_ids(events: DataFrame, start: int, key: str = "scene") -> DataFrame:
    """events with id, which counts on from start for each key in order of time. Numbered by hours first, so no task orders all of a key."""
    hour = F.date_trunc("hour", F.col("ts"))
    rows = events.withColumn("_hour", hour)
    counts = rows.groupBy(key, "_hour").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_hour").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_hour").orderBy("ts", "event_id"))
    placed = rows.withColumn("_r", inside).join(counts.select(key, "_hour", before.alias("_before")), [key, "_hour"])
    return placed.withColumn("id", F.lit(start) + F.col("_before") + F.col("_r")).drop("_hour", "_r", "_before")


def front_list(events: DataFrame, keep: int, order: list[Column] | None = None) -> DataFrame:
    """Each user's distinct notes, the one seen last in front, at most keep."""
    last = events.where("note is not null").groupBy("user", "note").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    first = top_k(last, "user", order or [F.desc("last"), F.col("note")], keep, "r")
    return first.groupBy("user").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "note"))), lambda x: x["note"]).alias("notes"))


def gap_deduplicated(events: DataFrame, seconds: float) -> DataFrame:
    """The events accepted: of each repeat key the first, and each that comes at least seconds after the last accepted one.

    An event that long after the one before it is accepted whatever came earlier, so a key's events are cut there, and only the runs between
    cuts, in which events follow each other closely, are gone through in order.
    """
    rows, keys = with_repeat_key(events)
    gap = int(seconds * 1_000_000)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    timed = rows.withColumn("_us", micros).withColumn("_cut", F.coalesce((F.col("_us") - F.lag("_us").over(w) >= gap).cast("int"), F.lit(1)))
    runs = timed.withColumn("_run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    followers = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct("_us", "event_id"))).alias("_all")).where(F.size("_all") > 1)
    start = F.struct(F.lit(-(1 << 62)).cast("long").alias("last"), F.array().cast("array<bigint>").alias("ids"))

    def step(state: Column, x: Column) -> Column:
        fine = x["_us"] - state["last"] >= gap
        ids = F.when(fine, F.concat(state["ids"], F.array(x["event_id"].cast("long")))).otherwise(state["ids"])
        return F.struct(F.when(fine, x["_us"]).otherwise(state["last"]).alias("last"), ids.alias("ids"))

    kept = followers.select(F.explode(F.aggregate("_all", start, step)["ids"]).alias("event_id"))
    alone = runs.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_run")))
    close = alone.where("_n > 1").join(kept, "event_id", "left_semi")
    return alone.where("_n = 1").unionByName(close.select(alone.columns)).select(events.columns)


def accepted(events: DataFrame, seconds: float, watermark: str = "1 minute") -> DataFrame:
    """The streaming form: an event is accepted unless one of its key was accepted less than seconds before. events: KEY, event_id, ts (timestamp), and as far as
    there are, query, flags and page_time. Gives KEY, event_id and ts."""
    events, keys = with_repeat_key(events)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kept = []
        for i, ts in enumerate(rows["ts"]):
            if last is None or ts.timestamp() - last >= seconds:
                kept.append(i)
                last = ts.timestamp()
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[kept][[*KEY, "event_id", "ts"]]

    stamped = events.select(*keys, "event_id", "ts").withWatermark("ts", watermark)
    schema = "user long, scene string, action string, note long, request long, event_id long, ts timestamp"
    return stamped.groupBy(*keys).applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, length: str, watermark: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events of each scene and action in windows of length, one after the other or a slide apart, for a stream or a batch. Rows of a stream that are later than
    the watermark are dropped."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", length, slide), "scene", "action").agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str, watermark: str = "10 minutes") -> DataFrame:
    """Each user's sessions, which end when nothing comes for gap: window, user and events."""
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user").agg(F.count("*").alias("n"))


def front_lists(events: DataFrame, keep: int) -> DataFrame:
    """The streaming form of front_list: after each batch, the lists of the users that it touched. events: user, note, event_id, ts (timestamp).

    A user's state is its keep newest notes, so it does not grow. Run in update mode.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        notes, seen = state.get if state.exists else ([], [])
        last = dict(zip(notes, map(tuple, seen), strict=True))
        for b in batches:
            for note, ts, event in zip(b["note"], b["ts"], b["event_id"], strict=True):
                if not pd.isna(note):
                    last[int(note)] = max(last.get(int(note), (-(1 << 62), 0)), (int(ts.timestamp() * 1e6), int(event)))
        first = sorted(last, key=lambda n: ([-x for x in last[n]], n))[:keep]
        state.update((first, [list(last[n]) for n in first]))
        yield pd.DataFrame({"user": [key[0]], "notes": [first]})

    grouped = events.select("user", "note", "event_id", "ts").groupBy("user")
    return grouped.applyInPandasWithState(run, "user long, notes array<long>", "notes array<long>, seen array<array<long>>", "update", GroupStateTimeout.NoTimeout)
