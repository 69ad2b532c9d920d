"""Coalescing of change events: a batch fold and its streaming twin.

Events of a path are merged while they follow each other within a delay: the debounce, or the
grace while the merged event is a delete. When a path has been quiet for so long, one event is
emitted, at the time at which its timer runs out. Times are event times; in a stream, events
beyond the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CREATE, MODIFY, DELETE = "create", "modify", "delete"


def fs_event(op: Column) -> Column:
    """File system operations as event types; others, such as mode changes, are null."""
    o = F.lower(op)
    return F.when(o.isin("remove", "rename"), DELETE).when(o == "create", CREATE).when(o == "write", MODIFY)


def merged(before: str | None, new: str) -> str | None:
    """The type of two events in a row; None if they cancel out."""
    if before == CREATE and new == MODIFY:
        return CREATE
    if before == CREATE and new == DELETE:
        return None
    if before == DELETE and new == CREATE:
        return MODIFY
    return new


def _merged(before: Column, new: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.when((before == CREATE) & (new == MODIFY), F.lit(CREATE)).when((before == CREATE) & (new == DELETE), none).when((before == DELETE) & (new == CREATE), F.lit(MODIFY)).otherwise(new)


def fold(events: list[tuple[int, str]], debounce: int, grace: int, state: tuple[str | None, int] = (None, 0)) -> tuple[list[tuple[str, int]], tuple[str | None, int]]:
    """(emitted (type, time), state after) of one path's events in order; times are whole numbers."""
    kind, last = state
    out = []
    for ts, new in events:
        ts = max(ts, last) if kind else ts
        if kind and ts - last >= (grace if kind == DELETE else debounce):
            out.append((kind, last + (grace if kind == DELETE else debounce)))
            kind = None
        kind, last = merged(kind, new), ts
    return out, (kind, last)


def coalesce_batch(events: DataFrame, debounce_us: int, grace_us: int, path_col: str = "path", ts_col: str = "ts", type_col: str = "type", id_col: str = "event_id") -> DataFrame:
    """(path, type, due, n): the events that a stream would have emitted in the end; due in microseconds.

    A gap as long as either delay always ends a run, so each path is cut into runs by one window,
    and each run is folded by itself. Equal times stand in the order of id.
    """
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    own = events.select(F.col(path_col).alias("path"), us.alias("ts"), F.col(id_col).alias("id"), F.col(type_col).alias("type")).where("type is not null and ts is not null")
    order = Window.partitionBy("path").orderBy("ts", "id")
    apart = F.coalesce(F.col("ts") - F.lag("ts").over(order) >= max(debounce_us, grace_us), F.lit(True)).cast("long")
    runs = own.withColumn("__new", apart).withColumn("run", F.sum("__new").over(order))
    grouped = runs.groupBy("path", "run").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "type"))).alias("events"))
    none, emitted = F.lit(None).cast("string"), "array<struct<type:string,due:long,n:int>>"
    start = F.struct(none.alias("kind"), F.lit(0).cast("long").alias("last"), F.lit(0).alias("n"), F.array().cast(emitted).alias("out"))
    delay = lambda kind: F.when(kind == DELETE, F.lit(grace_us)).otherwise(F.lit(debounce_us)).cast("long")
    event = lambda a: F.array(F.struct(a["kind"].alias("type"), (a["last"] + delay(a["kind"])).alias("due"), a["n"].alias("n")))

    def step(a: Column, e: Column) -> Column:
        over = a["kind"].isNotNull() & (e["ts"] - a["last"] >= delay(a["kind"]))
        kind = F.when(~over, a["kind"])
        new = F.when(kind.isNull(), e["type"]).otherwise(_merged(kind, e["type"]))
        return F.struct(new.alias("kind"), e["ts"].alias("last"), F.when(kind.isNull(), F.lit(1)).otherwise(a["n"] + 1).alias("n"), F.when(over, F.concat(a["out"], event(a))).otherwise(a["out"]).alias("out"))

    done = F.aggregate("events", start, step, lambda a: F.when(a["kind"].isNotNull(), F.concat(a["out"], event(a))).otherwise(a["out"]))
    return grouped.select("path", F.explode(done).alias("e")).select("path", "e.type", "e.due", "e.n")


def coalesce_stream(events: DataFrame, debounce_ms: int, grace_ms: int, watermark: str = "10 seconds", path_col: str = "path", ts_col: str = "ts", type_col: str = "type", id_col: str | None = None) -> DataFrame:
    """A stream of (path, type, due) from a stream of events with a TIMESTAMP column.

    Equal times of a batch stand in the order of id_col, or as they come without one. Needs the RocksDB state store (see `use_rocksdb`) and a checkpoint at the sink.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Coalescer(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("pending", "kind string, last long")

        def _load(self) -> tuple[str | None, int]:
            got = self.state.get() if self.state.exists() else None
            return (got[0], got[1]) if got is not None else (None, 0)

        def _due(self, state: tuple[str | None, int]) -> int:
            return state[1] + (grace_ms if state[0] == DELETE else debounce_ms)

        def _rows(self, key, emitted: list[tuple[str, int]]) -> pd.DataFrame:
            return pd.DataFrame({"path": [key[0]] * len(emitted), "type": [k for k, _ in emitted], "due": pd.to_datetime([d for _, d in emitted], unit="ms")})

        def _keep(self, before: tuple[str | None, int], after: tuple[str | None, int]) -> None:
            if before[0]:
                self.handle.deleteTimer(self._due(before))
            if after[0]:
                self.state.update(after)
                self.handle.registerTimer(self._due(after))
            else:
                self.state.clear()

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            got = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
            millis = got["ts"].astype("datetime64[ms]").astype("int64")
            before = self._load()
            emitted, after = fold(list(zip(millis.tolist(), got["type"].tolist(), strict=True)), debounce_ms, grace_ms, before)
            self._keep(before, after)
            if emitted:
                yield self._rows(key, emitted)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            state = self._load()
            if state[0] and self._due(state) <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                yield self._rows(key, [(state[0], self._due(state))])

        def close(self) -> None:
            pass

    own = events.select(F.col(path_col).cast("string").alias("path"), F.col(ts_col).cast("timestamp").alias("ts"), F.col(type_col).alias("type"), (F.col(id_col) if id_col else F.lit(0)).cast("long").alias("id")).where("type is not null")
    return own.withWatermark("ts", watermark).groupBy("path").transformWithStateInPandas(Coalescer(), "path string, type string, due timestamp", "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Which resources change with an event: {path} stands for the event's file.
TOPICS = {"analysis_complete": ("file/{path}", "index"), "rebuild_complete": ("index",)}


def notifications(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscriber, topic, event_id): who is to be told of which events (event_id, type, path).

    A subscription (subscriber, topic) is to a file, `file/<path>`, or to the index. Events of other
    types tell nobody. On a stream this is a join with a table of subscriptions.
    """
    topics = F.lit(None).cast("array<string>")
    for kind, names in TOPICS.items():
        own = F.array(*[F.concat(F.lit(n.split("{")[0]), F.col("path")) if "{" in n else F.lit(n) for n in names])
        topics = F.when(F.col("type") == kind, own).otherwise(topics)
    return events.select("event_id", F.explode(topics).alias("topic")).join(subscriptions.select("subscriber", "topic"), "topic").select("subscriber", "topic", "event_id")


def notify(stream: DataFrame, subscribers: list, checkpoint: str, trigger: dict | None = None):
    """Hands each micro-batch to every subscriber, called with (frame, batch id); one that fails
    doesn't keep the others from being called, and fails the batch afterwards."""

    def each(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        failed = []
        for call in subscribers:
            try:
                call(df, batch_id)
            except Exception as x:
                failed.append(x)
        df.unpersist()
        if failed:
            raise failed[0]

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
