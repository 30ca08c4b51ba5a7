"""Streams of messages: routing, history, lateness, state by key. Each has the batch meaning that
its docstring names; sources and sinks are the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from kelpline.functions.rules import stale


def files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """New files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def only_new(df: DataFrame, time: str, started: Column) -> DataFrame:
    """Without what was pending when the job started."""
    return df.filter(F.col(time) >= started)


def routes(df: DataFrame) -> dict[str, DataFrame]:
    """By content: location, else photo, else voice, else text."""
    kind = F.when(F.col("latitude").isNotNull(), "location").when(F.col("photo_file_id").isNotNull(), "photo").when(F.col("voice_file_id").isNotNull(), "voice").when(F.col("message_text").isNotNull(), "text")
    return {k: df.filter(kind == k) for k in ("location", "photo", "voice", "text")}


def record_and_process(df: DataFrame, history: str, checkpoint: str, process, time: str = "created_at", seconds: int = 120) -> StreamingQuery:
    """Every message goes to the history; those that aren't too old by the clock go to
    ``process(batch, batch_id)`` too. Late rows stay in the history, so this is no watermark. A
    repeated batch overwrites its own folder."""

    def both(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
        written = batch.sparkSession.read.schema(batch.schema).parquet(f"{history}/batch={batch_id}")
        process(written.filter(~stale(F.col(time), F.current_timestamp(), seconds)), batch_id)

    return df.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_key(df: DataFrame, keys: list[str], time: str, delay: str | None = "7 days") -> DataFrame:
    """The first row of each key within the watermark's reach; state goes when it is past. Without
    a delay the first row ever, and the state keeps every key."""
    if delay is None:
        return df.dropDuplicates(keys)
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def first_valid(df: DataFrame, keys: list[str], valid: Column, time: str, delay: str | None = "7 days") -> DataFrame:
    """Like ``first_of_key`` among valid rows only: a rejected one doesn't bar another try."""
    return first_of_key(df.filter(valid), keys, time, delay)


class _Keyed(StatefulProcessor):
    """One value per key, which ``step(key, rows, value)`` turns into rows and the next value. A value that no
    batch has touched for ``keep_ms`` goes."""

    def __init__(self, schema: str, step: Callable, keep_ms: int | None):
        self.schema, self.step, self.keep_ms = schema, step, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.schema, self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.value.get()) if self.value.exists() else None
        out, after = self.step(key, pd.concat(rows, ignore_index=True), before)
        if after is not None:
            self.value.update(after)
        if len(out):
            yield out

    def close(self) -> None:
        pass


def keyed(df: DataFrame, keys: list[str], out: str, value: str, step: Callable, keep: str | None = "30 days", mode: str = "Append") -> DataFrame:
    """Rows with schema ``out`` from a state machine per key with state ``value``, held by RocksDB on the executors' disks and
    in the checkpoint, so the state may be larger than memory and goes on after a restart. ``step``: of (key, rows of a
    batch, value or None) to (rows, next value or None). A key untouched for ``keep`` by the clock is forgotten."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # state that expires by the clock asks for batches without data forever, so a run over what is there now would not end
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
    return df.groupBy(*keys).transformWithStateInPandas(_Keyed(value, step, ms), out, mode, "none" if ms is None else "ProcessingTime")


def _typed(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def first_arrival(df: DataFrame, keys: list[str], order: list[str], keep: str | None = "30 days") -> DataFrame:
    """The row of each key that comes first, in a batch the first by ``order``; keys and order columns. A later
    row passes only after nothing has come for ``keep``."""

    def step(key: tuple, rows: pd.DataFrame, before: tuple | None) -> tuple[pd.DataFrame, tuple]:
        return (rows.sort_values(order).head(1) if before is None else rows.head(0)), (True,)

    rows = df.select(*keys, *order)
    return keyed(rows, keys, _typed(rows, *keys, *order), "seen boolean", step, keep)


def last_of_key(df: DataFrame, key: str, time: str, *columns: str, keep: str | None = "30 days") -> DataFrame:
    """The latest value of each key so far, of equal times by the columns in turn; a row per batch in which it
    changes. A late row doesn't replace a later value."""
    rows = df.select(key, time, *columns)
    schema = _typed(rows, time, *columns)

    def step(k: tuple, pdf: pd.DataFrame, before: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        top = pdf.sort_values([time, *columns]).tail(1)
        new = tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x for x in top[[time, *columns]].iloc[0])
        return (top, new) if before is None or new > before else (top.head(0), None)

    return keyed(rows, [key], _typed(rows, key, time, *columns), schema, step, keep, "Update")


def once_a_day(df: DataFrame, key: str, day: str, keep: str | None = "30 days") -> DataFrame:
    """The first row of a key on each day it is later than all before."""

    def step(k: tuple, rows: pd.DataFrame, before: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        last = before[0] if before else ""
        days = sorted({d for d in rows[day] if d and d > last})
        return pd.DataFrame({key: [k[0]] * len(days), day: days}), (days[-1],) if days else None

    return keyed(df.select(key, day), [key], f"{_typed(df, key)}, {day} string", "last string", step, keep)


def sessions(df: DataFrame, key: str, order: str, event: str, keep: str | None = "30 days") -> DataFrame:
    """Open and close records as a state machine, not by gaps: rows (key, session, opened, closed).
    An open session is closed by a close record, or by the next open one. A late record counts
    when it comes; a session that stays open for ``keep`` is forgotten."""

    def step(k: tuple, rows: pd.DataFrame, before: tuple | None) -> tuple[pd.DataFrame, tuple]:
        opened, n = before or (None, 0)
        out = []
        for at, what in sorted(zip(rows[order], rows[event], strict=True)):
            if what in ("open", "close") and opened is not None:
                out.append((k[0], n - 1, opened, int(at)))
                opened = None
            if what == "open":
                opened, n = int(at), n + 1
        return pd.DataFrame(out, columns=[key, "session", "opened", "closed"]), (opened, n)

    return keyed(df.select(key, order, event), [key], f"{_typed(df, key)}, session int, opened long, closed long", "opened long, n int", step, keep)


def every(df: DataFrame, minutes: int, process, checkpoint: str) -> StreamingQuery:
    """``process(batch, batch_id)`` over what has come, every few minutes; a missed time is made up for once."""
    return df.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(processingTime=f"{minutes} minutes").start()


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give its results so far as a table, written to files by
    the executors. A run with the same folders goes on where the last one ended. In update mode
    each batch has a folder, and ``batch`` says which; in complete mode the last one counts."""
    schema, spark = df.schema, df.sparkSession
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", path).outputMode(mode)
    elif mode == "update":
        q = df.writeStream.outputMode(mode).foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))
        schema = schema.add("batch", "long")
    else:
        q = df.writeStream.outputMode(mode).foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(path))
    q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path)
