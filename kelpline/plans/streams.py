"""Streaming jobs over the event log: in slices with a restart after each, or over what is there now."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.sources.scratch import scratch_path
from kelpline.streaming import jobs

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a stream reads a folder: the table's own if it is one, else its parent's one file
    events = jobs.files(spark, f"{sf_dir}/events.parquet*", _EVENTS)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df: DataFrame, mode: str) -> DataFrame:
    spark = df.sparkSession
    return jobs.run_to_end(df, scratch_path(spark, "stream"), scratch_path(spark, "stream_state"), mode)


#: Slices of the event log by time, each a batch; of the late events each comes a slice after its own.
SLICES, LATE = 4, 11


def _sliced(spark: SparkSession, sf_dir: str, job: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The event log as it comes in slices. After each slice the stream stops, and the next run goes on from
    the checkpoint: the job is made anew and its state comes from there."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    r = events.agg(F.min(us).alias("low"), F.max(us).alias("high")).first()
    own = F.floor((us - r["low"]) * SLICES / F.lit((r["high"] or 0) - (r["low"] or 0) + 1))
    comes = events.withColumn("slice", F.least(own + (F.col("event_id") % LATE == 0).cast("int"), F.lit(SLICES - 1)))
    land, out, state = (scratch_path(spark, f"stream_{x}") for x in ("in", "out", "state"))
    found = None
    for k in range(SLICES):
        comes.filter(F.col("slice") == k).drop("slice").write.parquet(f"{land}/{k}")
        df = jobs.files(spark, f"{land}/*", _EVENTS, per_trigger=10_000).withColumn("ts", F.col("ts").cast("timestamp"))
        found = jobs.run_to_end(job(df), out, state, mode)
    return found


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase of each user that comes first; other events don't bar it."""
    job = lambda e: jobs.first_arrival(e.filter("event_type = 'purchase'"), ["user_id", "event_type"], ["ts", "event_id"])
    return _sliced(spark, sf_dir, job).select("user_id", "event_type", "event_id")


def stream_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, from the updates of all batches."""
    found = _sliced(spark, sf_dir, lambda e: jobs.last_of_key(e, "user_id", "ts", "event_id", "event_type"), "update")
    last = found.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "batch").alias("e"))
    return last.select("user_id", "e.event_id", "e.event_type")


def stream_once_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days on which a user had an error; a late error on an earlier day than the last doesn't count."""
    job = lambda e: jobs.once_a_day(e.filter("event_type = 'error'").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), "user_id", "day")
    return _sliced(spark, sf_dir, job)


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a signup opens and a purchase closes, over all slices; late events count when they come."""
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "close").otherwise("other")
    return _sliced(spark, sf_dir, lambda e: jobs.sessions(e.select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id", "kind"))


def stream_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates by content, without those that were pending at the start; branches as one table."""
    k = F.col("event_id") % 5
    e = _events(spark, sf_dir).select(
        "event_id", "ts", F.when(k == 0, F.col("value")).alias("latitude"), F.when(k < 2, "p").alias("photo_file_id"), F.when((k > 1) & (k < 4), "v").alias("voice_file_id"), F.when(k != 4, "t").alias("message_text")
    )
    found = jobs.routes(jobs.only_new(e, "ts", F.to_timestamp(F.lit("2024-01-02 00:00:00"))))
    parts = [df.select("event_id", F.lit(kind).alias("route")) for kind, df in found.items()]
    return _run(reduce(DataFrame.unionByName, parts), "append")


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events go to the history, and those that aren't older than the clock allows are processed:
    here those of an even number, moved to now."""
    e = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, F.current_timestamp() + F.expr("interval 1 hour")).otherwise(F.col("ts")).alias("created_at"))
    history, done = scratch_path(spark, "history"), scratch_path(spark, "processed")
    jobs.record_and_process(e, history, scratch_path(spark, "stream_state"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{done}/batch={n}")).awaitTermination()
    processed = spark.read.schema("event_id long").parquet(done).select("event_id", F.lit(True).alias("processed"))
    return spark.read.schema("event_id long").parquet(history).join(processed, "event_id", "left").select("event_id", F.coalesce("processed", F.lit(False)).alias("processed"))


_SLICED = f"""t as (select min(epoch_us(ts)) as low, max(epoch_us(ts)) as high from events),
c as (select events.*, least((epoch_us(ts)-low)*{SLICES}//(high-low+1)+(event_id%{LATE}=0)::int, {SLICES - 1}) as slice from events, t)"""
ORACLE = {
    "stream_dedup": f"with {_SLICED} select user_id, event_type, event_id from c where event_type='purchase' qualify row_number() over (partition by user_id order by slice, ts, event_id)=1",
    "stream_last_value": "select user_id, max_by(event_id,(ts,event_id)) as event_id, max_by(event_type,(ts,event_id)) as event_type from events group by 1",
    "stream_once_a_day": f"""with {_SLICED}, d as (select distinct user_id, slice, strftime(ts,'%Y-%m-%d') as day from c where event_type='error'),
m as (select *, max(day) over (partition by user_id order by slice range between unbounded preceding and 1 preceding) as before from d)
select user_id, day from m where before is null or day>before""",
    "stream_routes": "select event_id, case event_id%5 when 0 then 'location' when 1 then 'photo' else 'voice' end as route from events where ts>='2024-01-02 00:00:00' and event_id%5<4",
    "stream_history": "select event_id, event_id%2=0 as processed from events",
    "stream_sessions": f"""with {_SLICED}, m as (select user_id, slice, event_id, event_type, lead(event_id) over (partition by user_id order by slice, event_id) as next from c where event_type in ('signup','purchase'))
select user_id, cast(row_number() over (partition by user_id order by slice, event_id)-1 as int) as session, event_id as opened, next as closed from m where event_type='signup' qualify next is not null""",
}
QUERIES = {f.__name__: f for f in (stream_dedup, stream_last_value, stream_once_a_day, stream_sessions, stream_routes, stream_history)}
