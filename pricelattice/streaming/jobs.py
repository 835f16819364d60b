"""Streaming forms of the incremental jobs. Each reads a file source, and leaves its result as a table in the
folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder


def runs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection runs as a stream of the events files: store, time, status, items."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events*.parquet")
    return stream.select(
        F.col("event_id").alias("run_id"), (F.col("user_id") % 80).alias("store_id"), F.col("ts").cast("timestamp").alias("started_at"), "event_type", "value"
    )


def _finished(frame: DataFrame, name: str, mode: str, late: list[int] | None = None) -> DataFrame:
    spark = frame.sparkSession
    out = folder(spark, name)

    def put(batch: DataFrame, epoch: int) -> None:  # the same epoch again overwrites itself
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    run = frame.writeStream.outputMode(mode).option("checkpointLocation", folder(spark, f"{name}-log")).foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    if late is not None:
        late.append(sum(op.numRowsDroppedByWatermark for step in run.recentProgress for op in step.stateOperators))
    return spark.read.schema(frame.schema.add("epoch", "long")).parquet(out)


def guarded_ingest(stream: DataFrame, days: int = 2) -> DataFrame:
    """One run of each store, kind and day, in whatever order the files come.

    A run of the last ``days`` days before the newest day that earlier batches had is on time: it is compared with the runs of
    these days alone, which the output keeps in a folder a day, so that what a batch holds and reads is bounded by days. An older one is late: it goes to a
    second output as it is. The result unites both; late runs count where the first output has none. A batch that runs again
    overwrites what it wrote and reads only the batches before it."""
    spark, key = stream.sparkSession, ["store_id", "event_type", "day"]
    out = folder(spark, "stream-ingest")

    def earlier(name: str, epoch: int) -> DataFrame | None:
        return spark.read.parquet(f"{out}/{name}").where(F.col("epoch") < epoch) if epoch else None

    def put(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("store_id", "event_type", F.to_date("started_at").alias("day")).where("day is not null").distinct().persist()
        marks = earlier("marks", epoch)
        newest = marks.agg(F.max("newest")).first()[0] if marks is not None else None
        fresh, late = rows, rows.where("false")
        if newest is not None:
            on_time = F.col("day") >= F.date_sub(F.lit(newest), days)
            late, known = rows.where(~on_time), earlier("runs", epoch).where(on_time)
            fresh = rows.where(on_time).join(known.select(*key), key, "left_anti")
        for name, part in (("runs", fresh), ("late", late)):
            part.withColumn("on_day", F.col("day")).write.mode("overwrite").partitionBy("on_day").parquet(f"{out}/{name}/epoch={epoch}")
        rows.agg(F.max("day").alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/epoch={epoch}")
        rows.unpersist()

    run = stream.writeStream.option("checkpointLocation", folder(spark, "stream-ingest-log")).foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    schema = "store_id long, event_type string, day date"
    runs, late = (spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/{name}") for name in ("runs", "late"))
    return runs.unionByName(late.distinct().join(runs, key, "left_anti"))


def _weeks(stream: DataFrame, lateness: str) -> DataFrame:
    weeks = stream.withWatermark("started_at", lateness).groupBy("store_id", F.window("started_at", "7 days", "7 days", "4 days"))
    return weeks.agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))


def _by_week(done: DataFrame) -> DataFrame:
    return done.select("store_id", F.to_date("window.start").alias("week"), F.round("mean_value", 6).alias("mean_value"), "n")


def weekly_means(stream: DataFrame) -> DataFrame:
    """Mean value per store and week from Monday, after the last event."""
    done = _finished(_weeks(stream, "2 days"), "stream-weekly", "complete")
    last = done.agg(F.max("epoch").alias("epoch"))  # one row: in complete mode the last epoch has all
    return _by_week(done.join(F.broadcast(last), "epoch"))


def closed_weeks(stream: DataFrame, lateness: str = "2 days", late: list[int] | None = None) -> DataFrame:
    """The weeks of ``weekly_means`` that are over: a week is written once, when the newest event is ``lateness`` past its end, and leaves
    the state, which holds open weeks alone. Events later than that do not count; ``late`` gets the number of their groups."""
    done = _finished(_weeks(stream, lateness), "stream-closed", "append", late)
    return _by_week(done)


def silent_stores(stream: DataFrame, seconds: int = 1800, lateness: str = "2 days") -> DataFrame:
    """``(store_id, beat, silent_at)`` of every time that a store went silent: after ``beat``, a sign of life (any event but a view), none
    came for ``seconds``. The row is made when the watermark has passed ``silent_at``, whether or not the store is ever heard again.

    Beats of a store that are ``seconds`` apart at most are one session, and the last one of a session is the silence, in whatever order
    they come. The state is a row a session that is open or not older than ``lateness``; beats whose own ``seconds`` are over by ``lateness``
    before the newest one do not count, and what the newest beat less ``lateness`` has not reached is open."""
    spark, option = stream.sparkSession, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    beats = stream.where("event_type <> 'view'").select("store_id", "started_at").withWatermark("started_at", lateness)
    sessions = beats.groupBy("store_id", F.session_window("started_at", f"{seconds} seconds")).agg(F.max("started_at").alias("beat"))
    silent = sessions.select("store_id", F.unix_micros("beat").alias("beat"))
    before = spark.conf.get(option)
    spark.conf.set(option, "true")  # sessions are merged before the shuffle as well
    try:
        done = _finished(silent, "stream-silent", "append")
    finally:
        spark.conf.set(option, before)
    return done.select("store_id", F.timestamp_micros("beat").alias("beat"), F.timestamp_micros(F.col("beat") + seconds * 1_000_000).alias("silent_at"))


def stale_stores(stream: DataFrame, seconds: int = 1800) -> DataFrame:
    """Per store the last sign of life (any event but a view, which is a run under way), and whether it is ``stale``: none, or
    more than ``seconds`` before the newest event of all. The state is a row a store."""
    beat = F.max(F.when(F.col("event_type") != "view", F.col("started_at"))).alias("beat")
    done = _finished(stream.groupBy("store_id").agg(beat, F.max("started_at").alias("seen")), "stream-stale", "complete")
    last = done.agg(F.max("epoch").alias("epoch"))  # one row: in complete mode the last epoch has all
    rows = done.join(F.broadcast(last), "epoch")
    now = rows.agg(F.max("seen").alias("now"))  # one row
    late = F.col("beat") < F.col("now") - F.make_interval(secs=F.lit(seconds))
    return rows.join(F.broadcast(now), F.lit(True)).select("store_id", "beat", F.coalesce(late, F.lit(True)).alias("stale"))
