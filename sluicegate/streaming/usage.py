"""Usage streams: tumbling, sliding and session counts, deduplication, daily quota and running ledgers.

Each transformation takes a batch or streaming frame; on data that lies within the watermark both give the same rows.
Late rows beyond the watermark are dropped by the engine, which counts them in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY = "1 day"


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """Streams need an instant as event time; a batch keeps its type."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", delay)


def tumbling(events: DataFrame, width: str = "1 day", delay: str = DELAY) -> DataFrame:
    w = _timed(events, delay).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str = "7 days", slide: str = "1 day", delay: str = DELAY) -> DataFrame:
    w = _timed(events, delay).groupBy(F.window("ts", width, slide))
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    w = _timed(events, delay).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def once(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each event_id once."""
    w = _timed(events, delay)
    return w.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else w.dropDuplicates(["event_id"])


def last_seen(events: DataFrame) -> DataFrame:
    """First and last time of each user: the table that a foreachBatch merge keeps."""
    return events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


#: Triggers after which the changes to a table of users are merged into its base.
MERGE_EVERY = 8


def merge_last_seen(path: str, every: int = MERGE_EVERY):
    """A foreachBatch function that keeps the table of users at path, which ``seen_users`` reads.

    A trigger writes what its own batch says, under its number, so one that is retried writes the same again; every few
    triggers the changes since the last base become a new base.  A trigger's work follows its batch, not the table, and
    the table is rewritten once in every.
    """

    def merge(batch: DataFrame, number: int) -> None:
        last_seen(batch).write.mode("overwrite").parquet(f"{path}/kind=change/batch={number}")
        if (number + 1) % every == 0:
            seen_users(batch.sparkSession, path, number).write.mode("overwrite").parquet(f"{path}/kind=base/batch={number}")

    return merge


def seen_users(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(user_id, first_seen, last_seen) from the newest base and the changes after it (to trigger upto); folders of others are
    left out of the scan."""
    rows = spark.read.option("basePath", path).parquet(path)
    rows = rows if upto is None else rows.where((F.col("batch") < upto) | (F.col("batch") == upto) & (F.col("kind") == "change"))
    base = rows.where("kind = 'base'").agg(F.max("batch").alias("b")).first()["b"]
    if base is not None:
        rows = rows.where((F.col("kind") == "base") & (F.col("batch") == base) | (F.col("kind") == "change") & (F.col("batch") > base))
    return rows.groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


#: Parts that a day's users are dealt over; the same for all runs of a checkpoint.
BUCKETS = 64


def quota_stream(events: DataFrame, limit: int, delay: str = DELAY) -> DataFrame:
    """(user_id, day, event_id, allowed): a user's first limit requests of a day, by event time within a trigger; state is
    the day's counts of a part of the users, kept until the watermark passes the day.

    A call takes a part of a day's users at once, so the calls follow days and parts, not users.
    """
    least = np.iinfo(np.int64).min  # stands for a null user

    def take(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        users, used = (np.frombuffer(x, np.int64) for x in (state.get if state.exists else (b"", b"")))
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        user = pdf["_user"].to_numpy()
        now, of, n = np.unique(user, return_inverse=True, return_counts=True)
        every = np.union1d(users, now)
        counts = np.zeros(len(every), np.int64)
        counts[np.searchsorted(every, users)] = used
        at = np.searchsorted(every, now)
        nth = counts[at][of] + 1 + pdf.groupby("_user").cumcount().to_numpy()
        counts[at] += n
        state.update((every.tobytes(), counts.tobytes()))
        if key[1] is not None:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(key[1]).timestamp() * 1000) + 172_800_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"_user": user, "day": key[1], "event_id": pdf["event_id"].to_numpy(), "allowed": nth <= limit})

    user = F.coalesce(F.col("user_id").cast("long"), F.lit(int(least)))
    rows = _timed(events, delay).select("ts", "event_id", user.alias("_user"), F.to_date("ts").cast("string").alias("day"))
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("_user"), F.lit(BUCKETS)).cast("int")).groupBy("_part", "day")
    out = parts.applyInPandasWithState(take, "_user long, day string, event_id long, allowed boolean", "users binary, used binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.nullif("_user", F.lit(int(least))).alias("user_id"), "day", "event_id", "allowed")


def decision_log(turns: DataFrame, last: int) -> DataFrame:
    """(conv_id, turn, context, known): for each turn of a stream, the roles of the last turns before it and all roles seen,
    by commas.  State is a conversation's last roles and its set of roles; turns of a trigger are taken in order, and a row
    shows nothing of its own turn or later ones, so the log can be appended to."""

    def take(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, known = (list(filter(None, x.split(","))) for x in (state.get if state.exists else ("", "")))
        rows = []
        for turn, role in sorted(row for pdf in pdfs for row in zip(pdf["turn"], pdf["role"], strict=True)):
            rows.append((key[0], turn, ",".join(before), ",".join(sorted(known))))
            before, known = [*before, role][-last:], {*known, role}
        state.update((",".join(before), ",".join(sorted(known))))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "context", "known"])

    return turns.select("conv_id", "turn", "role").groupBy("conv_id").applyInPandasWithState(take, "conv_id long, turn long, context string, known string", "before string, known string", "append", GroupStateTimeout.NoTimeout)


def asked_once(texts: DataFrame, keep: str | None = None) -> DataFrame:
    """(item, asks, answered_by): of each text of a stream of (item, sha) the first item asks, and the others take its answer;
    a trigger's items come in their order.  With keep, an answer that no item has taken for so long (of processing time) is
    forgotten and asked for anew; such a query looks for answers to forget for as long as it runs, so it needs a trigger that
    has no end (not available-now)."""
    ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None

    def take(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        items = sorted(i for pdf in pdfs for i in pdf["item"])
        kept = state.get[0] if state.exists else None
        by = items[0] if kept is None else kept
        state.update((by,))
        if ms:
            state.setTimeoutDuration(ms)
        yield pd.DataFrame({"item": items, "asks": [kept is None and n == 0 for n in range(len(items))], "answered_by": by})

    kind = "item long, asks boolean, answered_by long"
    return texts.select("item", "sha").groupBy("sha").applyInPandasWithState(take, kind, "answered_by long", "append", GroupStateTimeout.ProcessingTimeTimeout if ms else GroupStateTimeout.NoTimeout)


def fed(parts: list[DataFrame], transform, folder: str, sink=None) -> DataFrame | None:
    """Parts that arrive one after the other: each is added to the source's folder and met by a query that is started anew
    from the checkpoint of the one before, so it finds the state that others left.

    transform makes the streaming frame; its rows are appended to a table, which is returned, or handed to sink, a
    foreachBatch function.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = transform(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        writer = stream.writeStream.outputMode("append" if sink is None else "update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        writer = writer.format("parquet").option("path", f"{folder}/out") if sink is None else writer.foreachBatch(sink)
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out") if sink is None else None


def by_time(events: DataFrame, parts: int, again: str | None = None, time: str = "ts") -> list[DataFrame]:
    """events in parts of equal numbers of rows by time; with again, a part begins with what the part before had in the last
    stretch of that length, as a source does that delivers at least once."""
    cuts = events.agg(F.percentile_approx(time, [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"]
    out = []
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        from_ = F.lit(True) if low is None else F.col(time) > (F.lit(low) - F.expr(f"INTERVAL {again}") if again else F.lit(low))
        out.append(events.where(from_ & (F.lit(True) if high is None else F.col(time) <= F.lit(high))))
    return out


def run_once(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a streaming frame over what is there; its rows lie as Parquet in the folder, and checkpoints beside them.

    append: every trigger's rows; complete: the rows of the last trigger, each in a folder of its own.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    out = f"{folder}/out"
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(out)
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last.append(number)

    writer.foreachBatch(keep).start().awaitTermination()
    if not last:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/{last[-1]}")
