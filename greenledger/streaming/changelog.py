"""The status change log as a stream with one remembered status per reading.

What is remembered grows with the number of readings, so it belongs in the RocksDB store (``rocksdb_state``), and a
reading that has been silent for long may be forgotten (``forget_after``). Events that come too late to be placed are
not lost without a trace: ``write_change_log`` keeps them beside the log. A state is called once a batch, and a call costs
as much as some hundred events: readings may share states (``shards``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import checkpointed

TRANSITION = "reading_id bigint, seq bigint, old_status string, new_status string"
STATE = "status string, seq bigint"
#: Readings that share a state, on average, where their number is known.
READINGS_A_STATE = 64
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
STORE, ROCKSDB = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def _transitions(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Compare each status with the one before; the last status and its ``seq`` are kept for the next batch.

    The events of one reading in one batch are ordered by ``seq``. How many those can be is set by the rate
    limit of the source (maxFilesPerTrigger, maxOffsetsPerTrigger), not by the size of the history. An event whose
    ``seq`` is not beyond the last one of an earlier batch came too late: its place is already written, so it is dropped.
    """
    events = pd.concat(list(chunks)).dropna(subset=["status", "seq"]).sort_values("seq", kind="stable")
    known, last = state.get if state.exists else (None, None)
    if last is not None:
        events = events[events["seq"] > last]
    if events.empty:
        return
    before = events["status"].shift(1)
    before.iloc[0] = known
    changed = before.notna() & (before != events["status"])
    state.update((events["status"].iloc[-1], int(events["seq"].iloc[-1])))
    yield pd.DataFrame(
        {
            "reading_id": events["reading_id"][changed],
            "seq": events["seq"][changed],
            "old_status": before[changed],
            "new_status": events["status"][changed],
        }
    )


def _marked(
    key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState, forget_ms: int | None = None
) -> Iterator[pd.DataFrame]:
    """``_transitions`` of several readings and, marked ``late``, the events it drops. The state has of each reading the last
    status, its ``seq`` and, with ``forget_ms``, until when it is kept; a reading with an event in this batch is kept."""
    known = {int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {}
    now = state.getCurrentProcessingTimeMs() if forget_ms else 0
    seen: set[int] = set()
    if not state.hasTimedOut:
        events = pd.concat(list(chunks), ignore_index=True)
        without_id = events["reading_id"].isna().any()  # such events are a group of their own
        found, seen = _against(known, events.fillna({"reading_id": 0}) if without_id else events)
        if len(found):
            yield found.assign(reading_id=None) if without_id else found
    if forget_ms:
        for reading in list(known):
            if reading in seen:
                known[reading][2] = now + forget_ms
            elif known[reading][2] < now:
                del known[reading]
    if known:
        state.update((json.dumps(known, separators=(",", ":")),))
        if forget_ms:
            state.setTimeoutDuration(max(1, min(until for _, _, until in known.values()) - now))
    elif state.exists:
        state.remove()


def _against(known: dict[int, list], events: pd.DataFrame) -> tuple[pd.DataFrame, set[int]]:
    """Transitions and late events of a batch, and the readings with an event; ``known`` gets the last statuses."""
    ids, at = np.unique(events["reading_id"].to_numpy("int64"), return_inverse=True)
    seen = ids.tolist()
    has = np.array([reading in known for reading in seen])
    last = np.array([known[r][1] if r in known else 0 for r in seen], "int64")
    seq, status, placed = events["seq"].to_numpy("int64"), events["status"].to_numpy(object), events["placed"].to_numpy(bool)
    old = has[at] & (seq <= last[at])
    late, fresh = np.flatnonzero(placed & old), np.flatnonzero(placed & ~old)
    fresh = fresh[np.lexsort((seq[fresh], at[fresh]))]
    before = np.empty(len(fresh), object)
    before[1:] = status[fresh[:-1]]
    first = np.ones(len(fresh), bool)
    first[1:] = at[fresh[1:]] != at[fresh[:-1]]
    for i in np.flatnonzero(first):
        before[i] = known.get(seen[at[fresh[i]]], (None,))[0]
    changed = np.array([a is not None and a != b for a, b in zip(before, status[fresh])], bool)
    for i in fresh[np.append(first[1:], True)] if len(fresh) else ():
        known[seen[at[i]]] = [status[i], int(seq[i]), 0]
    rows = np.concatenate([late, fresh[changed]])
    found = pd.DataFrame({
        "reading_id": ids[at[rows]], "seq": seq[rows], "old_status": np.concatenate([np.full(len(late), None, object), before[changed]]),
        "new_status": status[rows], "late": np.arange(len(rows)) < len(late),
    })
    return found, set(seen)


def shards_for(readings: int) -> int:
    return max(1, readings // READINGS_A_STATE)


def marked_transition_stream(events: DataFrame, forget_after: timedelta | None = None, shards: int | None = None) -> DataFrame:
    """Transitions with ``late`` false, and the events that came too late with ``late`` true and no old status.

    With ``forget_after`` the state of a reading that had no event for that long (by the clock) is dropped with the next
    batch; its next event then is a first one, which makes no transition. The readings share ``shards`` states, dealt by
    hash, or have one each; a stream that goes on from a checkpoint must keep their number.
    """
    forget_ms = int(forget_after.total_seconds() * 1000) if forget_after else None
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    reading = F.col("reading_id")
    shard = F.when(reading.isNotNull(), F.pmod(F.xxhash64(reading), F.lit(shards))) if shards else reading
    placed = F.col("status").isNotNull() & F.col("seq").isNotNull()
    return (  # no nulls among the numbers, which would make them doubles
        events.select("reading_id", F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), "status", placed.alias("placed"), shard.alias("_shard"))
        .groupBy("_shard")
        .applyInPandasWithState(partial(_marked, forget_ms=forget_ms), f"{TRANSITION}, late boolean", "readings string", "append", timeout)
    )


@contextmanager
def rocksdb_state(spark: SparkSession, empty_batches: bool = True) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on the executors' disks and in the checkpoint folder.

    Without ``empty_batches`` a batch needs new events; else a stream that waits for timeouts never ends by itself.
    """
    wanted = {STORE: ROCKSDB} | ({} if empty_batches else {EMPTY_BATCHES: "false"})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def write_change_log(
    events: DataFrame, log: str, late: str, checkpoint: str, forget_after: timedelta | None = None, shards: int | None = None,
    **trigger
) -> StreamingQuery:
    """Append transitions to ``log`` and late events to ``late``, each batch in a folder of its own number, so that a batch
    that runs again replaces itself.

    The source's rate limit (maxFilesPerTrigger, maxOffsetsPerTrigger) bounds the events of one reading in a batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("not late").drop("late").write.mode("overwrite").parquet(f"{log}/batch={number}")
        batch.where("late").select("reading_id", "seq", F.col("new_status").alias("status")).write.mode("overwrite").parquet(
            f"{late}/batch={number}"
        )
        batch.unpersist()

    trigger = trigger or {"availableNow": True}
    with rocksdb_state(events.sparkSession, empty_batches="availableNow" not in trigger):
        return (
            marked_transition_stream(events, forget_after, shards).writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )


def status_transition_stream(events: DataFrame) -> DataFrame:
    """Events (reading_id, seq, status) to real status changes; late events are dropped. One small state per reading."""
    return (
        events.select("reading_id", "seq", "status")
        .groupBy("reading_id")
        .applyInPandasWithState(
            _transitions, TRANSITION, STATE, "append", GroupStateTimeout.NoTimeout
        )
    )


def status_transition_batch(events: DataFrame) -> DataFrame:
    """The same transitions over a finished history.

    The events are cut into ranges of (reading, seq), so a reading with very many events lies in several tasks. Inside a
    range each status is compared with the one before; the first one of a range with the last of the range before it.
    """
    ranged = events.where(F.col("status").isNotNull()).repartitionByRange("reading_id", "seq")
    rows = checkpointed(ranged.select("reading_id", "seq", "status").withColumn("_range", F.spark_partition_id()))
    last = rows.groupBy("reading_id", "_range").agg(F.max_by("status", "seq").alias("_last"))
    carried = last.select(
        "reading_id", "_range", F.lag("_last").over(Window.partitionBy("reading_id").orderBy("_range")).alias("_carried")
    )
    before = F.lag("status").over(Window.partitionBy("reading_id", "_range").orderBy("seq"))
    return (
        rows.withColumn("_before", before)
        .join(carried, ["reading_id", "_range"])
        .withColumn("old_status", F.coalesce("_before", "_carried"))
        .where(F.col("old_status") != F.col("status"))
        .select("reading_id", "seq", "old_status", F.col("status").alias("new_status"))
    )
