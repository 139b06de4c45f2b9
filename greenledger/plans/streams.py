"""The two row rules as streams over the tables, run until the input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import checkpointed, scratch_path
from ..streaming.changelog import shards_for, status_transition_batch, write_change_log
from ..streaming.readings import validate_arrivals
from .changes import SHIFTED, shifted
from .domain import Domain
from .registry import query


def arrived(d: Domain):
    """Stream over readings, some with negative values, from files."""
    path = scratch_path(d.spark, "arrivals")
    shifted(d).write.parquet(path)
    return d.spark.readStream.schema(d.reading.schema).option("maxFilesPerTrigger", 2).parquet(path)


def validated(d: Domain) -> tuple[str, str]:
    accepted, rejected = scratch_path(d.spark, "accepted"), scratch_path(d.spark, "rejected")
    validate_arrivals(arrived(d), accepted, rejected, scratch_path(d.spark, "offsets")).awaitTermination()
    return accepted, rejected


@query("w1_accepted_arrivals", "select reading_id, measured_value, status from shifted join (select reading_id, status from reading) using (reading_id) where measured_value>=0", SHIFTED)
def _(d: Domain):
    return d.spark.read.parquet(validated(d)[0]).select("reading_id", "measured_value", "status")


@query("w1_rejected_arrivals", "select reading_id, measured_value, 'measured_value is negative' reason from shifted where measured_value<0", SHIFTED)
def _(d: Domain):
    return d.spark.read.parquet(validated(d)[1]).select("reading_id", "measured_value", "reason")


# The statuses of a company's readings in time order stand for the history of one reading.
HISTORY = """history as (select company_id reading_id, cast(row_number() over (partition by company_id order by read_at, reading_id) as bigint) seq,
status from reading)"""
CHANGES = """select reading_id, seq, old_status, status new_status from (select *, lag(status) over (partition by reading_id
order by seq) old_status from history) where old_status<>status"""


def history(d: Domain):
    d.register_views()
    return d.spark.sql(HISTORY[len("history as ("):-1])


def logged(d: Domain, *parts: str) -> tuple[str, str]:
    """Log and late events of a stream over files that arrive one condition on the history after the other."""
    events, log, late = (scratch_path(d.spark, name) for name in ("events", "transitions", "late"))
    rows = checkpointed(history(d))
    shards = shards_for(rows.agg(F.approx_count_distinct("reading_id")).first()[0])
    for part in parts:  # all events of a reading that arrive together lie in one file
        rows.where(part).repartition(2, "reading_id").write.mode("append").parquet(events)
    source = d.spark.readStream.schema("reading_id bigint, seq bigint, status string").option("maxFilesPerTrigger", 2)
    write_change_log(source.parquet(events), log, late, scratch_path(d.spark, "offsets"), shards=shards).awaitTermination()
    return log, late


@query("w2_transition_stream", CHANGES, HISTORY)
def _(d: Domain):
    log, _ = logged(d, "seq <= 6", "seq > 6")
    return d.spark.read.parquet(log).drop("batch")


@query("w2_late_events", """select reading_id, seq, status from history where seq<=3 and reading_id in
(select reading_id from history where seq>3)""", HISTORY)
def _(d: Domain):
    """The first events of each reading arrive after the later ones."""
    _, late = logged(d, "seq > 3", "seq <= 3")
    return d.spark.read.parquet(late).drop("batch")


@query("w2_transition_batch", CHANGES, HISTORY)
def _(d: Domain):
    return status_transition_batch(history(d))
