from datetime import datetime

from greenledger.schema import TABLES
from greenledger.session import scratch_path
from greenledger.streaming.changelog import status_transition_batch, status_transition_stream
from greenledger.streaming.readings import validate_arrivals

EVENT = "reading_id bigint, seq bigint, status string"


def run(spark, source, log, offsets):
    stream = status_transition_stream(spark.readStream.schema(EVENT).parquet(source))
    stream.writeStream.format("parquet").option("path", log).option("checkpointLocation", offsets).trigger(
        availableNow=True
    ).start().awaitTermination()


def test_status_log_over_batches(spark):
    source, log, offsets = (scratch_path(spark, n) for n in ("events", "log", "offsets"))
    first = [(1, 1, "PENDING"), (1, 2, "VALIDATED"), (2, 1, "PENDING"), (2, 2, "PENDING")]
    # The second batch starts from the remembered statuses.
    second = [(1, 3, "VALIDATED"), (2, 3, "REJECTED"), (3, 1, "PENDING"), (2, 4, None), (2, 5, "PENDING")]
    spark.createDataFrame(first, EVENT).write.mode("append").parquet(source)
    run(spark, source, log, offsets)
    assert [tuple(r) for r in spark.read.parquet(log).collect()] == [(1, 2, "PENDING", "VALIDATED")]
    spark.createDataFrame(second, EVENT).write.mode("append").parquet(source)
    run(spark, source, log, offsets)
    got = sorted(tuple(r) for r in spark.read.parquet(log).collect())
    assert got == [(1, 2, "PENDING", "VALIDATED"), (2, 3, "PENDING", "REJECTED"), (2, 5, "REJECTED", "PENDING")]
    batch = status_transition_batch(spark.createDataFrame(first + second, EVENT))
    assert sorted(tuple(r) for r in batch.collect()) == got


def test_arrivals_are_split_once(spark):
    source, good, bad, offsets = (scratch_path(spark, n) for n in ("arrivals", "good", "bad", "offsets"))
    at = datetime(2022, 4, 19)
    schema = TABLES["reading"].schema
    for rows in ([(1, at, 5.0, "PENDING", 1, 1, 1), (2, at, -1.0, "PENDING", 1, 1, 1)], [(3, at, 0.0, "ODD", 1, 1, 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        validate_arrivals(stream, good, bad, offsets).awaitTermination()
    assert [r.reading_id for r in spark.read.parquet(good).collect()] == [1]
    assert sorted((r.reading_id, r.reason) for r in spark.read.parquet(bad).collect()) == [
        (2, "measured_value is negative"), (3, "status not allowed")]


def test_batch_transitions_of_a_busy_reading(spark):
    """Most events belong to one reading, which is cut into several ranges; equal neighbours are no change."""
    from greenledger.streaming.changelog import status_transition_batch

    names = ["PENDING", "VALIDATED", "REJECTED"]
    rows = [(1, i, names[(i * i // 7) % 3]) for i in range(4000)] + [(r, i, names[i % 3]) for r in (2, 3) for i in range(5)]
    rows += [(4, 1, None), (4, 2, "PENDING")]
    got = {tuple(r) for r in status_transition_batch(spark.createDataFrame(rows, "reading_id long, seq long, status string")).collect()}
    want, last = set(), {}
    for reading, seq, status in rows:
        if status is not None:
            if last.get(reading, status) != status:
                want.add((reading, seq, last[reading], status))
            last[reading] = status
    assert got == want


def test_late_events_are_dropped():
    import pandas as pd

    from greenledger.streaming.changelog import _transitions

    class State:
        exists = False

        def update(self, value):
            self.exists, self.get = True, value

    def events(*pairs):
        return iter([pd.DataFrame({"reading_id": 1, "seq": [p[0] for p in pairs], "status": [p[1] for p in pairs]})])

    state = State()
    first = pd.concat(_transitions((1,), events((2, "VALIDATED"), (1, "PENDING")), state))
    assert first[["seq", "old_status", "new_status"]].values.tolist() == [[2, "PENDING", "VALIDATED"]]
    assert list(_transitions((1,), events((1, "REJECTED"), (2, "REJECTED")), state)) == []
    after = pd.concat(_transitions((1,), events((1, "PENDING"), (3, "REJECTED")), state))
    assert after[["seq", "old_status", "new_status"]].values.tolist() == [[3, "VALIDATED", "REJECTED"]]


def test_late_events_are_kept_beside_the_log(spark):
    """Rate limited: one file a batch, the second with places the first has passed."""
    from greenledger.streaming.changelog import STORE, write_change_log

    source, log, late, offsets = (scratch_path(spark, n) for n in ("events", "log", "late", "offsets"))
    for rows in ([(1, 2, "PENDING"), (1, 3, "VALIDATED"), (2, 1, "PENDING")], [(1, 1, "REJECTED"), (1, 3, None), (1, 4, "PENDING"), (2, 2, "REJECTED")]):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    before = spark.conf.get(STORE, None)
    query = write_change_log(stream, log, late, offsets)
    query.awaitTermination()
    assert spark.conf.get(STORE, None) == before
    got = sorted(tuple(r)[:4] for r in spark.read.parquet(log).collect())
    assert got == [(1, 3, "PENDING", "VALIDATED"), (1, 4, "VALIDATED", "PENDING"), (2, 2, "PENDING", "REJECTED")]
    assert [tuple(r)[:3] for r in spark.read.parquet(late).collect()] == [(1, 1, "REJECTED")]


def test_silent_readings_are_forgotten(spark):
    """Reading 1 is silent for longer than its state is kept; reading 2 is not."""
    import time
    from datetime import timedelta

    from greenledger.streaming.changelog import write_change_log

    source, log, late, offsets = (scratch_path(spark, n) for n in ("events", "log", "late", "offsets"))
    rounds = [
        ([(1, 1, "PENDING")], 12), ([(2, 1, "PENDING")], 0), ([(1, 2, "VALIDATED"), (2, 2, "VALIDATED")], 0),
    ]
    states = []
    for rows, pause in rounds:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).parquet(source)
        query = write_change_log(stream, log, late, offsets, timedelta(seconds=10 if rows[0][0] == 1 and pause else 600))
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(pause)
    assert states == [1, 1, 2]  # the second batch forgets reading 1
    assert [tuple(r)[:4] for r in spark.read.parquet(log).collect()] == [(2, 2, "PENDING", "VALIDATED")]


def test_readings_share_states(spark):
    """Some states for all readings give the log and the late events that one state each gives, nulls and ties included."""
    import random

    from greenledger.streaming.changelog import write_change_log

    draw, names, source = random.Random(3), ["PENDING", "VALIDATED", "REJECTED", None], scratch_path(spark, "events")
    batches = [[(draw.choice([None, 2**60 + 1, *range(40)]), draw.choice([None, 2**55 + 1, *range(12)]), draw.choice(names))
                for _ in range(300)] for _ in range(3)]
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
    last, log, late = {}, [], []
    for rows in batches:
        for reading in {r[0] for r in rows}:
            status, passed = last.get(reading, (None, None))
            mine = [r for r in rows if r[0] == reading and r[1] is not None and r[2] is not None]
            late += [r for r in mine if passed is not None and r[1] <= passed]
            for _, seq, new in sorted((r for r in mine if passed is None or r[1] > passed), key=lambda r: r[1]):
                if status not in (None, new):
                    log.append((reading, seq, status, new))
                status, last[reading] = new, (new, seq)

    def ordered(rows):
        return sorted(rows, key=str)

    for shards in (None, 5):
        out, over, offsets = (scratch_path(spark, n) for n in ("log", "late", "offsets"))
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        query = write_change_log(stream, out, over, offsets, shards=shards)
        query.awaitTermination()
        assert ordered(tuple(r)[:4] for r in spark.read.parquet(out).collect()) == ordered(log)
        assert ordered(tuple(r)[:3] for r in spark.read.parquet(over).collect()) == ordered(late)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == (6 if shards else len(last))


def test_a_shared_state_forgets_its_silent_readings_only():
    import pandas as pd

    from greenledger.streaming.changelog import _marked

    class State:
        exists = hasTimedOut = False
        now, timeout = 1000, None
        getCurrentProcessingTimeMs = lambda self: self.now

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):
            self.timeout = self.now + ms

    def events(*rows):
        return iter([pd.DataFrame(rows, columns=["reading_id", "seq", "status"]).assign(placed=True)])

    state = State()
    list(_marked((0,), events((1, 1, "PENDING"), (2, 1, "PENDING")), state, 100))
    assert state.timeout == 1100
    state.now = 1060
    list(_marked((0,), events((2, 1, "PENDING")), state, 100))  # late, but not silent
    assert state.timeout == 1100
    state.now, state.hasTimedOut = 1101, True
    assert list(_marked((0,), iter([]), state, 100)) == [] and state.timeout == 1160
    state.hasTimedOut = False
    found = pd.concat(_marked((0,), events((1, 2, "VALIDATED"), (2, 2, "VALIDATED")), state, 100))
    assert found["reading_id"].tolist() == [2]
    state.now, state.hasTimedOut = 1202, True
    assert list(_marked((0,), iter([]), state, 100)) == [] and not state.exists
