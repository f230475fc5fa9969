from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import dialogs
from recallgrid.operators.ingest import touched
from recallgrid.session import passing_tables, shared_root, write_out
from recallgrid.sources import tables
from recallgrid.streaming import jobs

T0 = datetime(2024, 1, 1)


def feed(spark, folder, schema, batches):
    """Write one file a batch, oldest first, and stream one file at a time."""
    import os
    import time

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not name.startswith("seen"):
                os.rename(f"{folder}/{name}", f"{folder}/seen-{n}.parquet")
        os.utime(f"{folder}/seen-{n}.parquet", (time.time() - 100 + n,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "seen*").parquet(folder)


def test_ingest_over_batches_and_restart(spark, tmp_path):
    schema = "flight_id string, pos long, year int, month int, embedding array<double>"
    rows = [[("a", 1, 2013, 1, [1.0]), ("a", 2, 2013, 1, [2.0]), ("b", 3, 2013, 2, [1.0])],
            [("b", 4, 2013, 2, [9.0]), ("c", 5, 2014, 1, [1.0])]]
    index, progress = str(tmp_path / "index"), str(tmp_path / "progress")
    out = spark.createDataFrame([], schema).drop("pos").schema

    def run(batches, folder, checkpoint):
        stream = feed(spark, folder, schema, batches)
        jobs.drain(jobs.ingest_stream(stream, index, out, lambda df: df, 1, ["pos"]), checkpoint)
        return sorted((r.flight_id, r.embedding[0]) for r in tables.read_index(spark, index, out).collect())

    want = [("a", 2.0), ("b", 1.0), ("c", 1.0)]
    assert run(rows, str(tmp_path / "in"), progress) == want
    assert run(rows, str(tmp_path / "replay"), str(tmp_path / "lost")) == want  # progress lost, all input comes again


def test_ingest_reads_touched_partitions_only(spark, tmp_path):
    schema = "flight_id string, pos long, year int, month int"
    batches = [[("a", 1, 2013, 1), ("b", 2, 2013, 2)], [("a", 3, 2013, 1), ("c", 4, 2013, 3)], [("c", 5, 2013, 3), ("d", 6, 2014, 1)]]
    index, out = str(tmp_path / "index"), spark.createDataFrame([], schema).drop("pos").schema
    for run in ("first", "replay"):
        stream = feed(spark, str(tmp_path / run), schema, batches)
        jobs.drain(jobs.ingest_stream(stream, index, out, lambda df: df, None, ["pos"]), str(tmp_path / f"progress-{run}"))
        assert sorted(r.flight_id for r in tables.read_index(spark, index, out).collect()) == ["a", "b", "c", "d"]
    batch = spark.createDataFrame([("x", 2013, 2), ("y", 2013, 3), ("z", 2013, 2)], "flight_id string, year int, month int")
    known = tables.stored_ids(spark, index, out, batch=batch, partitions=["year", "month"])
    assert sorted(tuple(r) for r in known.collect()) == [(2013, 2, "b"), (2013, 3, "c")]
    scan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "PartitionFilters: []" not in scan and len(known.inputFiles()) > 2
    none = tables.stored_ids(spark, index, out, batch=batch.limit(0), partitions=["year", "month"])
    assert none.count() == 0


def test_touched_partitions(spark):
    batch = spark.createDataFrame([(2013, 1), (2014, 1), (2013, None), (None, 2)], "year int, month int")
    every = spark.createDataFrame([(y, m) for y in (2012, 2013, 2014, None) for m in (1, 2, None)], "year int, month int")
    got = {tuple(r) for r in every.filter(touched(batch, ["year", "month"])).collect()}
    assert got == {(2013, 1), (2014, 1), (2013, None), (None, 2)}
    assert every.filter(touched(batch, ["year", "month"], 2)).count() == 12  # too many to name, a null among them
    assert {r.year for r in every.filter(touched(batch.dropna(), ["year", "month"], 1)).collect()} == {2013, 2014, None}


def test_bookings_over_batches(spark, tmp_path):
    schema = ("request_id long, flight_id string, passenger_name string, idempotency_key string, "
              "requested_at timestamp_ntz, flight_snapshot_json string")
    row = lambda i, key: (i, "f", "n", key, T0 + timedelta(minutes=i), "{}")
    batches = [[row(1, "k"), row(2, "k"), row(3, None)], [row(4, "k"), row(5, None), row(6, "m")]]
    for n, watermark in enumerate((None, "1 hour")):
        log = str(tmp_path / f"log{n}")
        stream = feed(spark, str(tmp_path / f"in{n}"), schema, batches)
        jobs.drain(jobs.booking_stream(stream, log, watermark), str(tmp_path / f"progress{n}"))
        got = tables.read_bookings(spark, log).groupBy("idempotency_key").count().collect()
        assert {r[0]: r[1] for r in got} == {"k": 1, "m": 1, None: 2}


def test_batches_leave_no_passing_tables(spark, tmp_path):
    import os

    schema = ("request_id long, flight_id string, passenger_name string, idempotency_key string, "
              "requested_at timestamp_ntz, flight_snapshot_json string")
    batches = [[(i, "f", "n", f"k{i % 2}", T0 + timedelta(minutes=i), "{}")] for i in range(4)]
    outside = write_out(spark.range(3), "outside")
    before = set(os.listdir(shared_root(spark)))
    log = str(tmp_path / "log")
    stream = feed(spark, str(tmp_path / "in"), schema, batches)
    jobs.drain(jobs.booking_stream(stream, log, compact_every=2), str(tmp_path / "progress"))
    assert tables.read_bookings(spark, log).count() == 2
    assert set(os.listdir(shared_root(spark))) == before
    with pytest.raises(ZeroDivisionError), passing_tables(spark):
        inside = write_out(spark.range(2), "inside")
        assert inside.count() == 2 and outside.count() == 3
        raise ZeroDivisionError
    assert set(os.listdir(shared_root(spark))) == before and outside.count() == 3


def test_history_over_batches(spark, tmp_path):
    schema = "s string, n int, ts timestamp_ntz"
    at = lambda s, n, sec: (s, n, T0 + timedelta(seconds=sec))
    batches = [[at("a", 1, 0), at("a", 2, 3600), at("b", 3, 100)], [at("a", 4, 7000), at("b", 5, 7001)],
               [at("a", 6, 10_600), at("a", 7, 14_201), at("b", 8, 14_202)]]
    history, state = str(tmp_path / "history"), str(tmp_path / "state")
    jobs.drain(jobs.session_history_stream(feed(spark, str(tmp_path / "in"), schema, batches), "s", "ts", history, state),
               str(tmp_path / "progress"))
    got = jobs.read_history(spark, history, "s")
    zero = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    starts = {r.n: (r.started - zero) // 1_000_000 for r in got.collect()}
    assert starts == {1: 0, 2: 0, 4: 0, 6: 0, 7: 14_201, 3: 100, 5: 7001, 8: 14_202}


def test_history_in_any_order(spark, tmp_path):
    """Shuffled batches against the batch form over all messages on time; late ones and nulls are stored unmarked."""
    import os
    import random

    rng, ttl, delay = random.Random(7), 100, 400
    schema = "s string, n int, ts timestamp_ntz"
    clock = sorted(rng.randrange(0, 6000) for _ in range(400))
    # A third of the messages is of one session; arrival is up to 600 seconds off.
    rows = [("hot" if rng.random() < 0.34 else f"s{rng.randrange(12)}", n, sec) for n, sec in enumerate(clock)]
    arriving = sorted(rows, key=lambda r: r[2] + rng.randrange(0, 600))
    batches = [arriving[i : i + 60] for i in range(0, len(arriving), 60)]
    newest, on_time, late = None, [], set()
    for batch in batches:
        for r in batch:
            if newest is not None and r[2] < newest - delay:
                late.add(r[1])
            else:
                on_time.append(r)
        newest = max([x[2] for x in on_time])
    assert late and len(late) < 100
    want, by = {}, {}
    for s, n, sec in sorted(on_time, key=lambda r: r[2]):
        start, last = by.get(s, (sec, sec))
        by[s] = (sec if sec - last > ttl else start, sec)
        want[n] = by[s][0]
    stamped = [[(s, n, T0 + timedelta(seconds=sec)) for s, n, sec in b] for b in batches]
    stamped[2] += [(None, 1000, T0), ("hot", 1001, None)]
    history, state = str(tmp_path / "history"), str(tmp_path / "state")
    writer = jobs.session_history_stream(
        feed(spark, str(tmp_path / "in"), schema, stamped), "s", "ts", history, state, ttl, lateness_seconds=delay)
    jobs.drain(writer, str(tmp_path / "progress"))
    got = jobs.read_history(spark, history, "s").collect()
    zero = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert len(got) == 402 and {r.n for r in got if r.late and r.s} == late
    assert {r.n: (r.started - zero) // 1_000_000 for r in got if r.started is not None} == want
    # Two folders of state, and in the last only slots of its batch or within lateness and ttl.
    assert sorted(os.listdir(state)) == [str(len(batches) - 2), str(len(batches) - 1)]
    assert spark.read.parquet(f"{state}/{len(batches) - 1}").count() < 13 * 13


def test_closed_sessions(spark, tmp_path):
    schema = "u int, ts timestamp"
    rows = [(1, T0 + timedelta(seconds=s)) for s in (0, 100, 9000)] + [(2, T0 + timedelta(days=2))]
    closed = jobs.idle_session_stream(feed(spark, str(tmp_path / "in"), schema, [rows]), "u", "ts", "1 hour")
    sink = str(tmp_path / "out")
    jobs.drain(closed.writeStream.format("parquet").option("path", sink).outputMode("append"), str(tmp_path / "progress"))
    got = sorted((r.u, r.n_events) for r in spark.read.schema(closed.schema).parquet(sink).collect())
    batch = dialogs.idle_sessions(spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "u", "ts")
    assert got == [(1, 1), (1, 2)] and batch.count() == 3


def test_a_batch_is_computed_once(spark, tmp_path, monkeypatch):
    """What reads a batch after that reads the files it was written to; they are removed with the batch."""
    schema, seen, stored = "flight_id string, pos long, year int, month int", [], tables.stored_ids

    def told(spark, index, schema, key, batch, partitions):
        seen.append(len(batch.inputFiles()))
        return stored(spark, index, schema, key, batch, partitions)

    monkeypatch.setattr(jobs.tables, "stored_ids", told)
    index, out = str(tmp_path / "index"), spark.createDataFrame([], schema).drop("pos").schema
    stream = feed(spark, str(tmp_path / "in"), schema, [[("a", 1, 2013, 1)]])
    jobs.drain(jobs.ingest_stream(stream, index, out, lambda df: df, None, ["pos"]), str(tmp_path / "progress"))
    assert seen and all(seen) and tables.read_index(spark, index, out).count() == 1
