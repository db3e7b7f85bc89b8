"""Folds of events, and the same folds over a stream."""

from hypothesis import given
from hypothesis import strategies as st

from pagewright.streaming import jobs

EVENT = st.tuples(st.sampled_from(["queued", "running", "succeeded", "failed", "cancel_requested", "cancelled"]), st.one_of(st.none(), st.integers(-10, 150)))


def run(events):
    state = None
    for status, progress in events:
        state = jobs.step(state, {"status": status, "progress": progress})
    return state


def test_terminal_states_stay():
    assert run([("failed", 10), ("succeeded", 100)])["status"] == "failed"


def test_running_progress_never_falls():
    assert run([("running", 60), ("running", 30)])["progress"] == 60


def test_cancel_requests_stick():
    assert run([("cancel_requested", 0), ("running", 5)])["status"] == "cancel_requested"
    assert run([("cancel_requested", 0), ("cancelled", 5)])["status"] == "cancelled"


@given(st.lists(EVENT, min_size=1, max_size=12))
def test_progress_is_clamped(events):
    assert 0 <= run(events)["progress"] <= 100


def test_leases():
    active = {}

    def at(ts, action, task, who):
        return jobs.admit(active, {"ts": ts, "action": action, "task_id": task, "identity_id": who})

    assert [at(0, "acquire", t, w) for t, w in (("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", "y"), ("f", "z"))] == ["ACQUIRED", "ACQUIRED", "IDENTITY_CAPACITY_EXHAUSTED", "ACQUIRED", "ACQUIRED", "GLOBAL_CAPACITY_EXHAUSTED"]
    assert at(10, "acquire", "a", "x") == "ALREADY_ACQUIRED"
    assert at(600, "acquire", "f", "z") == "GLOBAL_CAPACITY_EXHAUSTED"  # one that expires just now still counts
    assert at(601, "acquire", "f", "z") == "ACQUIRED"
    assert at(602, "release", "f", "x") == "MISMATCH" and at(602, "release", "f", "z") == "RELEASED" and at(602, "release", "f", "z") == "NO_OP"
    assert at(602, "renew", "a", "x") == "RENEWED" and at(9999, "renew", "a", "x") == "EXPIRED"


def test_sessions(spark):
    rows = [(1, 0.0, "create", "h", 0), (2, 5.0, "create", "h", 0), (3, 10.0, "get", "h", 0), (4, 3000.0, "get", "h", 0), (5, 3001.0, "delete", "h", 0)]
    rows += [(100 + i, 4000.0 + i, "create", f"k{i}", 0) for i in range(33)] + [(200, 4100.0, "get", "k0", 0)]
    e = spark.createDataFrame(rows, "event_no long, ts double, action string, sha256 string, shard int")
    got = {r.event_no: r.outcome for r in jobs.session_outcomes(e).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 200)] == ["created", "reused", "found", "missing", "missing", "missing"]


def test_rendered_pages_are_kept_with_their_session(spark, tmp_path):
    steps = [("page", 1, 72.0), ("create", None, None), ("page", 1, 72.0), ("page", 1, 72.0), ("page", 1, 96.0), ("delete", None, None), ("create", None, None), ("page", 1, 72.0)]
    schema = "event_no long, ts double, action string, sha256 string, page int, dpi double, shard int"
    rows = [(i, float(i), a, "h", p, dpi, 0) for i, (a, p, dpi) in enumerate(steps)]
    want = ["missing", "created", "rendered", "cached", "rendered", "deleted", "created", "rendered"]
    assert [r.outcome for r in jobs.session_outcomes(spark.createDataFrame(rows, schema)).orderBy("event_no").collect()] == want
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.stream_sessions(events).writeStream.outputMode("append").format("memory").queryName("session_visits").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.outcome for r in spark.sql("SELECT * FROM session_visits ORDER BY event_no").collect()] == want


def test_stream_gives_the_states_of_the_batch(spark, tmp_path):
    rows = [(f"j{i % 7}", i, i, ["queued", "running", "running", "succeeded", "failed", "cancel_requested"][(i * 5) % 6], (i * 37) % 130) for i in range(120)]
    schema = "job_id string, ts long, event_no long, status string, progress int"
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.stream_jobs(events).writeStream.outputMode("update").format("memory").queryName("job_states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = {}
    for r in spark.sql("SELECT * FROM job_states").collect():
        if r.job_id not in streamed or r.updates >= streamed[r.job_id].updates:
            streamed[r.job_id] = r
    batch = {r.job_id: r for r in jobs.fold_jobs(spark.createDataFrame(rows, schema)).collect()}
    assert {k: tuple(v) for k, v in streamed.items()} == {k: tuple(v) for k, v in batch.items()}


def test_nonces_are_accepted_once(spark):
    e = spark.createDataFrame([(1, 100, "n", 100), (2, 101, "n", 101), (3, 102, "m", 9000), (4, 103, "m", 103)], "event_no long, ts long, nonce string, request_ts long")
    assert {r.event_no: r.accepted for r in jobs.accepted_requests(e).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_stream_accepts_nonces_once(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2031, 1, 1)
    rows = [(start + timedelta(seconds=i), f"n{i % 4}", start + timedelta(seconds=i - (900 if i == 3 else 0))) for i in range(12)]
    schema = "at timestamp, nonce string, request_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = jobs.stream_accepted(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("nonces").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.nonce for r in spark.sql("SELECT nonce FROM nonces").collect()) == ["n0", "n1", "n2", "n3"]
