import datetime
import time

from pricelattice.plans.queries import QUERIES


def test_ingest_keeps_files_out_of_order(spark, tmp_path):
    """Eight part files, newest day first: nothing is lost, nothing is twice."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(days=k * 7 % 80, hours=k % 5), k % 9, "abc"[k % 3], 1.0) for k in range(600)]
    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    for part in range(8):
        some = sorted(rows, key=lambda r: r[1], reverse=True)[part::8] if part % 2 else [r for k, r in enumerate(rows) if k % 8 == part]
        spark.createDataFrame(some, columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    one = spark.createDataFrame([(600, start - datetime.timedelta(days=400), 5, "late", 1.0)], columns)
    one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    want = sorted({(r.user_id % 80, r.event_type, r.ts.date()) for r in spark.read.parquet(f"{tmp_path}/events.parquet").collect()})
    got = QUERIES["stream_ingest"](spark, str(tmp_path))
    assert sorted((r.store_id, r.event_type, r.day) for r in got.collect()) == want


def events(spark, path, parts):
    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    for k, rows in enumerate(parts):
        spark.createDataFrame([(k * 1000 + j, *r) for j, r in enumerate(rows)], columns).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")


def test_a_silent_store_is_told_by_its_timer(spark, tmp_path):
    """Store 1 stops early and is never heard again; store 2 pauses twice; views are no sign of life; rows within two days may come late."""
    day = datetime.datetime(2024, 1, 1)
    at = lambda m: day + datetime.timedelta(minutes=m)
    one = [(at(0), 1, "click", 1.0), (at(29), 1, "click", 1.0), (at(40), 1, "view", 1.0)]
    two = [(at(m), 2, "click", 1.0) for m in (0, 20, 51, 81, 81, 200)]
    far = [(at(60 * 24 * 3), 3, "click", 1.0)]
    events(spark, tmp_path, [[two[3], two[0]], one[1:], [two[1], two[2], one[0]], two[4:], far])
    from pricelattice.streaming import jobs

    got = sorted((r.store_id, r.beat, r.silent_at) for r in jobs.silent_stores(jobs.runs_stream(spark, str(tmp_path))).collect())
    assert got == [(s, at(m), at(m + 30)) for s, m in ((1, 29), (2, 20), (2, 81), (2, 200))]


def test_weeks_close_once(spark, tmp_path):
    from pricelattice.streaming import jobs

    monday = datetime.datetime(2024, 1, 1)
    at = lambda d: monday + datetime.timedelta(days=d)
    idle = [(at(9), 9, "a", 1.0)]
    first = [[(at(0.5), 1, "a", 2.0), (at(8), 1, "a", 5.0)], [(at(1), 1, "a", 4.0)], idle, idle]
    events(spark, tmp_path, [*first, [(at(10), 1, "a", 1.0)], [(at(9.5), 1, "a", 3.0)], *[idle] * 6, [(at(0.2), 1, "a", 99.0)]])
    late = []
    got = sorted(map(tuple, jobs.closed_weeks(jobs.runs_stream(spark, str(tmp_path)), late=late).collect()))
    assert got == [(1, monday.date(), 3.0, 2)] and late == [1]


def test_a_store_with_many_beats_is_settled_at_once(spark, tmp_path):
    """20,000 beats of one store in one file, a silence after every hundredth: the state is a row a session, not a beat."""
    start = datetime.datetime(2024, 1, 1)
    seconds = [k * 10 + (k // 100) * 1801 for k in range(20_000)]
    rows = [(start + datetime.timedelta(seconds=s), 1, "click", 1.0) for s in seconds]
    events(spark, tmp_path, [rows])
    from pricelattice.streaming import jobs

    begun = time.monotonic()
    got = sorted(r.beat for r in jobs.silent_stores(jobs.runs_stream(spark, str(tmp_path))).collect())
    reached = rows[-1][0] - datetime.timedelta(days=2, seconds=1800)
    assert got == [r[0] for r in rows[99::100] if r[0] <= reached]
    assert time.monotonic() - begun < 120  # a look at all beats for each of them takes hours
