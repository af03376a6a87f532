from pyspark.sql import functions as F

from foliospark.operators import publish
from foliospark.streaming import tasks

PATCH = "path string, operation string, expected_hash string, content string"


def test_commit_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([("a.md", "create", None, "A"), ("b.md", "create", None, "B")], PATCH)
    assert publish.commit(spark, root, first).count() == 0
    have = {r.path: r.file_hash for r in publish.current(spark, root).collect()}
    bad = spark.createDataFrame([("a.md", "replace", "stale", "A2"), ("c.md", "create", None, "C")], PATCH)
    assert [(r.path, r.error) for r in publish.commit(spark, root, bad).collect()] == [("a.md", "HASH_MISMATCH")]
    assert {r.path for r in publish.current(spark, root).collect()} == {"a.md", "b.md"}
    good = spark.createDataFrame([("a.md", "replace", have["a.md"], "A2"), ("b.md", "remove", have["b.md"], None), ("c.md", "create", None, "C")], PATCH)
    assert publish.commit(spark, root, good).count() == 0
    assert {r.path: r.content for r in publish.current(spark, root).collect()} == {"a.md": "A2", "c.md": "C"}
    twice = spark.createDataFrame([("d.md", "create", None, "1"), ("d.md", "create", None, "2")], PATCH)
    assert {r.error for r in publish.commit(spark, root, twice).collect()} == {"DUPLICATE_PATH"}


def _stream(spark, tmp_path, name, make):
    source = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(1).write.parquet(source)
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    q = make(events).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_triggers_equal_their_batch_twin(spark, tmp_path):
    from foliospark.plans import knowledge

    got = {(r.event_id, r.win) for r in _stream(spark, tmp_path, "windows", tasks.triggers).collect()}
    want = {(r.event_id, r.win) for r in knowledge.count_or_timeout_windows(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_leases(spark, tmp_path):
    got = _stream(spark, tmp_path, "leases", tasks.leases)
    assert got.where("granted").count() > 0
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).orderBy("at", "event_id").collect()
    until, want = {}, set()
    for r in e:
        if r.at >= until.get(r.user_id, 0):
            want.add(r.event_id)
            until[r.user_id] = r.at + 30 * 60_000_000
    assert {r.event_id for r in got.where("granted").collect()} == want


def test_first_requests(spark, tmp_path):
    got = _stream(spark, tmp_path, "firsts", lambda e: tasks.first_requests(e.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], keep="400 days"))
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type").distinct().count()
    assert got.count() == n


def test_timer_closes_a_quiet_window(spark, tmp_path):
    """A query that runs on tells the number of a window that no event closed."""
    import time

    source = str(tmp_path / "in")
    spark.sql("SELECT 7L AS event_id, current_timestamp() AS ts, 1L AS user_id").write.parquet(source)
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(source)
    q = tasks.triggers(events, seconds=1, timer=True).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("quiet").count() < 2:
            time.sleep(0.5)
        assert {(r.event_id, r.win) for r in spark.table("quiet").collect()} == {(7, 1), (None, 1)}
    finally:
        q.stop()
