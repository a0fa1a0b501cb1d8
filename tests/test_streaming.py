import pytest
from pyspark.sql import functions as F

from perigee.operators import gate as gt
from perigee.operators import order, profile
from perigee.plans.triage import JSON_OPTIONS, flatten_incidents, triage, triage_or_quarantine
from perigee.streaming import live

NAMES = ["MsgLength", "CmdCode"]
STATS = {"MsgLength": (0.0, 10.0), "CmdCode": (0.0, 100.0)}


def rows(spark, first, last):
    return spark.range(first, last).select(
        F.col("id").alias("seq"),
        (F.col("id") * 37 % 101).cast("double").alias("MsgLength"),
        (F.col("id") % 7).cast("double").alias("CmdCode"),
        (F.col("id") % 5).cast("int").alias("Label"),
        (F.col("id") % 5).cast("int").alias("predicted_label"),
        (F.col("id") % 100 / F.lit(100.0)).alias("confidence"),
        F.timestamp_seconds("id").alias("ts"),
    )


@pytest.fixture
def feed(spark, tmp_path):
    """A growing folder: ``add(first, last)`` drops one more file; ``stream()`` reads it."""

    class Feed:
        path = str(tmp_path / "in")
        out = str(tmp_path / "out")
        checkpoint = str(tmp_path / "checkpoint")

        def add(self, first, last):
            rows(spark, first, last).coalesce(1).write.mode("append").parquet(self.path)

        def stream(self):
            return live.read_stream(spark, self.path, rows(spark, 0, 1).schema, files_per_batch=1)

        def batch(self):
            return spark.read.parquet(self.path)

    return Feed()


def test_stream_gate_equals_batch(feed, spark):
    feed.add(0, 200), feed.add(200, 450)
    live.write_stream(gt.gate(feed.stream(), STATS, NAMES), feed.out, feed.checkpoint).awaitTermination()
    got = spark.read.parquet(feed.out)
    assert got.exceptAll(gt.gate(feed.batch(), STATS, NAMES)).count() == 0 and got.count() == 450


def test_restarted_triage_gives_each_incident_once(feed, spark):
    def run():
        incidents = flatten_incidents(triage(feed.stream(), STATS, NAMES))
        live.write_stream(incidents, feed.out, feed.checkpoint).awaitTermination()

    feed.add(0, 200)
    run()
    run()
    feed.add(200, 300)
    run()
    got = spark.read.parquet(feed.out)
    expected = flatten_incidents(triage(feed.batch(), STATS, NAMES))
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    assert got.select("seq").distinct().count() == got.count() > 0


def test_incidents_stream_to_json(feed, spark):
    feed.add(0, 60)
    incidents = triage(feed.stream(), STATS, NAMES)
    live.write_stream(incidents, feed.out, feed.checkpoint, fmt="json", **JSON_OPTIONS).awaitTermination()
    assert '"reviewer_id":null' in spark.read.text(feed.out).first().value
    assert spark.read.schema(incidents.schema).json(feed.out).count() == triage(feed.batch(), STATS, NAMES).count()


def test_counters_go_on_over_restarts(feed, spark):
    for first, last in [(0, 100), (100, 250)]:
        feed.add(first, last)
        live.start_counters(feed.stream(), STATS, NAMES, feed.out, feed.checkpoint).awaitTermination()
    row = live.Versions(feed.out).read(spark, "counters").first()
    assert row.seen == 250
    assert row.escalated == gt.gate(feed.batch(), STATS, NAMES).where("escalate").count()


def test_live_view_equals_batch_tail(feed, spark):
    view = live.LiveView(feed.out, rows(spark, 0, 1).schema, 30, ["MsgLength", "absent"], 25)
    for first, last in [(0, 20), (20, 27), (27, 90), (90, 100)]:
        feed.add(first, last)
        query = view.start(feed.stream(), feed.checkpoint)
        query.awaitTermination()
    tail = order.last_rows(feed.batch(), 30)
    assert sorted(view.read(spark, "buffer").select("seq").collect()) == sorted(tail.select("seq").collect())
    assert sorted(view.read(spark, "label_mix").collect()) == sorted(profile.label_mix(tail).collect())
    history = view.read(spark, "history")
    assert history.columns == ["seq", "MsgLength"]
    assert sorted(r.seq for r in history.collect()) == list(range(75, 100))


def test_live_view_batch_run_twice_changes_nothing(feed, spark):
    view = live.LiveView(feed.out, rows(spark, 0, 1).schema, 10, ["MsgLength"], 10)
    view.update(rows(spark, 0, 8), 0)
    view.update(rows(spark, 8, 14), 1)
    before = sorted(view.read(spark, "buffer").collect())
    view.update(rows(spark, 8, 14), 1)
    assert sorted(view.read(spark, "buffer").collect()) == before and len(before) == 10


def test_restart_without_data_gives_the_last_state_and_old_versions_go(feed, spark):
    view = live.LiveView(feed.out, rows(spark, 0, 1).schema, 5, ["MsgLength"], 5)
    for first in range(0, 40, 10):
        feed.add(first, first + 10)
        view.start(feed.stream(), feed.checkpoint).awaitTermination()
    view.start(feed.stream(), feed.checkpoint).awaitTermination()
    assert sorted(r.seq for r in view.read(spark, "buffer").collect()) == list(range(35, 40))
    assert view.versions._pointers(spark) and len(view.versions._pointers(spark)) <= 2


def test_a_version_without_its_pointer_is_not_read(spark, tmp_path):
    versions = live.Versions(str(tmp_path / "v"))
    with pytest.raises(ValueError):
        versions.read(spark, "t")
    versions.save({"t": spark.range(3)}, 0)
    spark.range(9).write.parquet(versions.folder("t", 1))  # as if stopped before the pointer
    assert versions.read(spark, "t").count() == 3
    versions.save({"t": spark.range(9)}, 1)
    assert versions.read(spark, "t").count() == 9


def test_quarantine_on_a_stream_equals_batch(feed, spark):
    feed.add(0, 120)
    def checked(df):
        return triage_or_quarantine(df.withColumn(NAMES[0], F.when(F.col("seq") % 7 != 0, F.col(NAMES[0]))), STATS, NAMES).select("seq", "status", "reason")
    live.write_stream(checked(feed.stream()), feed.out, feed.checkpoint).awaitTermination()
    got, batch = spark.read.parquet(feed.out), checked(feed.batch())
    assert got.exceptAll(batch).count() == batch.exceptAll(got).count() == 0
    assert got.where("status = 'ERROR'").count() == 18
