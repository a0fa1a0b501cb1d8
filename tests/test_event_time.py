"""Event-time features, repeated and late rows, keyed buffers, malformed lines."""

import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigee.sources import telemetry
from perigee.streaming import event_time, keyed, live

SCHEMA = "seq long, ts timestamp, ApId int, MsgId int, MsgLength double"
START = dt.datetime(2024, 5, 1, 12, 0, 0)


def some_rows(n, seed=1, step=7):
    rng = random.Random(seed)
    return [
        (i, START + dt.timedelta(seconds=step * i + rng.random()), rng.choice([1, 1, 1, 2, None]), rng.randrange(4), rng.choice([1.0, 2.5, 40.0, None]))
        for i in range(n)
    ]


def feed(table, tmp_path, parts):
    """A folder with one file per part, in order."""
    for part in parts:
        table(SCHEMA, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def run(spark, rows, tmp_path, name="out"):
    query = live.write_stream(rows, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
    query.awaitTermination()
    return query, spark.read.schema(rows.schema).parquet(str(tmp_path / name))


def features_by_hand(rows, size, slide):
    windows = defaultdict(list)
    for row in rows:
        start = row[1].timestamp() // slide * slide
        while start > row[1].timestamp() - size:
            windows[start, row[2]].append(row)
            start -= slide
    out = {}
    for (start, key), held in windows.items():
        lengths = [r[4] for r in held if r[4] is not None]
        times = sorted(r[1].timestamp() for r in held)
        out[start, key] = (
            sum(lengths), len(held), len({r[3] for r in held}), statistics.fmean(lengths) if lengths else None, len(held) / size,
            statistics.pstdev(lengths) if lengths else None, (times[-1] - times[0]) / (len(times) - 1) if len(times) > 1 else None,
        )
    return out


def as_found(df):
    return {(r.window_start.timestamp(), r.ApId): tuple(r)[3:] for r in df.collect()}


def test_batch_features_equal_a_loop(spark, table):
    rows = some_rows(400)
    found = as_found(event_time.window_features(event_time.in_time(table(SCHEMA, rows + rows[:50])), size="10 minutes", slide="5 minutes"))
    wanted = features_by_hand(rows, 600, 300)
    assert found.keys() == wanted.keys()
    for at in wanted:
        assert found[at] == pytest.approx(wanted[at], abs=1e-6), at


def test_stream_equals_batch_over_closed_windows_and_repeated_deliveries(spark, table, tmp_path):
    rows = some_rows(400)
    path = feed(table, tmp_path, [rows[:150], rows[100:300], rows[250:], rows[380:]])
    stream = live.read_stream(spark, path, T._parse_datatype_string(SCHEMA), files_per_batch=1)
    timed = event_time.in_time(stream, delay="20 minutes")
    query, found = run(spark, event_time.window_features(timed, size="10 minutes", slide="5 minutes"), tmp_path)
    closed = max(r[1] for r in rows).timestamp() - 1200
    wanted = {at: v for at, v in features_by_hand(rows, 600, 300).items() if at[0] + 600 <= closed}
    got = as_found(found)
    assert got.keys() == wanted.keys() and len(wanted) > 5
    for at in wanted:
        assert got[at] == pytest.approx(wanted[at], abs=1e-6)
    account = event_time.accounts(query)
    assert (account.seen, account.late + account.repeated, account.used) == (520, 120, 400)


def test_late_rows_are_counted(spark, table, tmp_path):
    rows = some_rows(100, step=60)
    path = feed(table, tmp_path, [rows[50:], rows[99:], rows[:50]])
    stream = live.read_stream(spark, path, T._parse_datatype_string(SCHEMA), files_per_batch=1)
    query, found = run(spark, event_time.in_time(stream, delay="5 minutes").select("seq"), tmp_path)
    account = event_time.accounts(query)
    assert account == event_time.Accounts(seen=101, late=50, repeated=1)
    assert sorted(r.seq for r in found.collect()) == list(range(50, 100))


def test_rows_without_time_or_key_are_set_apart(table):
    whole, without = event_time.timeless(table(SCHEMA, [(1, START, 1, 1, 1.0), (None, START, 1, 1, 1.0), (2, None, 1, 1, 1.0)]))
    assert whole.count() == 1 and without.count() == 2


def test_sessions(spark, table):
    times = [0, 60, 119, 300, 301, 1000]
    rows = [(i, START + dt.timedelta(seconds=s), 1, 1, float(i)) for i, s in enumerate(times)] + [(9, START, 2, 1, None)]
    found = {(r.ApId, r.session_start): (r.n, r.total) for r in event_time.sessions(table(SCHEMA, rows)).collect()}
    at = lambda s: START + dt.timedelta(seconds=s)
    assert found == {(1, at(0)): (3, 3.0), (1, at(300)): (2, 7.0), (1, at(1000)): (1, 5.0), (2, at(0)): (1, 0.0)}


def newest_by_hand(rows, size):
    held = defaultdict(dict)
    for row in rows:
        if row[2] is not None:
            held[row[2]][row[0]] = row
    return sorted((key, *r[:2]) for key, by_seq in held.items() for r in [by_seq[s] for s in sorted(by_seq, reverse=True)[:size]])


def test_keyed_buffers_over_a_restart(spark, table, tmp_path):
    rows = some_rows(120)
    for upto, parts in ((70, [rows[:30], rows[20:70]]), (120, [rows[60:120]])):
        path = feed(table, tmp_path, parts)
        stream = live.read_stream(spark, path, T._parse_datatype_string(SCHEMA), files_per_batch=1)
        before = spark.conf.get(keyed.PROVIDER, None)
        keyed.start_latest(stream, "ApId", ["seq", "ts"], 5, str(tmp_path / "kept"), str(tmp_path / "checkpoint")).awaitTermination()
        assert spark.conf.get(keyed.PROVIDER, None) == before
        found = keyed.newest(spark, str(tmp_path / "kept"), "ApId").collect()
        assert sorted(map(tuple, found)) == newest_by_hand(rows[:upto], 5)


def test_keyed_buffers_forget_silent_keys(spark, table, tmp_path):
    rows = [(i, START, i % 2, 1, 1.0) for i in range(6)]
    feed_path = feed(table, tmp_path, [rows])

    def once():
        stream = live.read_stream(spark, feed_path, T._parse_datatype_string(SCHEMA), files_per_batch=1)
        keyed.start_latest(stream, "ApId", ["seq"], 9, str(tmp_path / "kept"), str(tmp_path / "checkpoint"), ttl_ms=1).awaitTermination()

    once()
    feed(table, tmp_path, [[(100, START, 1, 1, 1.0)]])
    once()
    found = {(r.ApId, r.seq) for r in spark.read.parquet(str(tmp_path / "kept")).where("batch = 1").collect()}
    assert found == {(1, 100)}


def test_cut_batch_keeps_what_may_stay(table):
    rows = some_rows(500)
    cut = keyed.cut_batch(table(SCHEMA, rows).where("ApId IS NOT NULL"), "ApId", 4)
    assert sorted((r.ApId, r.seq, r.ts) for r in cut.collect()) == newest_by_hand(rows, 4)


LINES = ["seq,MsgId,Label", "1,2.5,3", "2,word,3", "3,1.0", "4,1,2,9", "", "5,,", "x,1,1", "6,1e3,4", "other,header,here"]
LINE_SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("MsgId", T.DoubleType()), T.StructField("Label", T.IntegerType())])


def split(checked):
    good = sorted(map(tuple, telemetry.good_rows(checked).collect()))
    return good, sorted(map(tuple, telemetry.malformed_rows(checked).collect()))


GOOD = [(1, 2.5, 3), (5, None, None), (6, 1000.0, 4)]
BAD = sorted([
    ("2,word,3", "a field is not of its type"), ("3,1.0", "2 fields instead of 3"), ("4,1,2,9", "4 fields instead of 3"),
    ("x,1,1", "a field is not of its type"), ("other,header,here", "a field is not of its type"),
])


def test_malformed_lines_in_a_batch(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(LINES) + "\n")
    checked = telemetry.read_csv_checked(spark, str(tmp_path / "a.csv"), LINE_SCHEMA)
    assert split(checked) == (GOOD, BAD)
    # The split holds whatever columns are asked for.
    assert telemetry.good_rows(checked).select("Label").count() == 3 and telemetry.malformed_rows(checked).select("raw_line").count() == 5


def test_malformed_lines_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.csv").write_text("\n".join(LINES) + "\n")
    checked = telemetry.stream_csv_checked(spark, str(tmp_path / "in"), LINE_SCHEMA, files_per_batch=1)
    _, found = run(spark, checked, tmp_path)
    assert split(found) == (sorted(GOOD * 2), sorted(BAD * 2))


def test_other_separators(spark):
    lines = spark.createDataFrame([("1;2;3",), ("1|2|3",)], "value string")
    good, bad = split(telemetry.check_lines(lines, LINE_SCHEMA, ";"))
    assert good == [(1, 2.0, 3)] and bad == [("1|2|3", "1 fields instead of 3")]
    assert telemetry.check_lines(lines.limit(0), LINE_SCHEMA).count() == 0
    assert telemetry.check_lines(lines.select(F.lit(None).cast("string").alias("value")), LINE_SCHEMA).count() == 0
