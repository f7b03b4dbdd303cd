"""The ordered scan of re-scrapes equals going through them one by one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import drift
from marquee.operators.drift import Steps, starts_in_effect

T0 = dt.datetime(2024, 5, 1, 12)
HOUR = 3_600_000_000


def plain(start, rows):
    out = []
    for row in rows:
        moved = abs(row // 1000 - start // 1000) > 3 * HOUR // 1000
        start = row if moved else start
        out.append((start, moved))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_steps_tell_what_rows_make_of_any_start(seed):
    rng = random.Random(seed)
    for _ in range(60):
        spread = rng.choice([2, 7, 30])
        rows = [rng.randrange(-spread * 4, spread * 4) * HOUR // 4 + rng.randrange(2000) for _ in range(rng.randrange(1, 30))]
        steps = Steps()
        for row in reversed(rows):
            steps = steps.after(row)
        assert len(steps.starts) <= 2 * len(rows) + 1
        for _ in range(40):
            start = rng.randrange(-spread * 5, spread * 5) * HOUR // 5
            assert steps(start) == plain(start, rows)[-1][0]


@pytest.mark.parametrize("parts", [1, 7])
def test_scan_over_slices(spark, parts):
    rng, rows, want = random.Random(parts), [], {}
    for event in range(30):
        times = [T0 + dt.timedelta(minutes=rng.randrange(-600, 600)) for _ in range(400 if event == 3 else rng.randrange(1, 12))]
        rows += [(f"e{event}", 1000 * event + k, at, T0) for k, at in enumerate(times)]
        zero = dt.datetime(1970, 1, 1)
        micros = [int((at - zero) / dt.timedelta(microseconds=1)) for at in times]
        for k, (start, moved) in enumerate(plain(int((T0 - zero) / dt.timedelta(microseconds=1)), micros)):
            want[f"e{event}", 1000 * event + k] = (zero + dt.timedelta(microseconds=start), moved)
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "event_id string, seq long, starts_at timestamp, first timestamp")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["event_id"], r["seq"]): (r["starts_in_effect"], r["moved"]) for r in starts_in_effect(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want


def test_no_rows(spark):
    assert starts_in_effect(spark.createDataFrame([], "event_id string, seq long, starts_at timestamp, first timestamp")).count() == 0


def test_a_hot_event_is_scanned_in_slices(spark):
    """Each task sees a slice; of a slice only its steps go to the task that links them."""
    rows = spark.range(6000).select(F.lit("hot").alias("event_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 4 * 3600).alias("starts_at"), F.timestamp_seconds(F.lit(0)).alias("first"))
    out = starts_in_effect(rows)
    assert out.filter("starts_in_effect <> timestamp_seconds(seq * 14400)").count() == 0
    steps = Steps()
    for k in reversed(range(3000)):
        steps = steps.after(k * 4 * HOUR)
    assert len(steps.starts) <= 3 and drift.STEPS.startswith("event_id")
