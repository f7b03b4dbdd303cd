"""The start of an event with several listings while re-scrapes arrive, as one ordered scan.

A listing moves the start only if it is more than three hours off the start in effect, so
each row needs the state that the rows before it left. Rows are range-partitioned by
event and arrival, which spreads a hot event over many slices. What a slice makes of the
start that it is entered with is a step function of that start, no larger than the
different starts of six hours. The functions of an event are applied one after
the other, which tells the start in effect at the entry of every slice; then all slices are
scanned side by side.
"""

from bisect import bisect_right
from collections.abc import Iterator
from math import inf

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.config import FUZZY_WINDOW_MS
from marquee.session import cut, shipped


class Steps:
    """The start that some rows leave, by the start before them (both in microseconds).

    ``values`` belong to the milliseconds from ``starts`` on; None leaves the start as it
    is. Before ``low`` and from ``high`` on it is ``outside``.
    """

    def __init__(self, low: float = -inf, high: float = inf, starts: list | None = None, values: list | None = None, outside: int | None = None) -> None:
        self.low, self.high, self.outside = low, high, outside
        self.starts, self.values = ([-inf], [None]) if starts is None else (starts, values)

    def __call__(self, start: int) -> int:
        at = start // 1000
        value = self.values[bisect_right(self.starts, at) - 1] if self.low <= at < self.high else self.outside
        return start if value is None else value

    def after(self, row: int) -> "Steps":
        """The same rows with one before them: it changes every start that is not within three hours of it."""
        at = row // 1000
        low, high = at - FUZZY_WINDOW_MS, at + FUZZY_WINDOW_MS + 1
        inner_low, inner_high = max(low, self.low), min(high, self.high)
        pieces = [(low, self.outside)] if low < self.low else []
        if inner_low < inner_high:
            first = bisect_right(self.starts, inner_low) - 1
            inside = list(zip(self.starts[first:], self.values[first:], strict=True))
            pieces += [(inner_low, inside[0][1]), *[p for p in inside[1:] if p[0] < inner_high]]
        if self.high < high:
            pieces.append((max(low, self.high), self.outside))
        merged = [p for k, p in enumerate(pieces) if k == 0 or p[1] != pieces[k - 1][1]]
        return Steps(low, high, [s for s, _ in merged], [v for _, v in merged], self(row))


STEPS = "event_id string, slice int, first long, low long, high long, starts array<long>, values array<long>, outside long"


def steps_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The step function of one slice of an event."""
    rows, steps = rows.sort_values("seq"), Steps()
    for row in reversed(rows["micros"].tolist()):
        steps = steps.after(row)
    return pd.DataFrame([(rows["event_id"].iloc[0], rows["slice"].iloc[0], rows["first"].iloc[0], steps.low, steps.high, steps.starts, steps.values, steps.outside)], columns=[c.split()[0] for c in STEPS.split(", ")])


def entries(steps: pd.DataFrame) -> pd.DataFrame:
    """The start with which each slice of an event is entered."""
    steps = steps.sort_values("slice")
    start, entered = int(steps["first"].iloc[0]), []
    for low, high, starts, values, outside in zip(*(steps[c] for c in ("low", "high", "starts", "values", "outside")), strict=True):
        entered.append(start)
        start = int(Steps(low, high, list(starts), [None if v is None or v != v else int(v) for v in values], int(outside))(start))
    return pd.DataFrame({"event_id": steps["event_id"], "slice": steps["slice"], "entered": entered})


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``event_id, seq, effect, moved`` of rows in order: the start in effect from each row on, and whether it moved it."""
    held, start = None, 0
    for batch in batches:
        effects, moved = [], []
        for event, piece, entered, micros in zip(*(batch[c].tolist() for c in ("event_id", "slice", "entered", "micros")), strict=True):
            if (event, piece) != held:
                held, start = (event, piece), entered
            jumps = abs(micros // 1000 - start // 1000) > FUZZY_WINDOW_MS
            start = micros if jumps else start
            effects.append(start)
            moved.append(jumps)
        yield pd.DataFrame({"event_id": batch["event_id"], "seq": batch["seq"], "effect": effects, "moved": moved})


def starts_in_effect(rows: DataFrame) -> DataFrame:
    """``event_id, seq, starts_in_effect, moved`` for ``rows`` with ``event_id, seq, starts_at`` and ``first``, the event's start before them."""
    shipped(rows.sparkSession)
    kept = rows.select("event_id", "seq", F.unix_micros("starts_at").alias("micros"), F.unix_micros("first").alias("first"))
    ordered = kept.repartitionByRange("event_id", "seq").sortWithinPartitions("event_id", "seq")
    sliced = cut(ordered.withColumn("slice", F.spark_partition_id()))
    # At most the last event of a slice goes on in the next one.
    spread = sliced.groupBy("event_id").agg(F.min("slice").alias("low"), F.max("slice").alias("high")).filter("low < high")
    steps = cut(sliced.join(spread.select("event_id"), "event_id", "left_semi").groupBy("event_id", "slice").applyInPandas(steps_of, STEPS))
    entered = cut(steps.groupBy("event_id").applyInPandas(entries, "event_id string, slice int, entered long"))
    entering = sliced.join(entered, ["event_id", "slice"], "left").withColumn("entered", F.coalesce("entered", "first"))
    scanned = entering.select("event_id", "slice", "seq", "micros", "entered").repartition("event_id", "slice").sortWithinPartitions("event_id", "slice", "seq")
    out = scanned.mapInPandas(scan, "event_id string, seq long, effect long, moved boolean")
    return out.select("event_id", "seq", F.timestamp_micros("effect").alias("starts_in_effect"), "moved")
