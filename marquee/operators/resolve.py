"""Resolve a batch of new listings into events, in arrival order.

A listing joins an earlier compatible event or founds one. Only founders can be
joined, so founders are the lexicographically first maximal independent set of
the match graph. The graph is never written out:

* Listings with equal title, city, time and fingerprint behave alike; only the
  earliest matters, so copies collapse in a map-side aggregate.
* ``segments`` cuts the rest into parts that no match crosses: the time line of each
  family of similar titles in a city is cut where a three-hour block is empty, and parts that
  share a fingerprint are joined again.
* Segments of at most ``SEGMENT`` listings are folded in arrival order, many of them
  in one task (``fold``); a batch that is no larger is one segment. The listings pass through the
  task in a stream, which keeps only the founders of the segment at hand.
* Larger segments are taken in slices of the arrival order of about that size. Of each slice, what an
  earlier founder matches is dropped by a join, and the rest is folded. So a listing is
  moved in one slice only, however long the chains of listings that depend on each other are.
"""

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.config import FUZZY_WINDOW_MS
from marquee.operators.components import components
from marquee.operators.linkage import BLOCK_KEY, closest, in_window, keyed_events, near_blocks, similar_titles, with_block
from marquee.session import cut, shipped

#: Listings (copies counted once) of the largest segment that is folded in a task, and of a task's segments together, about.
SEGMENT, BUCKET = 500_000, 50_000


def event_id(url):
    """Reruns give the same event the same id."""
    return F.sha2(url, 256)


def _drop_matched(rows: DataFrame, founders: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows that no founder matches."""
    reach = near_blocks(founders.select(*BLOCK_KEY, "starts_ms"), titles).select(*BLOCK_KEY, F.col("starts_ms").alias("founder_ms"))
    f = reach.distinct().alias("f")
    r = rows.alias("r")
    same_block = [F.col(f"r.{c}") == F.col(f"f.{c}") for c in BLOCK_KEY]
    near = same_block[0] & same_block[1] & same_block[2] & in_window(F.col("r.starts_ms"), F.col("f.founder_ms"))
    return r.join(f, near, "left_anti").join(founders.select("fingerprint"), "fingerprint", "left_anti")


FOUNDER = ["seq", "id", "fingerprint", *BLOCK_KEY, "starts_ms"]


def segments(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """The rows with the ``segment`` they belong to; rows that match are of one segment.

    Titles and segments are told apart by 64-bit hashes: two that agree by chance are one
    segment, which only makes it larger.
    """
    title = F.xxhash64("city", "title_key")
    near = titles.filter("title_key <> other_key").select(title.alias("a"), F.xxhash64("city", "other_key").alias("b"))
    families = components(near).select(F.col("node").alias("title"), F.col("component").alias("family"))
    # A segment follows from title and block, so only these and the fingerprints are moved until then.
    cells = rows.select(title.alias("title"), "block", "fingerprint").distinct()
    placed = cut(cells.join(families, "title", "left").withColumn("family", F.coalesce("family", "title")))
    # Blocks that follow each other without a gap share the difference of number and rank.
    taken = placed.select("family", "block").distinct()
    rank = F.row_number().over(W.partitionBy("family").orderBy("block"))
    islands = cut(taken.select("family", "block", F.xxhash64("family", F.col("block") - rank).alias("segment")))
    cut_up = cut(placed.join(islands, ["family", "block"]).drop("family"))
    seen = cut_up.select("fingerprint", "segment").distinct()
    shared = seen.groupBy("fingerprint").agg(F.min("segment").alias("a"), F.max("segment").alias("last")).filter("a < last")
    whole = components(seen.join(shared, "fingerprint").select("a", F.col("segment").alias("b")))
    joined = cut_up.select("title", "block", "segment").distinct().join(whole, F.col("segment") == F.col("node"), "left")
    joined = cut(joined.select("title", "block", F.coalesce("component", "segment").alias("segment")))
    return rows.withColumn("title", title).join(joined, ["title", "block"]).drop("title")


def earliest_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The listings that match no founder before them in their segment.

    Of each bucket, the rows with an ``other_key`` for each ``city, title_key`` come first, then the listings
    by segment and arrival. Kept are the titles of a bucket and the founders of a segment.
    """
    bucket, segment = None, None
    near: dict[tuple, list[tuple]] = {}
    fingerprints: set[str] = set()
    starts: dict[tuple, list[int]] = {}

    def close(title: tuple, ms: int) -> bool:
        at = starts.get(title, ())
        k = bisect_left(at, ms - FUZZY_WINDOW_MS)
        return k < len(at) and at[k] <= ms + FUZZY_WINDOW_MS

    for batch in batches:
        kept = []
        columns = (batch[c].tolist() for c in ("bucket", "segment", "listing", "other_key", "fingerprint", "city", "title_key", "starts_ms"))
        for k, (into, part, listing, other, fingerprint, city, title, ms) in enumerate(zip(*columns, strict=True)):
            if into != bucket:
                bucket, segment, near = into, None, {}
            if not listing:
                near.setdefault((city, title), []).append((city, other))
                continue
            if part != segment:
                segment, fingerprints, starts = part, set(), {}
            if fingerprint in fingerprints or any(close(other, ms) for other in near.get((city, title), ())):
                continue
            fingerprints.add(fingerprint)
            insort(starts.setdefault((city, title), []), ms)
            kept.append(k)
        yield batch.iloc[kept][FOUNDER]


def fold(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Founders among the rows of whole segments, each of which goes through one task."""
    shipped(rows.sparkSession)
    buckets = max(1, -(-rows.count() // BUCKET))
    dealt = rows.select(F.pmod(F.xxhash64("segment"), F.lit(buckets)).alias("bucket"), F.lit(True).alias("listing"), F.col("segment").cast("long").alias("segment"), F.lit(None).cast("string").alias("other_key"), *FOUNDER)
    similar = dealt.select("bucket", "city", "title_key").distinct().join(titles, ["city", "title_key"])
    # No number is null, as pandas would make all numbers of a batch inexact.
    unused = [F.lit(b"" if c == "id" else "" if c == "fingerprint" else 0).cast(dealt.schema[c].dataType).alias(c) for c in FOUNDER if c not in ("city", "title_key")]
    similar = similar.select("bucket", F.lit(False).alias("listing"), F.lit(0).cast("long").alias("segment"), "other_key", "city", "title_key", *unused)
    ordered = dealt.unionByName(similar).repartition(buckets, "bucket").sortWithinPartitions("bucket", "listing", "segment", "seq")
    return ordered.mapInPandas(earliest_first, rows.select(FOUNDER).schema)


def _slices(rows: DataFrame, titles: DataFrame, most: int) -> DataFrame:
    """Founders among the rows of large segments, about ``most`` rows of a segment at a time in arrival order."""
    parts = -(-rows.groupBy("segment").count().agg(F.max("count")).first()[0] // most)
    bounds = rows.groupBy("segment").agg(F.percentile_approx("seq", [k / parts for k in range(1, parts)], 100 * parts + 10_000).alias("bounds"))
    part = F.size(F.filter("bounds", lambda last: last < F.col("seq")))
    # In order, so that only the files of a slice are read for it.
    rows = cut(rows.join(bounds, "segment").withColumn("part", part).drop("bounds").repartitionByRange("part", "seq"))
    founders = rows.select(FOUNDER).limit(0)
    for k in range(parts):
        left = rows.filter(F.col("part") == k).drop("part")
        left = cut(_drop_matched(left, founders, titles)) if k else left
        founders = founders.unionByName(cut(fold(left, titles)))
    return founders


def _founders(rows: DataFrame, stored: DataFrame, titles: DataFrame, most: int = SEGMENT) -> DataFrame:
    undecided = cut(rows if stored.isEmpty() else _drop_matched(rows, stored, titles))
    if undecided.count() <= most:
        return cut(fold(undecided.withColumn("segment", F.lit(0)), titles))
    parts = cut(segments(undecided, titles))
    large = cut(parts.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("segment"))
    if large.isEmpty():
        return cut(fold(parts, titles))
    small = cut(fold(parts.join(large, "segment", "left_anti"), titles))
    return small.unionByName(_slices(parts.join(large, "segment", "left_semi"), titles, most))


def resolve_batch(listings: DataFrame, events: DataFrame, fuzzy: bool = True, most: int = SEGMENT) -> DataFrame:
    """Target event per listing: ``seq, event_id, matched_by, distance``.

    ``listings`` are normalised and carry each new URL once. ``matched_by`` is
    ``new`` for the founder of an event, else ``fingerprint`` or ``fuzzy``. Segments of
    more than ``most`` listings are resolved slice by slice.
    """
    nodes = listings.select("seq", event_id(F.col("url")).alias("id"), "fingerprint", "city", "title_key", "starts_at")
    if not fuzzy:
        return _resolve_exact(nodes, events)
    # Half as wide as the digits; and written, as the listings are read again and again.
    nodes = cut(with_block(nodes).drop("starts_at").withColumn("id", F.unhex("id")))
    stored = keyed_events(events)
    shape = ["city", "title_key", "starts_ms"]
    titles = cut(similar_titles(nodes.select(shape).unionByName(stored.select(shape))))
    copies = nodes.groupBy("fingerprint", *BLOCK_KEY, "starts_ms").agg(F.min(F.struct("seq", "id")).alias("first"))
    founders = _founders(copies.select("*", "first.*").drop("first"), stored, titles, most).withColumn("id", F.lower(F.hex("id")))

    # Stored events come before every listing; among themselves the older first.
    targets = stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(
        founders.withColumn("created_at", F.lit(None).cast("timestamp"))
    )
    order = F.struct(F.col("seq").alias("since"), "created_at", "id")
    # Written first: a join on the partitioning of an aggregate is not split at a hot fingerprint.
    by_fingerprint = cut(targets.groupBy("fingerprint").agg(F.min(order).alias("exact")))
    exact = F.when(F.col("exact.since") < F.col("seq"), F.col("exact.id"))
    founded = founders.select("seq", F.col("id").alias("founded_id"))
    known = nodes.drop("id").join(by_fingerprint, "fingerprint", "left").join(founded, "seq", "left")
    known = cut(known.withColumn("exact", exact).drop("fingerprint"))
    settled = F.col("founded_id").isNotNull() | F.col("exact").isNotNull()
    # Titles decide only where the fingerprint does not.
    rest = known.filter(~settled)
    by_title = closest(rest.select("seq", *BLOCK_KEY, "starts_ms"), near_blocks(targets, titles), order, F.col("first.since") < F.col("seq"))
    done = known.filter(settled).select(
        "seq",
        F.coalesce("founded_id", "exact").alias("event_id"),
        F.when(F.col("founded_id").isNotNull(), "new").otherwise("fingerprint").alias("matched_by"),
        F.lit(None).cast("double").alias("distance"),
    )
    return done.unionByName(
        rest.select("seq")
        .join(by_title, "seq", "left")
        .select("seq", F.col("best.order.id").alias("event_id"), F.lit("fuzzy").alias("matched_by"), F.col("best.distance").alias("distance"))
    )


def _resolve_exact(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Without fuzzy matching the earliest listing of a fingerprint founds its event."""
    first = nodes.groupBy("fingerprint").agg(F.min(F.struct("seq", "id")).alias("first"))
    stored = events.select("fingerprint", F.col("id").alias("stored_id"))
    # Written first: a join on the partitioning of an aggregate is not split at a hot fingerprint.
    target = cut(first.join(stored, "fingerprint", "left"))
    founder = F.col("stored_id").isNull() & (F.col("first.seq") == F.col("seq"))
    return nodes.select("seq", "fingerprint").join(target, "fingerprint").select(
        "seq",
        F.coalesce("stored_id", "first.id").alias("event_id"),
        F.when(founder, "new").otherwise("fingerprint").alias("matched_by"),
        F.lit(None).cast("double").alias("distance"),
    )
