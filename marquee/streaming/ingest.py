"""Listings that land in a folder, ingested in micro-batches."""

import struct
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marquee import schemas
from marquee.plans.ingest import ingest
from marquee.session import shipped
from marquee.sources.store import commit, committed_version, is_committed
from marquee.sources.tables import empty_tables, read_snapshot, stream_listings, write_snapshot


def ingest_batch(
    spark: SparkSession, batch: DataFrame, root: str, run: str, number: int, sources: DataFrame, fuzzy: bool = True
) -> None:
    """Add batch ``number`` of a run to the snapshot under ``root``; a repeated batch changes nothing."""
    if is_committed(spark, root, run, number):
        return
    committed = committed_version(spark, root)
    tables = read_snapshot(spark, root, committed) if committed is not None else empty_tables(spark, sources)
    result = ingest(tables, batch, F.current_timestamp(), fuzzy)
    if committed is None:
        write_snapshot(result.tables, root, 0, run, number)
    else:
        commit(spark, root, committed + 1, result.changes, result.tables.events, committed, run, number)


#: What makes a delivery of a listing new.
CONTENT = [n for n in schemas.RAW_LISTINGS.names if n != "seq"]
#: Days without a delivery after which a URL is forgotten.
KEPT_DAYS = 30
#: URLs share a state by a hash, as a state for each URL costs a call for each. The number is part of a run's progress folder.
STATE_BUCKETS = 512
#: What is known of a URL: hashes (128 bits) of itself and of its last content, and when (ms) it was delivered.
KNOWN = "<16s16sq"


def new_deliveries(known: dict[bytes, tuple[bytes, int]], rows: pd.DataFrame) -> list[int]:
    """Positions of the rows that differ from the last content of their URL; ``known`` then has their contents."""
    order = sorted(zip(rows["unnumbered"].tolist(), rows["seq"].tolist(), range(len(rows)), strict=True))
    urls, contents, times = (rows[c].tolist() for c in ("url_key", "content", "delivered_at"))
    passed = []
    for _, _, k in order:
        content, at = known.get(urls[k], (None, 0))
        if contents[k] != content:
            passed.append(k)
        known[urls[k]] = (contents[k], max(at, times[k]))
    return passed


def first_deliveries(stream: DataFrame, days: int = KEPT_DAYS) -> DataFrame:
    """The listings of a stream whose content differs from the one last delivered for their URL.

    The state of the stream holds, for each URL, a hash of its last content, so a listing that changes
    and changes back passes both times. Inside a micro-batch deliveries count in order of ``seq``;
    between batches in order of the batches, whatever their ``seq``: a late row that
    differs from the last one passes. A URL that was not delivered for ``days`` is forgotten, and
    its next delivery passes. A batch that is replayed after a failure meets the state
    before it, so it passes the same rows again; ``ingest_batch`` then applies them once.
    """
    shipped(stream.sparkSession)
    kept, names = days * 86_400_000, schemas.RAW_LISTINGS.names

    def pass_new(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {url: (content, at) for url, content, at in struct.iter_unpack(KNOWN, state.get[0])} if state.exists else {}
        out, delivered, watermark = None, set(), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True)
            out = rows[["unnumbered", *names]].iloc[new_deliveries(known, rows)]
            delivered = set(rows["url_key"])
        known = {url: last for url, last in known.items() if url in delivered or last[1] + kept >= watermark}
        if known:
            state.update((b"".join(struct.pack(KNOWN, url, *last) for url, last in known.items()),))
            state.setTimeoutTimestamp(max(min(at for _, at in known.values()) + kept, watermark))
        else:
            state.remove()
        if out is not None:
            yield out

    def digest(value: Column) -> Column:
        return F.unhex(F.left(F.sha2(value, 256), F.lit(32)))

    url_key = digest(F.to_json(F.struct("source_url")))
    # The time of the micro-batch; a processing-time timeout would keep a run from ever ending.
    timed = stream.select(*names, digest(F.to_json(F.struct(*CONTENT))).alias("content"), url_key.alias("url_key"), F.current_timestamp().alias("delivered")).withWatermark("delivered", "1 hour")
    dealt = timed.withColumns(
        {
            # Numbers stay whole next to rows without one.
            "unnumbered": F.col("seq").isNull(),
            "seq": F.coalesce("seq", F.lit(0)),
            "delivered_at": F.unix_millis("delivered"),
            "bucket": F.pmod(F.xxhash64("url_key"), F.lit(STATE_BUCKETS)),
        }
    )
    schema = T.StructType([T.StructField("unnumbered", T.BooleanType()), *schemas.RAW_LISTINGS.fields])
    new = dealt.groupBy("bucket").applyInPandasWithState(pass_new, schema, "known binary", "append", GroupStateTimeout.EventTimeTimeout)
    return new.withColumn("seq", F.when(~F.col("unnumbered"), F.col("seq"))).drop("unnumbered")


def stream_ingest(
    spark: SparkSession, landing: str, root: str, checkpoint: str, sources: DataFrame, fmt: str = "parquet", fuzzy: bool = True, redeliveries: bool = True
) -> StreamingQuery:
    """Start a run that takes all listings there are now, then stops.

    One trigger equals one scheduled run. A batch is known by its number and the id
    of its query, which lives in the progress folder: replayed after a failure it is
    applied once, and a run with a new progress folder is a new run. Without
    ``redeliveries``, listings whose content was the last one delivered for their URL are left out.
    """
    named, query = threading.Event(), []

    def apply(batch: DataFrame, number: int) -> None:
        named.wait()
        ingest_batch(batch.sparkSession, batch, root, str(query[0].id), number, sources, fuzzy)

    listings = stream_listings(spark, landing, fmt)
    started = (
        (listings if redeliveries else first_deliveries(listings))
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.append(started)
    named.set()
    return started


def without_redeliveries(stream: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Drop exact re-deliveries; a listing whose price or time changed passes."""
    content = ["source_url", "title", "venue", "city", "starts_at", "ends_at", "price_from", "currency"]
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(content)
