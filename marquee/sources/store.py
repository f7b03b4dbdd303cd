"""Versions of the canonical tables that share the files they have in common.

The rows of a table lie in buckets of a month and a number, chosen such that rows which change
together lie together: events by city and day, their listings where the event lay when they
were first written. A version is a manifest that names, for every bucket, the write that
holds it. A commit copies only buckets with changed rows, into a folder of its own, and
takes over the other entries. Then it writes its manifest, then a marker: readers only see marked
versions, so a commit that ends anywhere in between changes nothing, and all
earlier versions stay as they were.

A manifest has one row for each bucket, so it is as large as the calendar and not as the tables.
"""

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from marquee import schemas
from marquee.session import cut, utc

#: Buckets of a month; those of a table without months.
BUCKETS, PLAIN_BUCKETS = 128, 16
KEYS = {"events": ["id"], "event_sources": ["id"], "sources": ["id"], "favorites": ["user_id", "event_id"], "scraped_pages": ["url"]}
#: Order inside a file, where readers filter by it.
ORDERS = {"events": ["city", "starts_at"]}
PLACE = ["month", "bucket"]
MANIFEST = "name string, month string, bucket int, write string, rows long"


@dataclass(frozen=True)
class Changes:
    """New and changed rows of a table, and the keys of rows that are replaced or removed."""

    rows: DataFrame
    gone: DataFrame


def difference(name: str, before: DataFrame, after: DataFrame) -> Changes:
    """What makes ``after`` of ``before``, both with unique keys."""
    keys = KEYS[name]
    rows = cut(after.subtract(before))
    removed = before.select(*keys).join(after.select(*keys), keys, "left_anti")
    return Changes(rows, cut(rows.select(*keys).unionByName(removed)))


def commits(spark: SparkSession, root: str) -> DataFrame | None:
    """The markers of all versions: ``version, at, run, batch``; None if there are none yet."""
    try:
        return spark.read.schema("at timestamp, run string, batch long, version int").parquet(f"{root}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed_version(spark: SparkSession, root: str) -> int | None:
    """Latest version whose marker was written, or None."""
    marks = commits(spark, root)
    return None if marks is None else marks.agg(F.max("version")).first()[0]


def is_committed(spark: SparkSession, root: str, run: str, batch: int) -> bool:
    """Whether a batch of a streaming run is part of some version already."""
    marks = commits(spark, root)
    return marks is not None and not marks.filter((F.col("run") == run) & (F.col("batch") == batch)).isEmpty()


def manifest(spark: SparkSession, root: str, version: int) -> list[Row]:
    """The buckets of a version: ``name, month, bucket, write, rows``."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{version}").collect()


def placed_rows(spark: SparkSession, root: str, name: str, entries: list[Row]) -> DataFrame:
    """The rows of a table's buckets, with the ``month`` and ``bucket`` they lie in."""
    schema = getattr(schemas, name.upper())
    base, wanted = f"{root}/data/{name}", [e for e in entries if e["name"] == name]
    if not wanted:
        return spark.createDataFrame([], f"{schema.toDDL()}, month string, bucket int")
    paths = [f"{base}/write={e['write']}/month={e['month']}/bucket={e['bucket']}" for e in wanted]
    rows = spark.read.schema(f"{schema.toDDL()}, write string, month string, bucket int").option("basePath", base).parquet(*paths)
    return rows.drop("write")


def _place(name: str, rows: DataFrame, events: DataFrame | None) -> DataFrame:
    """The rows with the ``month`` and ``bucket`` where new ones go."""

    def at(month: Column, bucket: Column) -> list[Column]:
        return [month.alias("month"), bucket.cast("int").alias("bucket")]

    def number(buckets: int, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(buckets))

    if name == "events":
        return rows.select("*", *at(F.date_format("start_day", "yyyy-MM"), number(BUCKETS, "city", "start_day")))
    if name == "event_sources":
        owners = events.select(F.col("id").alias("event_id"), F.date_format("start_day", "yyyy-MM").alias("m"), number(BUCKETS, "city", "start_day").alias("b"))
        known = rows.join(owners, "event_id", "left")
        return known.select(*rows.columns, *at(F.coalesce("m", F.lit("none")), F.coalesce("b", F.lit(0))))
    key = {"favorites": "event_id", "scraped_pages": "url"}.get(name)
    return rows.select("*", *at(F.lit("all"), number(PLAIN_BUCKETS, key) if key else F.lit(0)))


def commit(
    spark: SparkSession, root: str, version: int, changes: dict[str, Changes], events: DataFrame | None = None, base: int | None = None, run: str | None = None, batch: int | None = None
) -> list[Row]:
    """Write ``version`` as ``base`` (nothing, if None) with ``changes``; returns its manifest.

    ``events`` are those of the new version; new listings are placed by them. ``run`` and
    ``batch`` name the streaming batch that made the version, if one did. A rerun of the same
    version replaces a half-written one.
    """
    entries = manifest(utc(spark), root, base) if base is not None else []
    for name, change in changes.items():
        keys, columns = KEYS[name], getattr(schemas, name.upper()).names
        new = _place(name, change.rows.select(*columns), events)
        old = placed_rows(spark, root, name, entries)
        left = old.join(change.gone, keys, "left_semi").select(*keys, *PLACE)
        if name == "event_sources":
            # A listing stays in its bucket when its event moves to another day.
            stays = left.select(*keys, F.col("month").alias("m"), F.col("bucket").alias("b"))
            new = new.join(stays, keys, "left").withColumns({"month": F.coalesce("m", "month"), "bucket": F.coalesce("b", "bucket")}).drop("m", "b")
        new = cut(new)
        touched = {tuple(r) for r in new.select(*PLACE).unionByName(left.select(*PLACE)).distinct().collect()}
        if not touched:
            continue
        copied = placed_rows(spark, root, name, [e for e in entries if (e["month"], e["bucket"]) in touched]).join(change.gone, keys, "left_anti")
        write = uuid.uuid4().hex
        rows = new.unionByName(copied.select(*new.columns))
        # Large buckets are split and small ones gathered by their true sizes.
        dealt = rows.sparkSession.sql("SELECT /*+ REBALANCE(month, bucket) */ * FROM {rows}", rows=rows)
        dealt.sortWithinPartitions(*PLACE, *ORDERS.get(name, keys)).write.partitionBy(*PLACE).parquet(f"{root}/data/{name}/write={write}")
        counted = rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("rows")).collect()
        entries = [e for e in entries if e["name"] != name or (e["month"], e["bucket"]) not in touched]
        entries += [Row(name=name, month=r["month"], bucket=r["bucket"], write=write, rows=r["rows"]) for r in counted]
    listed = [(e["name"], e["month"], e["bucket"], e["write"], e["rows"]) for e in entries]
    spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/{version}")
    mark = [F.current_timestamp().alias("at"), F.lit(run).cast("string").alias("run"), F.lit(batch).cast("long").alias("batch")]
    spark.range(1).select(*mark).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/version={version}")
    return entries
